"""Repair of texts that were decoded with the wrong table.

Each wrong reading is undone by the table it was read with (or two in a row),
which gives bytes; the bytes are read anew. Of all readings the one whose
neighbouring letters are likeliest stands, if it's clearly likelier than the
text as it is. UTF-8 has a form that other bytes rarely have, so such a reading
comes first and needn't be likely itself; a reading with a single-byte table
needs neighbours that speak for it. Where Latin letters with accents are read as
others, it needs the more of them the more plain Latin letters the text has,
among which a word of accents may stand by chance. Only neighbours of which one
is beyond ASCII count; those of many texts are priced at a time, by NumPy.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tables a text may have been read with, and those it may have been written in.
SEEN = ("cp1251", "cp1252", "latin-1", "koi8-r", "cp866")
WRITTEN = ("utf-8", "cp1251", "koi8-r", "cp866")
#: Tables that UTF-8 is read with twice.
TWICE = ("cp1251", "cp1252", "latin-1")
LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
#: Signs beyond ASCII that clean texts hold anywhere, and those that don't stand beside letters like é.
USUAL, MEASURES = "«»“”„‘’–—…\u00a0", "№°±×÷µØ§•€™®©·¼½¾²³"
#: Costs of neighbours: scripts in one word, odd signs, letters beyond ASCII side by side or beside one of ASCII, a capital behind a small letter.
MIXED, ODD, FOREIGN, ACCENT, CAPITAL = -8.0, -8.0, -4.5, -1.0, -3.0
#: A reading must be so much likelier on average, and one with a single-byte table so likely itself.
MARGIN, LIKELY = 1.0, -4.3
#: Letters with accents must be so much likelier altogether with another single-byte table, besides the logarithm of the text's plain Latin letters.
WESTERN, SURE = ("cp1252", "latin-1"), 5.0
#: Signs that are priced at a time; a longer text is alone.
SIGNS = 1 << 20
#: Kinds of signs; Russian letters follow, small ones and then capitals.
_PLAIN, _LATIN, _ACCENTED, _ODD, _MEASURE, _RUSSIAN = range(6)


def high(name: str) -> str:
    """The 128 signs of a single-byte table beyond ASCII; control characters where it has none."""
    return "".join(bytes([b]).decode(name, errors="ignore") or chr(b) for b in range(128, 256))


@cache
def pair_costs() -> list[float]:
    """Log probabilities of a letter behind another, row by row, from the Russian of this library's prompts and terms."""
    from gridline import model
    from gridline.operators import reasoned

    texts = [v for m in (model, reasoned) for v in vars(m).values() if isinstance(v, str)] + [w for v in vars(model).values() if isinstance(v, (list, tuple)) for w in v if isinstance(w, str)]
    pairs = Counter(p for t in texts for p in zip(t.lower(), t.lower()[1:], strict=False) if p[0] in LETTERS and p[1] in LETTERS)
    firsts = Counter(a for (a, _), n in pairs.items() for _ in range(n))
    return [math.log((pairs[a, b] + 0.2) / (firsts[a] + 0.2 * len(LETTERS))) for a in LETTERS for b in LETTERS]


def kind(c: str) -> int:
    """The kind of a sign."""
    low = c.lower()
    if len(low) == 1 and low in LETTERS:
        return _RUSSIAN + LETTERS.index(low) + (len(LETTERS) if low != c else 0)
    if c in MEASURES:
        return _MEASURE
    if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", c):
        return _LATIN if c < "\x80" else _ACCENTED
    return _ODD if c > "\x7f" and c not in USUAL else _PLAIN


@cache
def costs() -> np.ndarray:
    """Costs in thousandths of a kind behind another; 1 where they say nothing."""
    n, size = len(LETTERS), _RUSSIAN + 2 * len(LETTERS)
    out = np.full((size, size), 1, np.int64)
    thousandths = lambda x: round(1000 * x)
    known = np.array([thousandths(c) for c in pair_costs()]).reshape(n, n)
    for a in (0, 1):
        for b in (0, 1):
            out[_RUSSIAN + a * n : _RUSSIAN + (a + 1) * n, _RUSSIAN + b * n : _RUSSIAN + (b + 1) * n] = known + (thousandths(CAPITAL) if b and not a else 0)
    out[_RUSSIAN:, [_LATIN, _ACCENTED]] = out[[_LATIN, _ACCENTED], _RUSSIAN:] = thousandths(MIXED)
    out[_ACCENTED, _ACCENTED] = thousandths(FOREIGN)
    out[_ACCENTED, _LATIN] = out[_LATIN, _ACCENTED] = thousandths(ACCENT)
    out[_ACCENTED, _MEASURE] = out[_MEASURE, _ACCENTED] = out[_ODD, :] = out[:, _ODD] = thousandths(ODD)
    return out


@cache
def _kinds() -> np.ndarray:
    """The kinds of the basic plane's signs; the last one is odd like all beyond it."""
    return np.array([kind(chr(c)) for c in range(1 << 16)], np.uint8)


@cache
def _undoing(seen: str) -> np.ndarray:
    """The byte that a table shows as a sign of the basic plane, 0 (no sign but the first) where it has none."""
    out = np.zeros(1 << 16, np.uint8)
    out[:128] = np.arange(128)
    out[[ord(c) for c in high(seen)]] = np.arange(128, 256)
    return out


@cache
def _kinds_of(written: str) -> np.ndarray:
    """The kinds of the 256 bytes of a table."""
    return np.array([kind(chr(b)) for b in range(128)] + [kind(c) for c in high(written)], np.uint8)


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of all texts, and where each text begins and ends."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _pairs(signs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where neighbours stand of which one is beyond ASCII, and their texts."""
    beyond = signs > 127
    both = beyond[:-1] | beyond[1:]
    ends = bounds[1:-1]
    both[ends[(ends > 0) & (ends < len(signs))] - 1] = False
    at = np.flatnonzero(both)
    return at, np.searchsorted(bounds, at, "right") - 1


def _means(first: np.ndarray, second: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean cost of neighbours' kinds for each of n texts; NaN without any that say something."""
    table = costs()
    cost = table.ravel()[first.astype(np.int64) * len(table) + second]
    counts = cost <= 0
    found = np.bincount(owner[counts], minlength=n)
    total = np.bincount(owner[counts], cost[counts], minlength=n)  # sums of whole numbers, exact
    return np.divide(total, 1000 * found, out=np.full(n, np.nan), where=found > 0)


def likelihood(texts: list[str]) -> np.ndarray:
    """Mean cost of each text's neighbours beyond ASCII; NaN without any."""
    signs, bounds = _signs(texts)
    at, owner = _pairs(signs, bounds)
    a, b = signs[at], signs[at + 1]
    return _means(_kinds()[np.minimum(a, 0xFFFF)], _kinds()[np.minimum(b, 0xFFFF)], owner, len(texts))


def _as_utf8(texts: list[str], seen: str) -> list[str | None]:
    """The texts' bytes by a table, read with UTF-8; None where the table hasn't all signs or the bytes aren't valid."""
    signs, bounds = _signs(texts)
    value = _undoing(seen)[np.minimum(signs, 0xFFFF)]
    missing = np.flatnonzero((value == 0) & (signs != 0))
    lost = set((np.searchsorted(bounds, missing, "right") - 1).tolist())
    held, out = value.tobytes(), []
    for i in range(len(texts)):
        try:
            out.append(None if i in lost else held[bounds[i] : bounds[i + 1]].decode("utf-8"))
        except UnicodeDecodeError:
            out.append(None)
    return out


def _single(text: str, seen: str, written: str) -> str:
    return text.translate(str.maketrans(high(seen), high(written)))


def _by_utf8(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, list[str]]]:
    """Of each reading by UTF-8 the numbers of the texts that can be read so, their scores and readings."""
    for seen in SEEN:
        held = [(i, t) for i, t in enumerate(_as_utf8(texts, seen)) if t is not None]
        yield [i for i, _ in held], np.nan_to_num(likelihood([t for _, t in held])), [t for _, t in held]
        if seen in TWICE:
            again = [(i, t) for (i, _), t in zip(held, _as_utf8([t for _, t in held], seen), strict=True) if t is not None]
            yield [i for i, _ in again], np.nan_to_num(likelihood([t for _, t in again])), [t for _, t in again]


def _by_tables(texts: list[str]) -> Iterator[tuple[str, str, np.ndarray]]:
    """Of each reading with a single-byte table the tables and the texts' scores (NaN: none)."""
    signs, bounds = _signs(texts)
    at, owner = _pairs(signs, bounds)
    for seen in SEEN:
        value = _undoing(seen)[np.minimum(signs, 0xFFFF)]
        whole = np.ones(len(texts), bool)
        whole[np.searchsorted(bounds, np.flatnonzero((value == 0) & (signs != 0)), "right") - 1] = False
        kept = whole[owner]
        first, second, own = value[at[kept]], value[at[kept] + 1], owner[kept]
        for written in WRITTEN:
            if written not in ("utf-8", seen):
                kinds = _kinds_of(written)
                yield seen, written, _means(kinds[first], kinds[second], own, len(texts))


def gain(text: str, seen: str, written: str) -> float:
    """How much likelier a reading with a single-byte table is altogether; repeated neighbours count once."""
    signs, bounds = _signs([text])
    at, _ = _pairs(signs, bounds)
    several = np.unique(signs[at].astype(np.int64) << 32 | signs[at + 1])
    first, second = np.minimum(several >> 32, 0xFFFF), np.minimum(several & 0xFFFFFFFF, 0xFFFF)
    cost = lambda kinds: np.minimum(costs()[kinds[first], kinds[second]], 0)
    return float((cost(_kinds_of(written)[_undoing(seen)]) - cost(_kinds())).sum()) / 1000


def read_anew(texts: list[str]) -> list[str]:
    """The likeliest reading of each text, itself unless another is clearly likelier."""
    own = np.nan_to_num(likelihood(texts))
    out, best = list(texts), own + MARGIN
    for at, score, read in _by_utf8(texts):
        for j in np.flatnonzero(score > best[at]).tolist():  # the first of equal ones stands
            best[at[j]], out[at[j]] = score[j], read[j]
    rest = [i for i, (a, b) in enumerate(zip(texts, out, strict=True)) if a is b]
    others, own = [texts[i] for i in rest], own[rest]
    plain = np.array([sum(map(t.count, string.ascii_letters)) for t in others])
    best, tables = np.maximum(own + MARGIN, LIKELY), np.full(len(others), -1)
    held = []
    for k, (seen, written, score) in enumerate(_by_tables(others)):
        held.append((seen, written))
        for j in np.flatnonzero(score > best).tolist():
            if seen not in WESTERN or gain(others[j], seen, written) > SURE + math.log1p(plain[j]):
                best[j], tables[j] = score[j], k
    for j in np.flatnonzero(tables >= 0).tolist():
        seen, written = held[tables[j]]
        out[rest[j]] = others[j].translate(str.maketrans(high(seen), high(written)))
    return out


def _decoded(text: bytes) -> str | None:
    try:
        return text.decode()
    except UnicodeDecodeError:  # Spark's strings may hold any bytes
        return None


def read_batch(texts: pa.Array) -> pa.Array:
    """read_anew of a batch, SIGNS signs at a time. ASCII, empty, null and invalid texts stay."""
    out = texts.cast(pa.binary()).to_pylist()
    held: list[tuple[int, str]] = []
    size = 0

    def read() -> None:
        for (i, text), anew in zip(held, read_anew([t for _, t in held]), strict=True):
            if anew is not text:
                out[i] = anew.encode()
        held.clear()

    for i, raw in enumerate(out):
        text = None if raw is None or raw.isascii() else _decoded(raw)
        if text is not None:
            if held and size + len(text) > SIGNS:
                read()
                size = 0
            held.append((i, text))
            size += len(text)
    read()
    return pa.array(out, pa.binary()).cast(pa.string(), safe=False)


def repaired(text: Column) -> Column:
    """The likeliest reading of a text, itself unless another is clearly likelier. ASCII, empty and null texts stay."""

    def read(texts: pa.Array) -> pa.Array:
        return read_batch(texts)

    return F.arrow_udf(read, StringType())(text)
