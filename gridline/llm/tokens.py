"""Token counts by a two-tier lookup on the map side.

Pre-tokens are the runs between white space (space, U+0009 to U+000D). Where a
tokenizer drops white space and splits at it, a text has the sum of its
pre-tokens' lengths; that's found out by probes, and with any other tokenizer
whole texts go to its library. Tier one is a broadcast table of the lengths of
frequent pre-tokens, tier two a bounded cache in each worker, filled by
encoding misses with the library itself. No pre-token is ever shuffled.
"""

from __future__ import annotations

import os
import random
import string
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import bounded, table, with_columns

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Pre-tokens in the broadcast table, and their greatest length in bytes: 3 MB at most.
FREQUENT = 65_536
FREQUENT_BYTES = 48
#: Texts, drawn at random, that the table's pre-tokens are taken from, and how many of them a task proposes. They save work and change no result.
SAMPLE_TEXTS = 4096
PROPOSED = 4096
#: Entries of a worker's cache before it's emptied.
CACHED = 300_000
#: Bytes of text that are split at once.
STEP = 1 << 20
_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def pieces(data: bytes, step: int = STEP) -> Iterator[bytes]:
    """data in parts of about step bytes that end at white space."""
    at = 0
    while len(data) - at > step:
        end = at + step
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def folded(data: bytes) -> bytes:
    """Pre-tokens of ASCII in lower case, which the tokenizer does anyway, unless special strings may be inside.

    Others stay as they are: the tokenizer composes letters and marks before it
    lowers them, and a lowered pair may compose where the pair didn't.
    """
    if b"<|" in data:
        return data
    if data.isascii():
        return data.lower()
    return b" ".join([t.lower() if t.isascii() else t for t in data.split()])


def frequent(texts: DataFrame, rows: int = FREQUENT) -> list[bytes]:
    """The most frequent pre-tokens of a sample of column text.

    About 4096 texts are drawn, and each task proposes the 4096 most frequent
    pre-tokens of its own; the driver adds them up. The table only saves work,
    it doesn't change a result.
    """

    def propose(batches):
        counts: Counter = Counter()
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()):
                for part in pieces(folded(data.as_py() or b"")):
                    counts.update(part.split())
        best = [(k, n) for k, n in counts.most_common(PROPOSED) if len(k) <= FREQUENT_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["token", "n"])

    bounded(texts.sparkSession)
    share = SAMPLE_TEXTS / max(1, texts.count())
    drawn = texts.where(F.rand(17) < share) if share < 1 else texts
    found = drawn.mapInArrow(propose, "token binary, n long").toArrow().group_by("token").aggregate([("n", "sum")])
    best = sorted(zip(found.column("n_sum").to_pylist(), found.column("token").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    return [bytes(token) for _, token in best[:rows]]


def library(path: str) -> Callable[[list[str]], list[int]]:
    """The token counts of texts by the library of a file: tokenizers for .json, sentencepiece for .model."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(e) for e in processor.encode(texts, num_threads=1)]
    raise ValueError(f"{path}: neither .json nor .model")


def facts(count: Callable[[list[str]], list[int]], probes: int = 400, seed: int = 3) -> tuple[bool, bool]:
    """Whether a text has the sum of its pre-tokens' counts, and whether a full stop or comma behind a letter or digit, and capitals of ASCII, may be told apart.

    Both are found by probes: seeded texts of words, signs and white space of all kinds.
    """
    rng = random.Random(seed)
    signs = string.ascii_letters * 3 + string.digits + ".,'-!()#/:é日ßЖ"
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(probes)] + ["don't", "U.S.A.", "3,14", "x..", "We'll", "A1", "\U0001f600."]
    texts = ["".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", " \x0b\x0c "]) for w in rng.sample(words, 5)) for _ in range(probes)]
    each = dict(zip(words, count(words), strict=True))
    if any(n != sum(each[w] for w in t.split()) for t, n in zip(texts, count(texts), strict=True)):
        return False, False
    plain = [w for w in words if w.isascii() and w.isalnum()]
    ends = [w + sign for w in plain for sign in ".,"]
    one, two = count(["."])[0], count([","])[0]
    apart = count(ends) == [each[w] + n for w in plain for n in (one, two)]
    return True, apart and count([w.lower() for w in plain]) == [each[w] for w in plain]


class Counts:
    """Token counts of texts: table first, then cache, then the library."""

    def __init__(self, path: str, lengths: dict[bytes, int], known: tuple[bool, bool] | None = None):
        self.path, self.count = path, library(path)
        self.splits, self.apart = facts(self.count) if known is None else known
        self.lengths, self.cache = lengths, dict(lengths)

    def encode(self, tokens: list[bytes]) -> list[int]:
        return self.count([t.decode() for t in tokens])

    def emptied(self, tokens: list[bytes]) -> set[bytes]:
        self.cache = dict(self.lengths)
        return set(tokens).difference(self.cache)

    def learn(self, missing: set[bytes]) -> None:
        """Put the lengths of pre-tokens into the cache.

        Where a full stop or comma behind an ASCII letter or digit is a piece of
        its own for the tokenizer, such pre-tokens are sums.
        """
        ended = {t for t in missing if t[-1:] in (b".", b",") and t[-2:-1].isalnum()} if self.apart else set()
        needed = list(({t[:-1] for t in ended} | (missing - ended) | ({b".", b","} if ended else set())).difference(self.cache))
        for lo in range(0, len(needed), 4096):
            some = needed[lo : lo + 4096]
            self.cache.update(zip(some, self.encode(some), strict=True))
        self.cache.update({t: self.cache[t[:-1]] + self.cache[t[-1:]] for t in ended})

    def of(self, data: bytes) -> int:
        if not self.splits:
            return self.encode([data])[0]
        total = 0
        for part in pieces(folded(data) if self.apart else data):
            tokens = part.split()
            missing = set(tokens).difference(self.cache)
            if missing:
                self.learn(missing if len(self.cache) <= CACHED else self.emptied(tokens))
            total += sum(map(self.cache.__getitem__, tokens))
        return total


#: What this worker has loaded, for all its tasks: a length is a fact of its file, whatever the corpus.
_LOADED: dict[str, Counts] = {}


def of_worker(path: str, lengths: dict[bytes, int], known: tuple[bool, bool]) -> Counts:
    """This worker's tokenizer and cache; of one file at a time."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Counts(path, lengths, known)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), max_tokens: int = MAX_TOKENS) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit of every row of docs (column text).

    path is a tokenizer file (.json or .model) that every worker can read; its
    library decides about special strings in texts. Null counts as empty: 0
    bytes, 0 tokens. Repeated rows and ids are counted each. Texts are split at
    white space in steps of 1 MB where the tokenizer does so too, else encoded
    whole, so memory is bounded by a text. Other columns are ignored, an empty
    table gives an empty one.
    """
    lookup = Counts(path, {})
    known = lookup.splits, lookup.apart
    best = frequent(docs.select("text")) if lookup.splits else []
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(best, lookup.encode(best), strict=True)))

    def count(batches):
        counts = of_worker(path, shared.value, known)
        for batch in batches:
            sizes, tokens = [], []
            for data in batch.column("text").cast(pa.binary()):
                data = data.as_py() or b""
                sizes.append(len(data))
                tokens.append(counts.of(data))
            columns = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens"])

    bounded(docs.sparkSession)
    schema = with_columns(docs, keep, "n_bytes long, n_tokens long")
    counted = docs.select(*keep, "text").mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op7_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts of all documents; tokenizer is the file of another vocabulary."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer)
