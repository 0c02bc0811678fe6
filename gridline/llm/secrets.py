"""Secret scans: patterns find candidates, a random forest removes false positives."""

from __future__ import annotations

import base64
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import bounded, table, with_columns
from gridline.llm.forest import Forest
from gridline.llm.tokens import pieces

#: Candidates: runs of at least 12 of these characters with a digit or of mixed case, values of telling names, and what stands behind "Bearer".
RUN = re.compile(r"[0-9][A-Za-z0-9_+/.\-]*={0,2}")
RUN_CHARACTERS = frozenset(string.ascii_letters + string.digits + "_+/.-")
RUN_LEAST = 12
#: A run without a digit has its case raised at so many places at least.
RAISED = re.compile(r"[a-z](?=[A-Z])")
RAISED_LEAST = 2
SEPARATOR = re.compile(r"[:=]+>?")
NAME_CHARACTERS = frozenset(string.ascii_letters + string.digits + "_.-")
NAMED = re.compile(r"(?i)password|passwd|passphrase|pwd|secret|token|api[_.-]?key|access[_.-]?key|private[_.-]?key|credential|bearer|auth(?!or(?:s|ed|it\w*)?$)")
VALUE = re.compile(r"\s{0,3}[\"']?(?:(?i:bearer|basic|token)\s{1,3}[\"']?)?([^\s\"',;<>()]{6,})")
BEARER = re.compile(r"(?i)(?<![a-z])bearer\s{1,3}[\"']?([^\s\"',;<>()]{6,})")
TELLING = re.compile(r"(?i)pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private")
HARMLESS = re.compile(r"(?i)commit|sha\d*|md5|checksum|hash|digest|uuid|guid|version|example|sample|placeholder|order|invoice|isbn|card|phone|rev")
UUID = re.compile(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
#: Characters of context on either side of a candidate.
AROUND = 40
#: Words of the dictionary, and labelled findings that a forest is fitted on, at most.
DICTIONARY = 20_000
#: Letters of a word of the dictionary at most, and pre-tokens that a task counts at once.
LONGEST = 48
COUNTED = 250_000
LABELLED = 20_000
THRESHOLD = 0.5
MASK = "[SECRET]"


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of runs with a digit or of mixed case."""
    for m in RUN.finditer(text):  # from the first digit of a run, and then to the left
        start, end = m.span()
        while start and text[start - 1] in RUN_CHARACTERS:
            start -= 1
        while text[start] in ".-/" and start < m.start():
            start += 1
        while text[end - 1] in ".-/":
            end -= 1
        if end - start >= RUN_LEAST:
            yield start, end
    seen = 0
    for m in RAISED.finditer(text):
        if m.start() < seen:
            continue
        start = end = m.start()
        while start and text[start - 1] in RUN_CHARACTERS:
            start -= 1
        while end < len(text) and text[end] in RUN_CHARACTERS:
            end += 1
        seen = end
        while text[start] in ".-/":
            start += 1
        while text[end - 1] in ".-/":
            end -= 1
        if end - start >= RUN_LEAST and len(RAISED.findall(text, start, end)) >= RAISED_LEAST:
            yield start, end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the values that are assigned to telling names or stand behind "Bearer"."""
    seen = 0
    for m in SEPARATOR.finditer(text):
        if m.start() < seen:  # inside a value, which goes on to the same end
            continue
        at = m.start()
        while at and m.start() - at < 3 and text[at - 1].isspace():
            at -= 1
        while at and text[at - 1] in "\"'`]":
            at -= 1
        start = at
        while start and text[start - 1] in NAME_CHARACTERS:
            start -= 1
        if NAMED.search(text[start:at]) and (v := VALUE.match(text, m.end())):
            seen = v.end()
            yield v.start(1), v.start(1) + len(v[1].rstrip("."))
    for m in BEARER.finditer(text):
        yield m.start(1), m.start(1) + len(m[1].rstrip("."))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) of a text's candidates, in order; overlapping ones are one span."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*runs(text), *assigned(text)]):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        elif b > a:
            out.append((a, b))
    return out


class Features:
    """Numbers that tell secrets from identifiers, paths, checksums and numbers.

    words is the dictionary: it tells which share of a candidate is made of
    words, and which letters usually follow each other.
    """

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        pairs = np.full((27, 27), 0.5)
        for w in sorted(self.words):
            codes = [min(max(ord(c) - 96, 0), 27) % 27 for c in w.lower()]
            for a, b in zip(codes, codes[1:]):
                pairs[a, b] += 1
        self.usual = np.log2(pairs / pairs.sum(axis=1, keepdims=True))

    def coverage(self, value: str) -> float:
        """The share of characters inside dictionary words, longest words first."""
        covered = 0
        for run in re.findall(r"[A-Za-z]{4,}", value):
            at = 0
            while at + 4 <= len(run):
                size = next((n for n in range(min(16, len(run) - at), 3, -1) if run[at : at + n].lower() in self.words), 0)
                covered, at = covered + size, at + max(size, 1)
        return covered / len(value)

    def of(self, text: str, start: int, end: int) -> list[float]:
        value, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
        kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in value]
        n, share = len(value), lambda k: kind.count(k) / len(value)
        low = value.lower()
        codes = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
        steps = [self.usual[a, b] for a, b in zip(codes, codes[1:]) if a and b]
        telling, harmless = list(TELLING.finditer(before)), list(HARMLESS.finditer(before))
        run = max(len(m[0]) for m in re.finditer(r"(.)\1*", value, re.S))
        return [
            min(n, 512), share("d"), share("u"), share("l"), share("s"),
            sum(a != b for a, b in zip(kind, kind[1:])) / max(1, n - 1),
            float(np.mean(steps)) if steps else 0.0, len(steps) / n, len(set(value)) / min(n, 64),
            float(all(c in "0123456789abcdef" for c in low)), self.coverage(value),
            value.count("/") / n, value.count(".") / n, float(bool(re.search(r"\.[A-Za-z]{2,4}$", value))),
            float(before.endswith(("://", "@", "www.", "/", "\\"))), float(bool(UUID.match(value))), float(value.isdigit()),
            1 / (1 + len(before) - telling[-1].end()) if telling else 0.0,
            1 / (1 + len(before) - harmless[-1].end()) if harmless else 0.0,
            float(before[-1:] in "\"'`" and before != "" and after[:1] in "\"'`" and after != ""),
            float(bool(re.search(r"[=:]\s*[\"'`]?$", before))), run / n,
        ]


def labelled_findings(words: list[str], n: int = 4000, seed: int = 11) -> list[tuple[str, int, int, bool]]:
    """Made-up labelled findings (text, start, end, secret), half of them secrets."""
    rng = random.Random(seed)
    words = sorted(words) or ["lorem", "ipsum", "dolor", "amet"]
    some = lambda k, chars: "".join(rng.choice(chars) for _ in range(k))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    name = lambda sep: sep.join(rng.choice(words) for _ in range(rng.randint(2, 4)))

    def secret() -> tuple[str, str, str]:
        value = rng.choice([
            lambda: some(rng.choice([32, 40, 40, 64]), hexes), lambda: some(rng.randint(20, 64), mixed), lambda: "AKIA" + some(16, string.ascii_uppercase + string.digits),
            lambda: "ghp_" + some(36, mixed), lambda: "xoxb-" + some(12, string.digits) + "-" + some(24, mixed), lambda: "sk_live_" + some(24, mixed),
            lambda: base64.b64encode(rng.randbytes(rng.randint(18, 48))).decode(), lambda: rng.choice(words) + some(rng.randint(3, 8), string.digits + "!_-") + some(3, mixed),
            lambda: some(rng.randint(20, 64), string.ascii_letters), lambda: some(rng.randint(5, 12), mixed) + rng.choice("!#$%&*?_") + some(rng.randint(3, 8), mixed),
        ])()
        if rng.random() < 0.1:
            return rng.choice(["Authorization: Bearer ", "bearer "]), value, ""
        key = rng.choice(["token", "api_key", "apiKey", "secret", "password", "passwd", "access_key", "auth", "Bearer", "client_secret", "secret_key", "aws_access_key_id"])
        quote = rng.choice(['"', '"', "'", ""])
        return f"{key}{rng.choice([' = ', '=', ': ', ' := '])}{quote}", value, quote

    def harmless() -> tuple[str, str, str]:
        return rng.choice([
            lambda: (rng.choice(["commit ", "sha1 ", "checksum: ", "md5 = ", "hash=", "rev "]), some(rng.choice([32, 40, 64]), hexes), ""),
            lambda: (rng.choice(["id=", "uuid ", "", "request "]), str(uuid.UUID(int=rng.getrandbits(128))), ""),
            lambda: (rng.choice(["", "see ", "/"]), name("/") + rng.choice(["/v1", "/2024/", "_01.py", "3.txt"]), ""),
            lambda: (rng.choice(["https://", "www.", "@", ""]), name(".") + rng.choice(["7.example.com", "2.org", "1.net"]), rng.choice(["", "/index.html"])),
            lambda: (rng.choice(["", "card ", "order ", "phone "]), some(rng.randint(12, 19), string.digits), ""),
            lambda: (rng.choice(["", "at ", "version "]), ".".join(str(rng.randint(10, 255)) for _ in range(4)), ""),
            lambda: (rng.choice(["", "call ", "def "]), name("_") + str(rng.randint(0, 99)), rng.choice(["", "()"])),
            lambda: (rng.choice(["", "on "]), f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", ":00"),
            lambda: (rng.choice(["token = ", "password: ", "api_key="]), rng.choice(["xxxxxxxxxxxxxxxx", "your_token_here_1", "changeme123456", "EXAMPLE_KEY_000000", "$" + "ENV_TOKEN_VALUE1"]), ""),
            lambda: (rng.choice(["the token: ", "password = ", "secret: ", "auth: "]), rng.choice(words) + rng.choice(words), " " + prose(2)),
            lambda: (rng.choice(["", "call ", "class ", "import "]), rng.choice(words) + "".join(rng.choice(words).capitalize() for _ in range(rng.randint(2, 4))), rng.choice(["", "()"])),
            lambda: (rng.choice(["the bearer ", "bearer "]), rng.choice(words) + rng.choice(words), " " + prose(2)),
            lambda: ("", "-".join(rng.choice(words) for _ in range(3)) + "-" + some(2, string.digits), ""),
        ])()

    out = []
    for i in range(n):
        head, value, tail = secret() if i % 2 else harmless()
        front = prose(rng.randint(0, 5))
        front += rng.choice([" ", "\n", ""]) if front else ""
        text = f"{front}{head}{value}{tail} {prose(rng.randint(0, 5))}"
        out.append((text, len(front) + len(head), len(front) + len(head) + len(value), bool(i % 2)))
    return out


class Scanner:
    """Candidates of a text with the forest's verdict."""

    def __init__(self, features: Features, forest: Forest, threshold: float = THRESHOLD):
        self.features, self.forest, self.threshold = features, forest, threshold

    def scan(self, text: str | None) -> list[tuple[int, int, float]]:
        """Spans (start, end, score) of all candidates of the whole text."""
        spans = candidates(text) if text else []
        if not spans:
            return []
        x = np.array([self.features.of(text, a, b) for a, b in spans])
        return [(a, b, float(p)) for (a, b), p in zip(spans, self.forest.predict(x), strict=True)]

    def redact(self, text: str | None, mask: str = MASK) -> str | None:
        """The text with every secret replaced by mask."""
        spans = [s for s in self.scan(text) if s[2] >= self.threshold]
        if not spans:
            return text
        parts, at = [], 0
        for a, b, _ in spans:
            parts += [text[at:a], mask]
            at = b
        return "".join([*parts, text[at:]])


def train(findings: Iterable[tuple[str, int, int, bool]], words: Iterable[str], most: int = LABELLED, seed: int = 5) -> Scanner:
    """A scanner from labelled findings (text, start, end, secret), of which a sample of most is used at most."""
    findings, features = list(findings), Features(words)
    if len(findings) > most:
        findings = random.Random(seed).sample(findings, most)
    x = np.array([features.of(t, a, b) for t, a, b, _ in findings])
    return Scanner(features, Forest(seed=seed).fit(x, np.array([float(s) for *_, s in findings])))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent plain words of all texts, of 4 to 48 letters; ties by the word.

    Words are white-space separated runs of a to z in any case. They're counted
    exactly: a task hands its counts on whenever its counter is full, and
    nothing is dropped before the sums are known.
    """

    def count(batches: Iterator[pa.RecordBatch]):
        def plain(counts: Counter) -> pa.RecordBatch:
            found = [(k, n) for k, n in counts.items() if 4 <= len(k) <= LONGEST and k.isalpha()]
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()):
                for part in pieces((data.as_py() or b"").lower()):
                    counts.update(part.split())
                    if len(counts) > COUNTED:
                        yield plain(counts)
                        counts.clear()
        yield plain(counts)

    bounded(docs.sparkSession)
    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def scanner(docs: DataFrame) -> Scanner:
    """A scanner with the corpus's own dictionary, trained on made-up findings."""
    words = dictionary(docs)
    return train(labelled_findings(words), words)


def scan(docs: DataFrame, trained: Scanner, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each candidate: keep, start, length (code points), score, secret.

    secret says whether it stays after the forest's removal of false
    positives. Null and empty texts have no candidates; repeated rows have
    theirs each. Memory is bounded by a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                found = shared.value.scan(text.as_py())
                if found:
                    at = pa.array([row] * len(found))
                    starts, ends, scores = zip(*found, strict=True)
                    columns = [pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in keep] + columns, names=[*keep, "start", "length", "score"])

    bounded(docs.sparkSession)
    schema = with_columns(docs, keep, "start long, length long, score double")
    found = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
    return found.withColumn("secret", F.col("score") >= trained.threshold)


def redact(docs: DataFrame, trained: Scanner, mask: str = MASK) -> DataFrame:
    """docs with the secrets of column text replaced by mask; nothing else changes.

    Null and empty texts stay, rows keep their number, and other columns pass
    through by place, whatever their names. Memory is bounded by a text.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(trained), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = pa.array([shared.value.redact(t.as_py(), mask) for t in batch.column(place)], pa.string())
            columns = [texts if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, scanner(docs))
