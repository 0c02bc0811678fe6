"""Near-duplicates by SimHash, found with an index of byte positions.

A 64-bit fingerprint has 8 bytes at 8 positions. Two fingerprints at most 2
bits apart share at least 6 of them, so a pair counts if its tally of shared
positional bytes reaches 6. Posting lists of single bytes would hold 1/256 of
all fingerprints, and tallying their pairs would grow with the square of the
corpus. The index is therefore kept over the 28 choices of 6 positions: a pair
is in a list together exactly if its tally reaches 6. A list holds
fingerprints that differ in 16 bits only, 65,536 at most, and is searched by
flipping bits, without comparing all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import bounded, cut, table, with_columns
from gridline.llm.graph import components

WORDS = 3
SEED = 42
#: Hashes counted at once.
STEP = 1 << 16
#: Lists up to this size are compared directly.
DIRECT = 48
#: Bits of each byte value, the highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_FLIPS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)])
#: The positions of the two bytes left out of a key.
_LEFT_OUT = list(combinations(range(8), 2))


def shingles(data: bytes, words: int = WORDS, seed: int = SEED) -> bytes:
    """XXH64 digests (8 bytes each, big-endian) of all word shingles of a text.

    A-Z is lowered; words lie between space and U+0009 to U+000D. A shorter
    text is one shingle, a text without words has none.
    """
    split = data.lower().split()
    if not split:
        return b""
    joined = b" ".join(split)
    digest = xxhash.xxh64_digest
    if len(split) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(split) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    return b"".join([digest(joined[a:b], seed) for a, b in spans])


def fingerprint(digests: bytes) -> int:
    """The bits set in over half the digests, as a signed 64-bit number."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.zeros((8, 256), np.int64)
    for lo in range(0, len(rows), STEP):
        codes = rows[lo : lo + STEP].astype(np.int64) + np.arange(8) * 256
        counts += np.bincount(codes.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BITS) > len(rows)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and fp long of every row of docs; null texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingles(x.as_py() or b"", words)) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(fps, pa.int64())], names=[*keep, "fp"])

    bounded(docs.sparkSession)
    schema = with_columns(docs, keep, "fp long")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def near(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct 64-bit values that differ in 16 bits only: each and the least value it reaches.

    Steps are of 1 or 2 bits. Values that reach none smaller are left out.
    """
    n = len(values)
    if n <= DIRECT:
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        linked = apart <= 2
        label = np.arange(n)
        while True:
            new = np.where(linked, label[None, :], n).min(axis=1)
            if (new == label).all():
                break
            label = new
    else:
        varied = np.bitwise_or.reduce(values ^ values[0])
        places = [i for i in range(64) if int(varied) >> i & 1]
        small = np.zeros(n, np.int64)
        for k, i in enumerate(places):
            small |= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k
        at = np.full(1 << 16, -1)
        at[small] = np.arange(n)
        label = np.arange(n)
        while True:
            old = label.copy()
            for flip in _FLIPS:
                other = at[small ^ flip]
                there = other >= 0
                label[there] = np.minimum(label[there], label[other[there]])
            if (old == label).all():
                break
    moved = np.flatnonzero(label != np.arange(n))
    return values[moved], values[label[moved]]


def links(prints: DataFrame) -> DataFrame:
    """Edges a, b (long) that connect all distinct fingerprints fp at most 2 bits apart.

    28 keys of 48 bits for each fingerprint are dealt by key and sorted inside
    the partitions; lists are read from the sorted stream, one at a time.
    """
    keys = []
    for number, out in enumerate(_LEFT_OUT):
        key = F.lit(number).cast("long")
        for byte in range(8):
            if byte not in out:
                part = F.shiftrightunsigned("fp", 8 * (7 - byte)).bitwiseAND(F.lit(255))
                key = F.shiftleft(key, 8).bitwiseOR(part)
        keys.append(key)
    posted = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    posted = posted.repartition(F.col("key")).sortWithinPartitions("key")

    def connect(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def lists(keys, fps):
            firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([firsts, [len(keys)]]))
            two = firsts[sizes == 2]
            close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= 2]
            pairs = [(fps[close], fps[close + 1])] + [near(np.sort(fps[i : i + n])) for i, n in zip(firsts[sizes > 2], sizes[sizes > 2], strict=True)]
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
            if whole:
                yield lists(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield lists(keys, fps)

    return posted.select("key", "fp").mapInArrow(connect, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id it reaches.

    Texts with one fingerprint are one class, so copies are never paired;
    classes are linked at 2 bits or fewer. Empty and null texts have
    fingerprint 0 and are linked like any other. Null doc_ids keep their rows
    and are ignored as component_id (null where a component has no other).
    Repeated rows stay. Other columns are ignored; an empty table gives an
    empty one.
    """
    prints = cut(fingerprints(docs, words))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
