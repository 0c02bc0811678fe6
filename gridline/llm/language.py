"""Language identification by rank-order profiles of n-grams."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridline.llm.common import bounded, cut, small, table, with_columns

#: N-grams in a profile; a missing one is this far out of place.
RANKS = 300
#: Learning documents of one language: about so many, drawn by a hash of doc_id.
LEARN_DOCS = 4000
#: Characters handled at once.
STEP = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text's words as numbers, and their counts.

    Words are runs of letters in lower case with a mark (0) on both sides; an
    n-gram is n code points plus one, 21 bits each, and doesn't span words.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[np.minimum(codes, 0x10FFFF)], codes, 0)
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([[0], codes, [0, 0]]).astype(np.int64)
    inside = (codes[:-1] != 0) | (codes[1:] != 0)
    codes = np.concatenate([codes[:-1][inside], [0, 0]])
    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for lo in range(0, len(codes) - 2, STEP):
        c = codes[lo : min(lo + STEP, len(codes) - 2) + 2]
        a, b, d = c[:-2], c[1:-1], c[2:]
        one = (a + 1)[a != 0]
        two = ((a + 1) << 21 | (b + 1))[(a != 0) | (b != 0)]
        three = ((a + 1) << 42 | (b + 1) << 21 | (d + 1))[b != 0]
        new, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if len(found):
            found, back = np.unique(np.concatenate([found, new]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n])).astype(np.int64)
        else:
            found, counts = new, n
    return found, counts


def ranked(found: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams by falling count, ties by number."""
    if len(found) > 4 * ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))][:ranks]


class Profiles:
    """Language profiles, and the out-of-place distance of a text to each."""

    def __init__(self, profiles: dict[str, np.ndarray], ranks: int = RANKS):
        self.ranks, self.names = ranks, sorted(profiles)
        self.sorted = [(np.sort(p), np.argsort(p)) for p in (profiles[n] for n in self.names)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 - distance / largest distance."""
        own = ranked(*grams(text), self.ranks) if text else np.empty(0, np.int64)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        far = []
        for values, order in self.sorted:
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            away = np.where(values[at] == own, np.abs(order[at] - place), self.ranks)
            far.append(int(np.minimum(away, self.ranks).sum()))
        best = int(np.argmin(far))
        return self.names[best], 1.0 - far[best] / (self.ranks * len(own))


def held_out(doc_id: str = "doc_id"):
    """True for the documents that nothing is learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, ranks: int = RANKS, learn_docs: int = LEARN_DOCS) -> Profiles:
    """Profiles of the values of lang, from text and lang of documents that aren't held out.

    A language with more than learn_docs documents is learned from a share of
    them, drawn by a hash of doc_id, of expected size learn_docs; the others
    from all. Shares are a row per language, so texts are drawn where they're
    read. The driver gets ranks rows for each language. Equally frequent n-grams
    rank by their code points, so profiles don't depend on partitions; a row
    that stands n times counts n times; null texts teach nothing, and a
    language whose texts have no letter has no profile. Texts are counted in
    steps of a million characters. Other columns are ignored, whatever their
    names; without usable rows there are no profiles.
    """
    usable = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    share = usable.groupBy(F.col("lang").alias("_lang")).agg(F.least(F.lit(1.0), learn_docs / F.count(F.lit(1))).alias("_share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("learn"), "doc_id"), 11) * F.lit(2.0**-53)
    drawn = usable.join(small(cut(share)), F.col("lang") == F.col("_lang")).where((draw < F.col("_share")) & F.col("text").isNotNull()).select("lang", "text")

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = total.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in grams(text.as_py())), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])

    bounded(docs.sparkSession)
    counted = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for row in counted.withColumn("place", place).where(F.col("place") <= ranks).orderBy("lang", "place").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return Profiles({k: np.array(v, np.int64) for k, v in profiles.items()}, ranks)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score of every row, from column text alone.

    Null texts and texts without a letter are `und` with score 0, and so is
    every text where no language was learned. Of languages at one distance the
    first by name counts. Every row is told by its own text, repeated ones
    alike; memory is bounded by a text. keep must not name lang_pred or score;
    an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            pairs = [profiles.predict(t.as_py()) for t in batch.column("text")]
            found = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + found, names=[*keep, "lang_pred", "score"])

    bounded(docs.sparkSession)
    schema = with_columns(docs, keep, "lang_pred string, score double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned on those not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
