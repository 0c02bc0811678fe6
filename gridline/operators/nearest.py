"""The nearest terms of words in a large dictionary, by inverted indexes.

A pair of words of lengths n and m that reaches a ratio differs by so many
insertions and deletions at most. From 75 on the term is cut into one piece
more than that, one of which stands in the word unchanged, near its place:
pieces of terms are an index that the word's pieces probe. Below, pieces are
too short, and the index holds the rarest signs of a term, as many as can't
all be missing from the word. Either way probes are equi-joins, and lengths,
signs and a bounded Levenshtein distance come before the exact ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridline.functions import fuzzy as Z
from gridline.session import cut

#: Ratios from which pieces are long enough for an index.
PIECES = 75.0
#: The first try for lower ratios: most words have a term so near.
FIRST = 80.0
#: Frequent letters, which are looked up last. The order matters for speed only.
FREQUENT = "оеаинтсрвлкмдeaintsorl"
_EPS = 1e-9


def lengths(n: Column, least: float) -> Column:
    """Lengths that can reach a ratio with length n."""
    low, high = F.ceil(n * (least / (200 - least)) - _EPS).cast("int"), F.floor(n * ((200 - least) / least) + _EPS).cast("int")
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))


def edits(n: Column, m: Column, least: float) -> Column:
    """The most insertions and deletions between words of lengths n and m that reach a ratio; negative if none do."""
    most = F.floor((n + m) * (1 - least / 100) + _EPS).cast("int")
    return most - F.pmod(most - n - m, F.lit(2))


def _sized(rows: DataFrame, text: str, own: str, other: str, least: float) -> DataFrame:
    """rows with columns n, m, the lengths of words and terms that may meet, and d, the edits between them."""
    return rows.withColumn(own, F.char_length(text)).withColumn(other, F.explode(lengths(F.col(own), least))).withColumn("d", edits(F.col("n"), F.col("m"), least)).where("d >= 0")


def _by_pieces(words: DataFrame, terms: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    count = F.when(F.col("d") + 1 <= F.col("m"), F.col("d") + 1).otherwise(0)
    numbers = lambda: F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(-1))))
    place = lambda i: F.floor(i * F.col("m") / F.greatest(F.col("k"), F.lit(1))).cast("int")
    key = lambda piece: F.xxhash64("n", "m", "i", piece)

    def cut_up(rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("k", count).withColumn("i", numbers())
        return numbered.withColumn("a", F.when(F.col("k") > 0, place(F.col("i"))).otherwise(0)).withColumn("l", F.when(F.col("k") > 0, place(F.col("i") + 1) - place(F.col("i"))).otherwise(0))

    held = cut_up(_sized(terms, "term", "m", "n", least)).select("term", "match", "ord", key(F.substring("term", F.col("a") + 1, F.col("l"))).alias("key"))
    probing = cut_up(_sized(words, "word", "n", "m", least))
    shifts = F.when(F.col("k") > 0, F.sequence(-F.col("d"), F.col("d"))).otherwise(F.array(F.lit(0)))
    fits = lambda s: (F.col("a") + s >= 0) & (F.col("a") + s + F.col("l") <= F.col("n")) & (F.abs(s) + F.abs(F.col("n") - F.col("m") - s) <= F.col("d"))
    shifts = F.filter(shifts, lambda s: (F.col("k") == 0) | fits(s))
    pieces = F.array_distinct(F.transform(shifts, lambda s: F.substring("word", F.col("a") + 1 + s, F.col("l"))))
    return probing.withColumn("_p", F.explode(pieces)).select("word", key(F.col("_p")).alias("key")), held


def _rarest(text: str) -> Column:
    """A word's signs with their occurrence, rare ones first; the same sign has the same place in every word."""
    held = Z.signs(F.col(text))
    times = lambda c, i: F.size(F.filter(F.slice(held, F.lit(1), i + 1), lambda x: x == c))
    rank = lambda c: -F.coalesce(F.nullif(F.call_function("instr", F.lit(FREQUENT), c), F.lit(0)), F.lit(len(FREQUENT) + 1))
    return F.array_sort(F.transform(held, lambda c, i: F.struct(rank(c).alias("rank"), c.alias("sign"), times(c, i).alias("times"))))


def _by_signs(words: DataFrame, terms: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of size signs, the first size - t + 1 in one order hold a common one wherever t are common."""
    shared = F.ceil((F.col("n") + F.col("m")) * (least / 200) - _EPS).cast("int")
    key = F.xxhash64("n", "m", "_s.sign", "_s.times")

    def probes(rows: DataFrame, text: str, own: str, other: str) -> DataFrame:
        sized = _sized(rows.withColumn("_rare", _rarest(text)), text, own, other, least)
        return sized.withColumn("_s", F.explode(F.slice("_rare", F.lit(1), F.greatest(F.col(own) - shared + 1, F.lit(0)))))

    held = probes(terms, "term", "m", "n").select("term", "match", "ord", key.alias("key"))
    return probes(words, "word", "n", "m").select("word", key.alias("key")), held


def _within(words: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """word, match, score: the best term of each word with a ratio of least or more."""
    probing, held = (_by_pieces if least >= PIECES else _by_signs)(words, terms, least)
    mask = lambda c: Z.presence(Z.signs(F.col(c)))
    met = probing.withColumn("_w", mask("word")).join(held.withColumn("_t", mask("term")), "key")
    n, m = F.char_length("word"), F.char_length("term")
    hopeful = met.where(Z.may_reach(n, m, F.col("_w"), F.col("_t"), least)).select("word", "term", "match", "ord").distinct()
    near = hopeful.where(F.levenshtein("word", "term") <= edits(n, m, least))
    scored = near.withColumn("score", Z.ratio(F.col("word"), F.col("term"))).where(F.col("score") >= least)
    return scored.groupBy("word").agg(F.max_by("match", F.struct("score", -F.col("ord"))).alias("match"), F.max("score").alias("score"))


def nearest(words: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """word, match, score: for each distinct word the term (term, match, ord) of the best ratio >= least.

    Ties go to the lower ord; null words and terms take no part, nor do empty
    ones. A word that has a term at 80 or more is done by the index of pieces;
    only others look lower. Terms are never compared with all words, whatever
    the size of either.
    """
    distinct = words.select("word").where("word <> ''").distinct()
    terms = terms.select("term", "match", "ord").where("term <> ''")
    if least >= PIECES:
        return _within(distinct, terms, least)
    distinct = cut(distinct)
    close = cut(_within(distinct, terms, FIRST))
    return close.unionByName(_within(distinct.join(close, "word", "left_anti"), terms, least))
