"""Inflected words by paradigms: stems of classes, and the endings of each class.

A morphology is two relations, stems(stem, class, lemma) and endings(class,
ending); a word belongs to it if it's a stem and an ending of the stem's class.
Words are cut at every place where an ending of any class may begin, and the
cuts meet stems by an equi-join, so that no list of all forms is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_forms(stems: DataFrame, endings: DataFrame) -> DataFrame:
    """word, lemma: all forms of all stems, in lower case, each once."""
    joined = stems.where("stem IS NOT NULL").join(endings.where("ending IS NOT NULL"), "class")
    return joined.select(F.lower(F.concat("stem", "ending")).alias("word"), F.lower("lemma").alias("lemma")).distinct()


def analysed(words: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """word, lemma, class, ending of each distinct word of words(word) that is a form of a stem.

    Of several analyses that with the longest ending counts, then the lemma and
    class that come first. Words are compared in lower case and returned as
    they are; null words and words outside the morphology have no row. Endings
    are a short list by class, of which only the distinct ones and their
    lengths meet the words; cuts whose end is no ending are gone before the
    join with the stems.
    """
    known = endings.where("ending IS NOT NULL").select("class", F.lower("ending").alias("ending")).distinct()
    sizes = F.broadcast(known.agg(F.coalesce(F.max(F.char_length("ending")), F.lit(-1)).alias("_most")))  # one row
    low = words.select("word").where("word IS NOT NULL").distinct().crossJoin(sizes).withColumn("_low", F.lower("word"))
    most = F.least(F.col("_most"), F.char_length("_low"))
    cuts = low.withColumn("_n", F.explode(F.when(most >= 0, F.sequence(F.lit(0), F.greatest(most, F.lit(0)))).otherwise(F.array().cast("array<int>"))))
    cuts = cuts.select("word", F.expr("substring(_low, 1, char_length(_low) - _n)").alias("stem"), F.expr("right(_low, _n)").alias("ending"))
    classed = cuts.join(known, "ending")
    found = classed.join(stems.where("stem IS NOT NULL").select(F.lower("stem").alias("stem"), "class", F.lower("lemma").alias("lemma")), ["stem", "class"])
    best = F.min(F.struct((-F.char_length("ending")).alias("n"), F.col("lemma"), F.col("class").alias("class"), F.col("ending")))
    return found.groupBy("word").agg(best.alias("_b")).select("word", "_b.lemma", "_b.class", "_b.ending")


def unknown(words: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """The distinct words (word) that the morphology doesn't know."""
    return words.select("word").where("word IS NOT NULL").distinct().join(analysed(words, stems, endings).select("word"), "word", "left_anti")


def with_forms(lexicon: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """lexicon(word, ord) and behind it all forms that it hasn't, in alphabetical order by a sparse number."""
    have = lexicon.select(F.lower("word").alias("word"), "ord")
    last = have.agg(F.coalesce(F.max("ord"), F.lit(-1)).cast("long").alias("_last"))  # one row
    more = word_forms(stems, endings).select("word").distinct().join(have.select("word"), "word", "left_anti")
    ranked = more.orderBy("word").withColumn("_i", F.monotonically_increasing_id())
    return have.select("word", F.col("ord").cast("long").alias("ord")).unionByName(ranked.crossJoin(F.broadcast(last)).select("word", (F.col("_last") + 1 + F.col("_i")).alias("ord")))
