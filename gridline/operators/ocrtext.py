"""Repair of recognised text: tokens in context, look-alikes, fuzzy dictionaries.

Cells are split into tokens, distinct words are looked up (equi-joins first,
fuzzy scores only for what is left), and tokens are joined again. A morphology
is pluggable as a lexicon relation; without one the domain terms are it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions import fuzzy as Z
from gridline.functions import mojibake
from gridline.functions import text as X
from gridline.model import BRANDS, DOMAIN_TERMS
from gridline.operators import inflect
from gridline.operators.nearest import nearest
from gridline.session import cut, spread

BRAND_SCORE, DOMAIN_SCORE, LEXICON_SCORE = 75.0, 70.0, 60.0


#: Lexicons of so many words are literals of the plan; larger ones are relations with an index.
TERM_ROWS = 200


def brands(spark: SparkSession, names: list[str] = BRANDS) -> DataFrame:
    return spark.createDataFrame([(v, b, i) for i, (v, b) in enumerate(X.brand_variants(names))], "term string, match string, ord long")


def terms(spark: SparkSession, words: list[str] = DOMAIN_TERMS) -> DataFrame:
    return spark.createDataFrame([(w, w, i) for i, w in enumerate(words)], "term string, match string, ord long")


def tokens(cells: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, token, kind, near_number: every token with its type and whether one of two on each side is a number.

    Neighbours are looked up in an array that tells a text's numbers; no token
    is shuffled, and types are told of exploded tokens, in generated code.
    """
    held = cells.select(*keys, X.tokens(F.col(text)).alias("_t")).withColumn("_n", F.transform("_t", X.is_numeric))
    numeric = lambda i: F.coalesce(F.get("_n", i), F.lit(False))
    near = lambda i: numeric(i - 2) | numeric(i - 1) | numeric(i + 1) | numeric(i + 2)
    told = F.transform("_t", lambda t, i: F.struct(t.alias("token"), near(i).alias("near_number")))
    each = held.select(*keys, F.posexplode_outer(told).alias("pos", "_t")).where("pos IS NOT NULL")  # the inner one copies its whole input into a filter
    return each.select(*keys, "pos", "_t.token", X.token_type(F.col("_t.token")).alias("kind"), "_t.near_number")


def corrected(tokens: DataFrame, lexicon: list[str] | DataFrame, domain: list[str] = DOMAIN_TERMS, names: list[str] = BRANDS) -> DataFrame:
    """tokens with column fixed.

    Technical tokens of mixed script become Latin; numbers, signs and spaces
    stay. Mixed words become Cyrillic; Latin ones away from numbers are brands,
    exactly or at 75, or become Cyrillic, where Latin r may be two letters.
    Cyrillic words outside the lexicon become the nearest term (domain at 70,
    lexicon at 60); case is restored. A lexicon of few words is a list, a
    literal of the plan; a larger one is a relation (word, ord), whose index is
    joined to the distinct words. Nothing here runs in Python.
    """
    t = F.col("token")
    latin, cyrillic = t.rlike("[A-Za-z]"), t.rlike("[А-Яа-я]")
    is_word = F.col("kind") == "word"
    alone = is_word & latin & ~cyrillic & ~F.col("near_number")
    branded = tokens.withColumn("brand", brand_match(F.when(alone, X.brand_key(t)), names))
    changed = F.col("brand").isNull() & is_word & latin & (cyrillic | ~F.col("near_number"))
    unsure = F.when(changed & F.contains(t, F.lit("r")), t)
    if isinstance(lexicon, DataFrame):
        spark, tokens = tokens.sparkSession, cut(tokens)
        own = terms(spark, domain)
        known = lexicon.select(F.lower("word").alias("word")).unionByName(own.select(F.col("term").alias("word"))).distinct()
        ordered = lexicon.select(F.lower("word").alias("term"), F.lower("word").alias("match"), "ord")
        read = readings(branded.select(unsure.alias("token")).where("token IS NOT NULL").distinct(), known, own, ordered)
        words = branded.withColumn("_unsure", unsure).join(read.withColumnRenamed("token", "_unsure"), "_unsure", "left").drop("_unsure")
    else:
        words = branded.withColumn("reading", best_reading(F.when(unsure.isNotNull(), ambiguous(t)), domain, lexicon))
    words = words.withColumn("_cyr", F.when(changed, F.coalesce("reading", X.to_cyrillic(t))).when(F.col("brand").isNull() & is_word, t))
    words = words.withColumn("_low", F.when(F.col("_cyr").rlike("[А-Яа-я]"), F.lower("_cyr")))
    if isinstance(lexicon, DataFrame):
        fix = close_terms(words.select(F.col("_low").alias("word")).where("word is not null").distinct().join(known, "word", "left_anti"), own, ordered)
        fixed = words.join(fix.select(F.col("word").alias("_low"), F.col("match").alias("_fix")), "_low", "left")
    else:
        fixed = words.withColumn("_fix", fixed_word(F.col("_low"), domain, lexicon))
    cased = X.like_case(F.coalesce("_fix", "_low"), t)
    mixed = (F.col("kind") == "technical") & latin & cyrillic
    out = F.when(mixed, X.to_latin(t)).when(F.col("brand").isNotNull(), F.col("brand")).when(F.col("_low").isNotNull(), cased).otherwise(F.coalesce("_cyr", "token"))
    return fixed.withColumn("fixed", out).drop("reading", "_cyr", "_low", "_fix", "brand")


def brand_match(key: Column, names: list[str] = BRANDS) -> Column:
    """The brand of a brand key, exactly or at 75; null without one."""
    variants = X.brand_variants(names)
    exact = Z.constant(dict(variants), "map<string,string>")
    return F.when(key.isNotNull(), F.coalesce(F.try_element_at(exact, key), Z.best_of(key, variants, BRAND_SCORE)["match"]))


def closest(word: Column, domain: list[str], lexicon: list[str]) -> Column:
    """struct<score, match>: the nearest domain term at 70, else the nearest of the lexicon at 60, else null."""
    own = [(w, w) for w in domain]
    low = [(w.lower(), w.lower()) for w in lexicon]
    return F.coalesce(Z.best_of(word, own, DOMAIN_SCORE), Z.best_of(word, low, LEXICON_SCORE))


def is_known(word: Column, domain: list[str], lexicon: list[str]) -> Column:
    return word.isin([*domain, *(w.lower() for w in lexicon)])


def fixed_word(word: Column, domain: list[str], lexicon: list[str]) -> Column:
    """The nearest term of an unknown lower-case word; null for known ones and for those far from all."""
    return F.when(~is_known(word, domain, lexicon), closest(word, domain, lexicon)["match"])


def best_reading(readings: Column, domain: list[str], lexicon: list[str]) -> Column:
    """Of an array of readings the first known one, else the one nearest to a term, else the first; null for none."""
    rank = lambda r: F.when(is_known(F.lower(r), domain, lexicon), 1000.0).otherwise(F.coalesce(closest(F.lower(r), domain, lexicon)["score"], F.lit(0.0)))
    ranked = F.transform(readings, lambda r, i: F.struct(rank(r).alias("rank"), (-i).alias("place"), r.alias("reading")))
    return F.array_max(ranked)["reading"]


def close_terms(words: DataFrame, domain: DataFrame, ordered: DataFrame) -> DataFrame:
    """word, match, score: the nearest domain term at 70, else the nearest of the lexicon at 60."""
    near = nearest(words, domain, DOMAIN_SCORE)
    return near.unionByName(nearest(words.join(near, "word", "left_anti"), ordered, LEXICON_SCORE))


def readings(words: DataFrame, known: DataFrame, domain: DataFrame, ordered: DataFrame) -> DataFrame:
    """token, reading of distinct words(token) with Latin r.

    The first known reading counts; without one, that nearest to a term, and of
    equally near ones the first.
    """
    read = words.select("token", F.posexplode(ambiguous(F.col("token"))).alias("place", "reading")).withColumn("word", F.lower("reading"))
    sure = known.withColumn("_known", F.lit(True))
    told = read.join(sure, "word", "left").join(close_terms(read.select("word").distinct().join(known, "word", "left_anti"), domain, ordered).select("word", "score"), "word", "left")
    rank = F.struct(F.coalesce("_known", F.lit(False)).alias("known"), F.when(F.col("_known").isNull(), F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"), (-F.col("place")).alias("place"))
    return told.groupBy("token").agg(F.max_by("reading", rank).alias("reading"))


def joined(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the fixed tokens in order, after the last pass."""
    parts = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "fixed"))).alias("_p"))
    return parts.select(*keys, X.ocr_finish(F.array_join(F.transform("_p", lambda p: p["fixed"]), "")).alias("text"))


def repaired(cells: DataFrame, keys: list[str], lexicon: DataFrame | None = None, paradigms: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """keys, text of every cell after all passes; blank and null cells are untouched.

    Texts read with a wrong table are read anew (mojibake.repaired). Brands are spelled out before the tokens are corrected, and again behind
    that, for a token may have been a part of one. lexicon(word, ord) is a
    literal if it's counted to be short. paradigms are stems and endings
    (inflect): their forms are known words and terms behind the lexicon's.
    Each distinct text is repaired once, and all of them are dealt to all cores.
    """
    known: list[str] | DataFrame = list(DOMAIN_TERMS)
    if paradigms is not None:
        own = cells.sparkSession.createDataFrame([(w, i) for i, w in enumerate(DOMAIN_TERMS)], "word string, ord long")
        lexicon = cut(inflect.with_forms(own if lexicon is None else lexicon, *paradigms))
    if lexicon is not None:
        rows = lexicon.orderBy("ord").limit(TERM_ROWS + 1).collect()
        known = [r["word"] for r in rows] if len(rows) <= TERM_ROWS else lexicon
    blank = F.coalesce(X.strip(F.col("text")), F.lit("")) == ""
    texts = spread(cells.where(~blank).select(F.col("text").alias("_text")).distinct(), "_text")
    signs = canonical_brands(texts.select("_text", X.ocr_signs(mojibake.repaired(F.col("_text"))).alias("text")), ["_text"])
    clean = signs.select("_text", X.ocr_words(F.col("text")).alias("text"))
    done = canonical_brands(joined(corrected(tokens(clean, ["_text"]), known), ["_text"]), ["_text"])
    fixed = cells.where(~blank).select(*keys, F.col("text").alias("_text")).join(done, "_text").select(*keys, "text")
    return cells.where(blank).select(*keys, "text").unionByName(fixed)


def ambiguous(word: Column) -> Column:
    """Readings of a word with Latin r: as г, or one of them as т."""
    plain = X.to_cyrillic(word)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.substring(word, i, F.lit(1)) == "r")
    other = F.transform(places, lambda i: F.concat(F.substring(plain, F.lit(1), i - 1), F.lit("т"), F.substring(plain, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(plain), other))


def canonical_brands(cells: DataFrame, keys: list[str], names: list[str] = BRANDS) -> DataFrame:
    """keys, text: cells whose capitalised words are known brands in their usual spelling.

    A word begins with a capital at a word's start and ends at a word's end.
    Words are looked up exactly, then at a ratio of 75; a found brand stands
    between single spaces, none before punctuation. Null and empty cells stay.
    A projection: cells aren't shuffled.
    """
    # fixed values: how apostrophes, words and punctuation are told
    apostrophes = F.regexp_replace("text", "([A-ZА-Я][a-zA-Zа-яА-Я]*)['’`ʹ]", "$1'")
    parts = F.regexp_extract_all(apostrophes, F.lit(r"[A-ZА-Я][a-zA-Zа-яА-Я'\-]*|[^A-ZА-Я]+"), 0)

    def key(part: Column, i: Column) -> Column:
        begins = ~F.coalesce(F.get("_w", i - 1).rlike(r"[\p{L}\p{N}_]$"), F.lit(False))
        inside = F.coalesce(F.get("_w", i + 1).rlike(r"^[\p{L}\p{N}_]"), F.lit(False))
        return F.when(part.rlike("^[A-ZА-Я]") & begins & (part.rlike(r"\p{L}$") != inside), X.brand_key(part))

    held = cells.select(*keys, "text", parts.alias("_w")).withColumn("_m", F.transform(F.transform("_w", key), lambda k: brand_match(k, names)))
    text = F.array_join(F.zip_with("_w", "_m", lambda w, m: F.coalesce(F.concat(F.lit(" "), m, F.lit(" ")), w)), "")
    done = F.trim(X.replace_all(text, [(r"(?U)\s+", " "), (r"\s+([.,;!?:])", "$1")]))
    return held.select(*keys, F.when(F.coalesce("text", F.lit("")) == "", F.col("text")).otherwise(done).alias("text"))
