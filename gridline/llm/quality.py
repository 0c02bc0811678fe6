"""Quality rules with adaptive thresholds per language and source.

Base measures come from each text alone. The thresholds come from quantile
sketches: counts over cells of four ratios. Such sketches merge by adding
counts, in any order, with the same result each time. A group's fence lies
three times as far beyond its 90th percentile as that lies beyond its median,
a lower fence alike below the 10th; documents beyond a fence are dropped by a
join. No fence has a fixed part: where nearly all of a group have none of what
is counted, the fence is 0, and what one text may hold by chance comes on top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridline.llm.common import SPACES, cut, small, table, words

#: A group's fences count as if so many rows stood at those of the level above it.
PRIOR_ROWS = 200
#: Ratios are counted in thousandths. Cells hold one each up to 1024; beyond, each doubling has 512 cells.
SCALE = 1000
EXACT_BITS = 10
#: Percentiles of a sketch, how many times the distance from the middle one a fence lies beyond an outer one, and the standard deviations of a count that chance may add.
LOW, MIDDLE, HIGH = 10, 50, 90
RANGES = 3
CHANCE = 3
#: Measure: (numerator, denominator, counts something per text rather than averaging it).
MEASURES = {
    "word_length": ("word_chars", "n_words", False),
    "symbols": ("n_symbols", "word_chars", True),
    "dup_lines": ("n_dup_lines", "n_lines", True),
    "repeats": ("n_repeat_words", "n_words", True),
}


def repeated_words(words: Column, windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    windows are 64-bit hashes of the windows. Texts whose hashes are all
    distinct have none. In others, window positions are packed behind the high
    bits of their hash and sorted as plain numbers; windows with an equal
    neighbour are candidates, and those are compared word by word, so that
    equal hashes of different words don't count. All steps are sorts or single
    passes over one text.
    """
    position = F.lit((1 << 28) - 1)
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~((1 << 28) - 1))).bitwiseOR(i.cast("long"))))

    def near(packed: Column) -> Column:
        high = lambda i: F.shiftright(F.get(packed, i), 28)
        pairs = F.filter(packed, lambda p, i: (high(i - 1) == F.shiftright(p, 28)) | (high(i + 1) == F.shiftright(p, 28)))
        return F.transform(pairs, lambda p: p.bitwiseAND(position).cast("int"))

    def exact(at: Column) -> Column:
        full = F.sort_array(F.transform(at, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
        return full

    def same(full: Column) -> Column:
        def equal(x: Column, y: Column) -> Column:
            return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        kept = F.filter(full, lambda x, i: F.coalesce(equal(F.get(full, i - 1), x), F.lit(False)) | F.coalesce(equal(F.get(full, i + 1), x), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        new = F.transform(at, lambda p, i: F.least(F.coalesce(p - F.get(at, i - 1), F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(new, F.lit(0).cast("long"), lambda x, y: x + y)

    def let(value: Column, body) -> Column:
        """body(value), with value computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    found = let(packed, lambda p: let(near(p), lambda at: let(exact(at), lambda full: let(same(full), covered))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep and the base measures of every row; a null text has no words.

    One pass over the texts without a shuffle; nothing is larger than a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*keep, text.alias("_text"), words(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    windows = F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    split = split.withColumn("_windows", windows).withColumn("_lines", lines)
    return split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), F.col("_windows")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(measure: str) -> Column:
    """A row's ratio in thousandths; 0 where it has no denominator."""
    over, under, _ = MEASURES[measure]
    return F.when(F.col(under) > 0, F.floor(F.col(over) * SCALE / F.col(under))).otherwise(0).cast("long")


def cell(value: Column) -> Column:
    """The least value of the cell that holds a value: its highest ten bits. No value is cut off."""
    extra = F.greatest(F.length(F.bin(value)) - EXACT_BITS, F.lit(0))
    width = F.pow(F.lit(2.0), extra).cast("long")
    return (value - value % width).cast("long")


def fences(rows: DataFrame) -> DataFrame:
    """lang, source, and struct fence of the low and high fence of each measure, from merged sketches.

    The fences of a language and source are drawn to those of the language,
    and these to those of all rows, as if 200 rows more stood there; so a
    verdict changes smoothly as a group grows. All tables after the first
    aggregation hold counted cells, some thousands for each group.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), cell(ratio(m)).alias("cell")) for m in MEASURES]))
    sketch = cut(rows.select("lang", "source", cells.alias("_c")).groupBy("lang", "source", "_c.measure", "_c.cell").agg(F.count(F.lit(1)).alias("n")))

    def level(*keys: str) -> DataFrame:
        """keys and, for each measure, rows and fences of its own."""
        group = [*keys, "measure"]
        merged = sketch.groupBy(*group, "cell").agg(F.sum("n").alias("n"))
        ranked = merged.withColumn("_upto", F.sum("n").over(Window.partitionBy(*group).orderBy("cell"))).withColumn("_all", F.sum("n").over(Window.partitionBy(*group)))
        at = lambda q: F.min(F.when(100 * F.col("_upto") >= q * F.col("_all"), F.col("cell")))
        found = ranked.groupBy(*group).agg(at(LOW).alias("_l"), at(MIDDLE).alias("_m"), at(HIGH).alias("_h"), F.max("_all").alias("rows"))
        low, high = F.col("_l") - RANGES * (F.col("_m") - F.col("_l")), F.col("_h") + RANGES * (F.col("_h") - F.col("_m"))
        return found.select(*group, "rows", low.cast("double").alias("low"), high.cast("double").alias("high"))

    def drawn(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        """own with its fences drawn to those of above, which it shares keys and measure with."""
        other = above.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "measure"]], F.col("low").alias("_low"), F.col("high").alias("_high"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "measure"]])
        mean = lambda x: ((F.col("rows") * F.col(x) + PRIOR_ROWS * F.col(f"_{x}")) / (F.col("rows") + PRIOR_ROWS)).alias(x)
        return own.join(other, on).select(*[c for c in own.columns if c not in ("low", "high")], mean("low"), mean("high"))

    languages = drawn(level("lang"), level(), [])
    groups = drawn(level("lang", "source"), languages, ["lang"])
    picked = [F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{m}_{x}") for m in MEASURES for x in ("low", "high")]
    names = [f"{m}_{x}" for m in MEASURES for x in ("low", "high")]
    return groups.groupBy("lang", "source").agg(*picked).select("lang", "source", F.struct(*names).alias("fence"))


def inside(measure: str, fence: Column) -> Column:
    """Whether a row lies inside the fences of a measure.

    What is counted in a text may exceed its expected number at the fence by
    three standard deviations, so that a single sign or line never decides.
    """
    over, under, counts = MEASURES[measure]
    high = fence[f"{measure}_high"]
    if not counts:
        return (ratio(measure) <= high) & (ratio(measure) >= fence[f"{measure}_low"])
    expected = high * F.col(under) / SCALE
    return F.col(over) <= expected + CHANCE * F.sqrt(expected + 1)


def judge(measured: DataFrame) -> DataFrame:
    """measured with base_failed and kept: inside the fences of its language and source.

    The sketches hold the rows that pass the base rules. Null language and
    source are values like any other. Repeated rows count as often as they
    stand; an empty table gives an empty one.
    """
    based = measured.withColumn("base_failed", base_failed())
    table = fences(based.where(~F.col("base_failed"))).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("fence").alias("_fence"))
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = based.join(small(cut(table)), on, "left")
    kept = ~F.col("base_failed") & reduce(lambda a, b: a & b, [inside(m, F.col("_fence")) for m in MEASURES])
    return joined.withColumn("kept", F.coalesce(kept, F.lit(False))).select(*based.columns, "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(cut(measures(table(spark, sf_dir, "documents"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), hit AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END,
          CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END] AS v
  FROM m
), c AS (
  SELECT lang, source, i, CASE WHEN v[i] < 1024 THEN v[i] ELSE (v[i] >> (length(bin(v[i])) - 10)) << (length(bin(v[i])) - 10) END AS c
  FROM r, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE NOT base_failed
), q AS (
  SELECT level, lang, source, i, count(*) AS n, list_sort(list(c)) AS s
  FROM (SELECT 2 AS level, lang, source, i, c FROM c UNION ALL SELECT 1, lang, NULL, i, c FROM c UNION ALL SELECT 0, NULL, NULL, i, c FROM c)
  GROUP BY level, lang, source, i
), g AS (
  SELECT level, lang, source, i, n, CAST(4 * s[(10 * n + 99) // 100] - 3 * s[(50 * n + 99) // 100] AS DOUBLE) AS low, CAST(4 * s[(90 * n + 99) // 100] - 3 * s[(50 * n + 99) // 100] AS DOUBLE) AS high FROM q
), l AS (
  SELECT x.lang, x.i, (x.n * x.low + 200 * y.low) / (x.n + 200) AS low, (x.n * x.high + 200 * y.high) / (x.n + 200) AS high
  FROM g x JOIN g y ON x.level = 1 AND y.level = 0 AND x.i = y.i
), f AS (
  SELECT x.lang, x.source, max(CASE WHEN x.i = 1 THEN (x.n * x.low + 200 * l.low) / (x.n + 200) END) AS low1,
         [max(CASE WHEN x.i = 1 THEN (x.n * x.high + 200 * l.high) / (x.n + 200) END), max(CASE WHEN x.i = 2 THEN (x.n * x.high + 200 * l.high) / (x.n + 200) END),
          max(CASE WHEN x.i = 3 THEN (x.n * x.high + 200 * l.high) / (x.n + 200) END), max(CASE WHEN x.i = 4 THEN (x.n * x.high + 200 * l.high) / (x.n + 200) END)] AS h
  FROM g x JOIN l ON x.level = 2 AND x.i = l.i AND x.lang IS NOT DISTINCT FROM l.lang GROUP BY x.lang, x.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND v[1] >= low1 AND v[1] <= h[1] AND n_symbols <= h[2] * word_chars / 1000 + 3 * sqrt(h[2] * word_chars / 1000 + 1)
         AND n_dup_lines <= h[3] * n_lines / 1000 + 3 * sqrt(h[3] * n_lines / 1000 + 1) AND n_repeat_words <= h[4] * n_words / 1000 + 3 * sqrt(h[4] * n_words / 1000 + 1), false) AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
