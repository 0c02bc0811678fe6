"""Operators on tables of text cells.

Tables are relations of rows (keys, row_idx, cells array<string>) or of cells
(keys, row_idx, col_idx, text); order is data. keys name one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridline.functions import text as X
from gridline.model import HEADER_ANCHORS

HEADER_ROWS = 20
# Fixed values. Cells that table readers take for missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
LEAST_GROUPS = 2
#: Hits that select a table by its first row.
SELECTED = 3


def anchor_score(text: Column, anchors: dict[str, list[str]] = HEADER_ANCHORS) -> Column:
    """Anchor groups of which a variant is inside the text."""
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]).cast("int")
    return reduce(lambda a, b: a + b, [hit(words) for words in anchors.values()])


def header_index(lines: Column, anchors: dict[str, list[str]] = HEADER_ANCHORS, least: int = LEAST_GROUPS, first: int = HEADER_ROWS) -> Column:
    """Index of the first line of the highest score among the first lines; null below least.

    lines is an array in one row, so that finding a header needs no shuffle.
    """
    plain = F.transform(F.slice(lines, 1, first), lambda t: X.normalize(F.coalesce(t, F.lit(""))))
    scores = F.transform(plain, lambda t: anchor_score(t, anchors))
    # bound as a variable, so that lines are scored once
    return F.get(F.transform(F.array(scores), lambda s: F.when(F.array_max(s) >= least, F.array_position(s, F.array_max(s)) - 1)), F.lit(0)).cast("int")


def header_rows(rows: DataFrame, keys: list[str], anchors: dict[str, list[str]] = HEADER_ANCHORS, least: int = LEAST_GROUPS, first: int = HEADER_ROWS) -> DataFrame:
    """keys, header_idx, score of every table of rows with an array of cells.

    A partial aggregation leaves a row for each table before the shuffle.
    """
    text = X.normalize(F.array_join(F.filter("cells", lambda c: X.strip(c) != ""), " "))
    scored = rows.where(F.col("row_idx") < first).select(*keys, "row_idx", anchor_score(text, anchors).alias("score"))
    best = scored.groupBy(*keys).agg(F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("header_idx"), F.max("score").alias("score"))
    return best.withColumn("header_idx", F.when(F.col("score") >= least, F.col("header_idx")))


def from_header(rows: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows from the header on, numbered from 0 again."""
    start = F.coalesce("header_idx", F.lit(0))
    joined = rows.join(headers.select(*keys, "header_idx"), keys, "left").where(F.col("row_idx") >= start)
    return joined.withColumn("row_idx", F.col("row_idx") - start).drop("header_idx")


def is_selected(cells: Column, anchors: dict[str, list[str]] = HEADER_ANCHORS, least: int = SELECTED) -> Column:
    """True if the cells of a first row hit at least 3 (cell, group) pairs."""
    plain = F.transform(cells, lambda c: X.normalize(F.coalesce(c, F.lit(""))))
    hits = F.aggregate(plain, F.lit(0), lambda n, c: n + anchor_score(c, anchors))
    return hits >= least


def to_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "row_idx", F.posexplode("cells").alias("col_idx", "text"))


def clean_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Stripped cells without `;`, without empty columns, then without empty rows, numbered anew.

    Cells are stripped before `;` becomes a space, so `" ;"` leaves a space and
    counts as filled. Columns go before rows. Cells are dealt by table once;
    all four windows run there.
    """
    clean = F.replace(X.strip(F.coalesce("text", F.lit(""))), F.lit(";"), F.lit(" "))
    texts = cells.withColumn("text", clean).repartition(*[F.col(k) for k in keys])
    filled = lambda *by: F.max(F.col("text") != "").over(Window.partitionBy(*keys, *by))
    columns = texts.withColumn("_c", filled("col_idx")).where("_c").drop("_c")
    rows = columns.withColumn("_r", filled("row_idx")).where("_r").drop("_r")
    number = lambda c: (F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)) - 1).cast("int")
    return rows.withColumn("_row", number("row_idx")).withColumn("_col", number("col_idx")).select(*keys, F.col("_row").alias("row_idx"), F.col("_col").alias("col_idx"), "text")


def header_names(names: Column) -> Column:
    """Names of an array of header cells: blank is `Unnamed: i`, repeats are `x.1`, `x.2`.

    Null stands for no header: then use numbered_names.
    """
    named = F.transform(names, lambda n, i: F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n))

    def unique(n: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(named, 1, i), lambda m: m == n))
        return F.when(before == 0, n).otherwise(F.concat(n, F.lit("."), before.cast("string")))

    return F.transform(named, unique)


def numbered_names(width: Column) -> Column:
    return F.when(width > 0, F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Заголовок "), i.cast("string")))).otherwise(F.array().cast("array<string>"))


def records(rows: DataFrame, keys: list[str], names: Column) -> DataFrame:
    """rows as records: array<struct<key, value>> in the order of the columns."""
    pair = F.zip_with(names, "cells", lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return rows.select(*keys, "row_idx", pair.alias("rec"))


def resolved(rows: DataFrame, keys: list[str], headed: DataFrame, compat: bool = True) -> DataFrame:
    """keys, row_idx, rec: rows as records, with the first row as names where headed(keys, is_header) says so, else numbered names.

    The first row counts as narrower than the others if its last cells are
    missing. With compat the texts that a table reader takes for missing
    (empty, NA and the like) are null.
    """
    width = rows.groupBy(*keys).agg(F.max(F.size("cells")).alias("_width"))
    first = rows.where("row_idx = 0").select(*keys, F.col("cells").alias("_first"))
    known = width.join(first, keys, "left").join(headed.select(*keys, "is_header"), keys, "left")
    has = F.coalesce("is_header", F.lit(False)) & F.col("_first").isNotNull()
    padded = F.concat("_first", F.array_repeat(F.lit("").cast("string"), F.greatest(F.col("_width") - F.size("_first"), F.lit(0))))
    names = known.select(*keys, has.alias("_has"), F.when(has, header_names(padded)).otherwise(numbered_names(F.col("_width"))).alias("_names"))
    body = rows.join(names, keys).where(~F.col("_has") | (F.col("row_idx") > 0)).withColumn("row_idx", (F.col("row_idx") - F.col("_has").cast("int")).cast("int"))
    if compat:
        body = body.withColumn("cells", F.transform("cells", lambda c: F.when(~c.isin(*MISSING), c)))
    return records(body, keys, F.col("_names"))


def chunks(records: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """keys, chunk_idx, prompt: records as prompt text, numbered from 1 in each chunk of size.

    The order inside a chunk is a sort of at most size entries.
    """
    number = (F.col("row_idx") % size + 1).cast("int")
    parts = records.select(*keys, F.floor(F.col("row_idx") / size).cast("int").alias("chunk_idx"), F.struct(number.alias("n"), X.prompt_text(F.col("rec"), number).alias("t")).alias("_p"))
    grouped = parts.groupBy(*keys, "chunk_idx").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return grouped.select(*keys, "chunk_idx", F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("prompt"))


def validation(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows, null_cells, duplicate_rows, is_valid, warnings.

    Equal rows meet by 128 bits of their values, nulls being equal, so that
    the rows themselves aren't shuffled.
    """
    missing = [F.col(c).isNull() for c in columns]
    nulls = reduce(lambda a, b: a + b, [m.cast("long") for m in missing])
    values = [x for c, m in zip(columns, missing, strict=True) for x in (m, F.col(c))]
    groups = df.groupBy(F.xxhash64(F.lit(1), *values).alias("_h"), F.xxhash64(F.lit(2), *reversed(values)).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.sum(nulls).alias("_nulls"))
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("_nulls"), F.lit(0)).alias("null_cells"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    share = F.col("null_cells") / F.greatest(F.col("n_rows") * len(columns), F.lit(1))
    warnings = F.filter(F.array(F.when(share > 0.5, F.lit("many nulls")), F.when(F.col("duplicate_rows") > 0, F.lit("duplicates"))), lambda w: w.isNotNull())
    return total.withColumn("is_valid", F.col("n_rows") > 0).withColumn("warnings", warnings)


def union_required(frames: list[DataFrame], required: list[str]) -> DataFrame:
    """Union of the frames that hold all required columns, without all-null rows; others are left out."""
    usable = [f.select(*required).dropna("all") for f in frames if set(required) <= set(f.columns)]
    if not usable:
        raise ValueError("no frame holds all required columns")
    return reduce(DataFrame.unionByName, usable)


def without_columns(df: DataFrame, part: str = "Unnamed") -> DataFrame:
    return df.select(*[c for c in df.columns if part not in c])


def column_widths(cells: DataFrame, keys: list[str], low: int = 10, high: int = 100) -> DataFrame:
    """Width of every column: its longest line and 2, between low and high."""
    longest = F.array_max(F.transform(F.split("text", "\n"), F.length))
    return cells.groupBy(*keys, "col_idx").agg(F.greatest(F.least(F.max(longest) + 2, F.lit(high)), F.lit(low)).alias("width"))


def semantic_header(cells: DataFrame, anchors: Column, keys: list[str], least: float = 0.75, share: float = 0.6, numeric: float = 0.3) -> DataFrame:
    """keys, mean_sim, share, numeric, is_header of tables whose header cells have an embedding.

    cells: keys, embedding, and text if there is one: a row of which more than
    the share numeric are numbers is no header. anchors is an array of anchor
    vectors, a literal of fixed size.
    """
    from gridline.functions.geometry import cosine

    best = F.array_max(F.transform(anchors, lambda a: cosine(a, F.col("embedding"))))
    number = F.coalesce(X.is_number(F.col("text")), F.lit(False)) if "text" in cells.columns else F.lit(False)
    scored = cells.withColumn("_s", best).withColumn("_n", number).groupBy(*keys)
    scored = scored.agg(F.avg("_s").alias("mean_sim"), F.avg((F.col("_s") >= least).cast("double")).alias("share"), F.avg(F.col("_n").cast("double")).alias("numeric"))
    return scored.withColumn("is_header", (F.col("numeric") <= numeric) & (F.col("mean_sim") >= least) & (F.col("share") >= share))


def distinct_keys(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, names: all keys of a table's records, sorted, each once."""
    names = records.select(*keys, F.explode(F.transform("rec", lambda e: e["key"])).alias("name")).distinct()
    return names.groupBy(*keys).agg(F.sort_array(F.collect_list("name")).alias("names"))


def unique_names(names: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """names(stem, suffix, order) with column name: stem_001, stem_002, ... without those of taken(name).

    Names of a stem take its free numbers in order, the lowest first. The jth
    taken number t leaves t - j free ones below it, so the kth free number is k
    and the taken ones of t - j < k: a running count over both, sorted together.
    """
    stem, ext = X.safe_stem(F.col("stem")), F.lower("suffix")
    part = lambda i: F.regexp_extract("name", r"^(.*)_(\d{1,9})(\.[^.]*)?$", i)
    used = taken.select(part(1).alias("_b"), F.coalesce(part(3), F.lit("")).alias("_e"), part(2).alias("_d")).where("_d <> ''").withColumn("_t", F.col("_d").cast("int"))
    used = used.where((F.col("_t") > 0) & (F.col("_d") == F.format_string("%03d", "_t"))).select("_b", "_e", "_t").distinct()
    inside = Window.partitionBy("_b", "_e")
    blocks = used.select("_b", "_e", (F.col("_t") - F.row_number().over(inside.orderBy("_t"))).alias("_at"), F.lit(1).alias("_taken"))
    wanted = names.select(stem.alias("_b"), ext.alias("_e"), F.struct(*names.columns).alias("_row"))
    wanted = wanted.withColumn("_at", F.row_number().over(inside.orderBy(F.col("_row")[order]))).withColumn("_taken", F.lit(0))
    both = wanted.unionByName(blocks, allowMissingColumns=True)
    before = F.sum("_taken").over(inside.orderBy("_at", "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("_number", F.col("_at") + before).where("_taken = 0")
    return numbered.select("_row.*", F.concat("_b", F.lit("_"), F.format_string("%03d", "_number"), "_e").alias("name"))
