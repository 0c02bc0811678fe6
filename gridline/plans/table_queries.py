"""Queries on tables of text cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions import text as X
from gridline.operators import tables as T
from gridline.plans.register import register, table
from gridline.sources import text as S

#: Anchors that suit the prose of the driver tables.
ANCHORS = {
    "article": ["the", "der", "die", "el ", "la ", "le "],
    "and": ["and", "und", " et ", " y "],
    "of": [" of ", " de ", "von"],
    "to": [" to ", " zu ", "para", "pour"],
    "ending": ["tion", "ung", "ción"],
}
_SCORE = " + ".join("CAST(" + " OR ".join(f"contains(t, '{w}')" for w in words) + " AS INTEGER)" for words in ANCHORS.values())
_NORM = r"trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '\s+', ' ', 'g'))"
_HEADER = f"""
lines AS (
  SELECT doc_id, unnest(range(0, least(len(string_split(text, chr(10))), 20))) AS i, string_split(text, chr(10)) AS l FROM documents
), scored AS (
  SELECT doc_id, i, {_SCORE} AS s FROM (SELECT doc_id, i, {_NORM.format("l[i + 1]")} AS t FROM lines)
), header AS (
  SELECT doc_id, CASE WHEN max(s) >= 2 THEN CAST(arg_max(i, s * 100 - i) AS INTEGER) END AS header_idx FROM scored GROUP BY doc_id
)"""


@register("header_row_locate", f"WITH {_HEADER} SELECT doc_id, header_idx FROM header")
def header_row_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.header_index(F.split("text", "\n"), ANCHORS).alias("header_idx"))


@register(
    "header_trim",
    f"""WITH {_HEADER} SELECT d.doc_id, CAST(i - coalesce(h.header_idx, 0) AS INTEGER) AS row_idx, l[i + 1] AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) d
    JOIN header h ON d.doc_id = h.doc_id WHERE i >= coalesce(h.header_idx, 0)""",
)
def header_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the header on: a projection of each text, without a join."""
    lines = F.split("text", "\n")
    start = F.coalesce(T.header_index(lines, ANCHORS), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).withColumn("s", F.coalesce(T.header_index(F.col("l"), ANCHORS), F.lit(0)))
    return docs.select("doc_id", F.posexplode(F.slice("l", F.col("s") + 1, F.greatest(F.size("l") - F.col("s"), F.lit(0)))).alias("row_idx", "line"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tables: lines as rows, cells cut at sentence ends."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "l"))
    return lines.select("doc_id", "row_idx", F.split("l", r"[.|]").alias("cells"))


_ROWS = r"""
rows AS (
  SELECT doc_id, CAST(i AS INTEGER) AS row_idx, regexp_split_to_array(l[i + 1], '[.|]') AS cells
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
), cells AS (
  SELECT doc_id, row_idx, CAST(c AS INTEGER) AS col_idx, cells[c + 1] AS text FROM (SELECT *, unnest(range(0, len(cells))) AS c FROM rows)
)"""


@register(
    "header_rows_of_cells",
    f"""WITH {_ROWS}, scored AS (
      SELECT doc_id, row_idx, {_SCORE} AS s FROM (
        SELECT doc_id, row_idx, {_NORM.format("array_to_string(list_filter(cells, lambda c: trim(c) <> ''), ' ')")} AS t FROM rows WHERE row_idx < 20)
    ) SELECT doc_id, CASE WHEN max(s) >= 2 THEN arg_max(row_idx, s * 100 - row_idx) END AS header_idx, max(s) AS score FROM scored GROUP BY doc_id""",
)
def header_rows_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.header_rows(_rows(spark, sf_dir), ["doc_id"], ANCHORS)


@register(
    "clean_cells",
    rf"""WITH {_ROWS}, c AS (
      SELECT doc_id, row_idx, col_idx, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), ';', ' ') AS text FROM cells
    ), cols AS (SELECT * FROM c QUALIFY bool_or(text <> '') OVER (PARTITION BY doc_id, col_idx)),
    kept AS (SELECT * FROM cols QUALIFY bool_or(text <> '') OVER (PARTITION BY doc_id, row_idx))
    SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS INTEGER) AS row_idx,
           CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY col_idx) - 1 AS INTEGER) AS col_idx, text FROM kept""",
)
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean_cells(T.to_cells(_rows(spark, sf_dir), ["doc_id"]), ["doc_id"])


@register(
    "column_widths",
    f"WITH {_ROWS} SELECT doc_id, col_idx, CAST(greatest(least(max(length(text)) + 2, 100), 10) AS INTEGER) AS width FROM cells GROUP BY doc_id, col_idx",
)
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.column_widths(T.to_cells(_rows(spark, sf_dir), ["doc_id"]), ["doc_id"])


_FIVE = """f AS (
  SELECT doc_id, len(l) AS n, least(len(l), 5) AS k, array_to_string(l[1:5], chr(10)) AS j, l[1:5] AS five
  FROM (SELECT doc_id, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS l FROM documents)
)""".replace("\\\\", "\\")


@register(
    "format_sniff",
    rf"""WITH {_FIVE} SELECT doc_id, CASE WHEN n < 2 THEN 'plain' WHEN length(j) - length(replace(j, ',', '')) > k THEN 'csv'
      WHEN length(j) - length(replace(j, chr(9), '')) > k THEN 'tsv' WHEN length(j) - length(replace(j, ';', '')) > k THEN 'semicolon'
      WHEN length(j) - length(replace(j, '|', '')) > k THEN 'pipe'
      WHEN len(list_filter(five, lambda x: regexp_matches(x, '\s{{2,}}'))) > 0.6 * k THEN 'table' ELSE 'plain' END AS kind FROM f""",
)
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.text_kind(F.col("text")).alias("kind"))


@register(
    "delimited_table",
    """WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(replace(text, '. ', ',' || chr(1) || ','), chr(10)), lambda x: x <> ''), lambda x: string_split(x, ',')) AS r FROM documents),
    k AS (SELECT doc_id, list_filter(r, lambda x: len(x) <= len(r[1])) AS r, len(r[1]) AS w FROM l),
    e AS (SELECT doc_id, w, r, unnest(range(0, len(r))) AS i FROM k)
    SELECT doc_id, CAST(i AS INTEGER) AS row_idx, CAST(w AS INTEGER) AS width, r[i + 1][1] AS first_cell, CAST(len(r[i + 1]) AS INTEGER) AS filled,
      array_to_string(list_transform(r[i + 1], lambda c: replace(c, chr(1), 'a"b,' || chr(10) || ' c d')), '|') AS cells FROM e""",
)
def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as delimited text, with a quoted field of two lines at the end of every sentence."""
    quoted = F.replace("text", F.lit(". "), F.lit(',"a""b,\n c" d,'))
    rows = S.delimited(table(spark, sf_dir, "documents").withColumn("text", quoted), ["doc_id"], ",")
    return rows.select("doc_id", "row_idx", F.size("cells").alias("width"), F.get("cells", F.lit(0)).alias("first_cell"), F.size(F.filter("cells", lambda c: c.isNotNull())).alias("filled"), F.array_join(F.filter("cells", lambda c: c.isNotNull()), "|").alias("cells"))


@register(
    "whitespace_table",
    r"""WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(replace(text, '. ', '.  '), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
        lambda x: list_filter(regexp_split_to_array(x, '\s{2,}'), lambda c: c <> '')) AS r FROM documents),
    e AS (SELECT doc_id, r, list_max(list_transform(r, lambda x: len(x))) AS w, unnest(range(0, len(r))) AS i FROM l)
    SELECT doc_id, CAST(i AS INTEGER) AS row_idx, CAST(w AS INTEGER) AS width, r[i + 1][1] AS first_cell, CAST(w - len(r[i + 1]) AS INTEGER) AS added FROM e""",
)
def whitespace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".  ")))
    rows = S.whitespace_table(docs, ["doc_id"])
    return rows.select("doc_id", "row_idx", F.size("cells").alias("width"), F.get("cells", F.lit(0)).alias("first_cell"), F.size(F.filter("cells", lambda c: c == "")).alias("added"))


@register(
    "plain_lines",
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS r FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS row_idx, r[i + 1] AS line FROM (SELECT doc_id, r, unnest(range(0, len(r))) AS i FROM l)""",
)
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.plain_lines(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "row_idx", F.get("cells", F.lit(0)).alias("line"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", F.col("turn").cast("int").alias("row_idx"), F.array("role", F.length("text").cast("string")).alias("cells"))
    return T.records(rows, ["conv_id"], F.array(F.lit("role"), F.lit("chars")))


@register(
    "chunk_prompts",
    """SELECT conv_id, CAST(turn // 5 AS INTEGER) AS chunk_idx,
      string_agg('Запись ' || (turn % 5 + 1) || ':' || chr(10) || '  role: ' || role || chr(10) || '  chars: ' || length(text), chr(10) ORDER BY turn) AS prompt
      FROM conversations GROUP BY ALL""",
)
def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(_records(spark, sf_dir), ["conv_id"])


@register(
    "header_names",
    """WITH h AS (SELECT doc_id, [lang, source, '', lang, CASE WHEN n_chars % 2 = 0 THEN lang END] AS raw FROM documents),
    n AS (SELECT doc_id, [CASE WHEN coalesce(raw[i], '') = '' THEN 'Unnamed: ' || (i - 1) ELSE raw[i] END FOR i IN range(1, 6)] AS names FROM h),
    u AS (SELECT doc_id, names, unnest(range(1, 6)) AS i FROM n)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS col_idx,
      names[i] || CASE WHEN len(list_filter(names[1:i - 1], lambda x: x = names[i])) > 0 THEN '.' || len(list_filter(names[1:i - 1], lambda x: x = names[i])) ELSE '' END AS name,
      'Заголовок ' || i AS plain FROM u""",
)
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.array(F.col("lang"), F.col("source"), F.lit(""), F.col("lang"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")))
    both = docs.select("doc_id", raw.alias("raw")).select("doc_id", T.header_names(F.col("raw")).alias("n"), T.numbered_names(F.size("raw")).alias("p"))
    zipped = F.posexplode(F.arrays_zip("n", "p"))
    return both.select("doc_id", zipped.alias("col_idx", "z")).select("doc_id", "col_idx", F.col("z.n").alias("name"), F.col("z.p").alias("plain"))


@register(
    "validate_metrics",
    """WITH g AS (SELECT CASE WHEN n_chars % 3 = 0 THEN NULL ELSE lang END AS lang, text, count(*) AS n FROM documents GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN lang IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_cells,
      CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, sum(n) > 0 AS is_valid, CASE WHEN sum(n - 1) > 0 THEN 'duplicates' ELSE '' END AS warnings FROM g""",
)
def validate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 3 != 0, F.col("lang")).alias("lang"), "text")
    return T.validation(docs, ["lang", "text"]).withColumn("warnings", F.array_join("warnings", ","))


@register(
    "union_required",
    """SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier""",
)
def union_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers; parts lack the required columns and are left out."""
    names = {"customer": "c_", "supplier": "s_", "part": "p_"}
    frames = []
    for name, prefix in names.items():
        df = table(spark, sf_dir, name)
        wanted = {f"{prefix}name": "name", f"{prefix}nationkey": "nation", f"{prefix}acctbal": "balance"}
        frames.append(df.select(*[F.col(c).alias(n) for c, n in wanted.items() if c in df.columns]))
    return T.union_required(frames, ["name", "nation", "balance"])


@register(
    "table_selection",
    rf"""SELECT doc_id, list_sum(list_transform(string_split(string_split(text, chr(10))[1], ' '),
       lambda c: {_SCORE.replace("contains(t, ", "contains(" + _NORM.format("c") + ", ")})) >= 3 AS selected FROM documents""",
)
def table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.split(F.get(F.split("text", "\n"), F.lit(0)), " ")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_selected(cells, ANCHORS).alias("selected"))


@register(
    "cosine_header",
    """WITH a AS (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) AS anchors FROM embeddings WHERE vec_id < 28),
    s AS (SELECT label, list_max(list_transform(anchors, lambda x: list_cosine_similarity(x, embedding::DOUBLE[]))) AS m FROM embeddings, a WHERE vec_id >= 28)
    SELECT label, round(avg(m), 6) AS mean_sim, round(avg(CASE WHEN m >= 0.4 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share,
      avg(m) >= 0.4 AND avg(CASE WHEN m >= 0.4 THEN 1.0 ELSE 0.0 END) >= 0.6 AS is_header FROM s GROUP BY label""",
)
def cosine_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 28 vectors are the anchors: as many as header words, whatever the data."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null")
    anchors = [r["embedding"] for r in vectors.where("vec_id < 28").orderBy("vec_id").limit(28).collect()]
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in anchors])
    found = T.semantic_header(vectors.where("vec_id >= 28"), literal, ["label"], 0.4)
    return found.select("label", F.round("mean_sim", 6).alias("mean_sim"), F.round("share", 6).alias("share"), "is_header")
