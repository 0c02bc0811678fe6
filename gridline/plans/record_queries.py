"""Queries on records: alignment, samples, training rows, scores and the graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.operators import evaluate as V
from gridline.operators import knowledge as K
from gridline.operators import mapping as M
from gridline.operators import tables as T
from gridline.operators import training as R
from gridline.plans.register import register, table


def _sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return {
        "input": orders.select(F.lit("f").alias("file"), F.col("o_orderkey").alias("row_idx"), "o_orderpriority", "o_totalprice"),
        "extended": customers.select(F.lit("f").alias("file"), F.col("c_custkey").alias("row_idx"), "c_name", "c_mktsegment"),
    }


@register(
    "positional_join",
    "SELECT o_orderkey AS row_idx, o_orderpriority AS priority, o_totalprice AS price, c_name AS name FROM orders JOIN customer ON o_orderkey = c_custkey",
)
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.aligned(_sheets(spark, sf_dir), ["file"])
    return joined.select("row_idx", F.col("input.o_orderpriority").alias("priority"), F.col("input.o_totalprice").alias("price"), F.col("extended.c_name").alias("name"))


@register(
    "training_records",
    """WITH j AS (SELECT o_orderkey, o_orderpriority, c_name, c_mktsegment FROM orders JOIN customer ON o_orderkey = c_custkey),
    u AS (SELECT *, 'Запись 1:' || chr(10) || '  o_orderpriority: ' || o_orderpriority AS user FROM j)
    SELECT o_orderkey AS row_idx, 'simplified' AS mode, 's1' AS system, user, '{"rows":[{"c_name":"' || c_name || '"}]}' AS assistant FROM u
    UNION ALL SELECT o_orderkey, 'extended', 's2', user, '{"rows":[{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}]}' FROM u""",
)
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.aligned(_sheets(spark, sf_dir), ["file"])
    user = R.sheet_prompt(F.col("input"), ["o_orderpriority"], F.lit(1))
    answers = {"simplified": R.filled(F.col("extended"), ["c_name"]), "extended": R.filled(F.col("extended"), ["c_name", "c_mktsegment"])}
    return R.records(joined, user, answers, {"simplified": "s1", "extended": "s2"}, ["row_idx"])


@register(
    "three_views",
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Lобщ.=40 мм' END AS spec FROM part)
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS order_code, p_name || ' ' || p_brand || CASE WHEN spec = '' THEN '' ELSE ' ' || spec END AS input_name,
      p_brand AS extended_code, p_name || ' ' || p_brand AS simplified_name, spec AS simplified_spec FROM p""",
)
def three_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.when(F.col("p_partkey") % 2 == 0, "").otherwise("Lобщ.=40 мм")
    views = R.three_views("p_name", "p_brand", "p_type", "p_partkey", "p_size", "p_type", spec)
    out = table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in views.items()])
    return out.select(
        "p_partkey",
        F.col("INPUT")["Код заказа"].alias("order_code"),
        F.col("INPUT")["Наименование"].alias("input_name"),
        F.col("EXTENDED")["Обозначение"].alias("extended_code"),
        F.col("SIMPLIFIED")["Наименование"].alias("simplified_name"),
        F.col("SIMPLIFIED")["Техническое задание"].alias("simplified_spec"),
    )


@register(
    "random_specs",
    """WITH h AS (SELECT p_partkey, [CAST(('0x' || md5('spec' || n || ':' || p_partkey)[1:8]) AS BIGINT) FOR n IN [0, 1, 2, 3, 4]] AS d FROM part)
    SELECT p_partkey, CASE WHEN d[1] % 2 = 0 THEN '' WHEN d[2] % 2 = 0 THEN 'Lобщ.=' || (d[3] % 111 + 15) || ' мм  Lраб=' || (d[4] % 111 + 15) || '  мм'
      ELSE ['зенковка 90 градусов', 'для торцевых канавок', 'для ширины паза 0,5 мм'][d[5] % 3 + 1] END AS spec FROM h""",
)
def random_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.random_spec(F.col("p_partkey")).alias("spec"))


_QUOTA = """
f AS (SELECT source AS file, count(*) AS capacity FROM documents GROUP BY source),
q AS (SELECT file, capacity, CASE WHEN sum(capacity) OVER () <= 130 THEN capacity ELSE least(capacity, 130 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY file) <= 130 % count(*) OVER () THEN 1 ELSE 0 END) END AS quota FROM f)"""


@register(
    "quota_sample",
    f"""WITH {_QUOTA} SELECT source, doc_id FROM documents JOIN q ON q.file = documents.source
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('quota' || doc_id), doc_id) <= any_value(quota) OVER (PARTITION BY source)""",
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """130 documents, dealt evenly to the sources: a sampling operator's own limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    files = docs.groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("capacity"))
    return R.sample_by_quota(docs, R.quotas(files, 130), "source", "doc_id", "quota").select("source", "doc_id")


@register("quotas", f"WITH {_QUOTA} SELECT file, capacity, CAST(quota AS BIGINT) AS quota FROM q")
def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("capacity"))
    return R.quotas(files, 130)


@register("hash_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('sample' || doc_id), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents without replacement: a sampling operator's own limit."""
    return R.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, "sample")


@register(
    "train_labels",
    """WITH t AS (SELECT conv_id, turn, range(0, length(text) % 40) AS ids, CAST(turn * 5 AS INTEGER) AS k FROM conversations)
    SELECT conv_id, turn, array_to_string([CASE WHEN i < k THEN -100 ELSE i END FOR i IN ids], ' ') AS labels FROM t""",
)
def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 40
    ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    labels = R.masked_labels(F.col("ids"), (F.col("turn") * 5).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids")).select("conv_id", "turn", F.array_join(F.transform(labels, lambda x: x.cast("string")), " ").alias("labels"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    field = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*kv[1::2]))
    expected = field("name", F.col("p_name"), "brand", F.col("p_brand"), "type", F.col("p_type"))
    guess = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.substring("p_name", 1, 4))
    predicted = field("name", guess, "brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("none"))
    return part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "extended").otherwise("simplified").alias("mode"), V.accuracy(predicted, expected).alias("accuracy"))


_SCORES = """
s AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'extended' ELSE 'simplified' END AS mode,
  (CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE WHEN length(p_name) <= 4 THEN 1.0 ELSE 0.5 END + CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN p_type = '' THEN 1.0 ELSE 0.5 END) / 3 AS accuracy FROM part)"""


@register("field_accuracy", f"WITH {_SCORES} SELECT p_partkey, mode, CAST(round(accuracy, 6) AS DOUBLE) AS accuracy FROM s")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("accuracy", F.round("accuracy", 6))


@register("accuracy_summary", f"WITH {_SCORES} SELECT mode, count(*) AS n, CAST(round(avg(accuracy), 6) AS DOUBLE) AS mean, CAST(round(max(accuracy), 6) AS DOUBLE) AS best, CAST(round(min(accuracy), 6) AS DOUBLE) AS worst FROM s GROUP BY mode")
def accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_scores(spark, sf_dir)).select("mode", "n", *[F.round(c, 6).alias(c) for c in ("mean", "best", "worst")])


@register("best_results", f"WITH {_SCORES} SELECT p_partkey, mode, CAST(round(accuracy, 6) AS DOUBLE) AS accuracy FROM s ORDER BY s.accuracy DESC, p_partkey LIMIT 3")
def best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best: a top-n report's own limit."""
    return V.best(_scores(spark, sf_dir), ["p_partkey"]).withColumn("accuracy", F.round("accuracy", 6))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_name").alias("from_entity"), F.col("r_name").alias("to_entity"), F.lit("in").alias("relation_type"), F.lit(1.0).alias("confidence"), F.col("n_nationkey").cast("long").alias("ord"))


@register(
    "graph_neighbours",
    """SELECT n_name AS name, r_name AS neighbour FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.neighbours(_edges(spark, sf_dir), "in").select("name", "neighbour")


@register(
    "graph_cards",
    """SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS relations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def graph_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("type"), F.create_map(F.lit("k"), F.col("r_name")).alias("attributes"))
    return K.cards(regions, _edges(spark, sf_dir)).select("name", F.array_join("relations", ",").alias("relations"))


@register("tool_graph", "SELECT * FROM (VALUES ('производитель', 11), ('тип_инструмента', 14), ('параметр', 8), ('единица_измерения', 5)) v(type, entities)")
def tool_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.entities(spark).groupBy("type").agg(F.count(F.lit(1)).cast("int").alias("entities"))


def _echo(prompts: list[str]) -> list[str]:
    """A stand-in for a model: a row for each record, named by its first line."""
    rows = [[{"Наименование": line.strip(), "Количество": "1"} for line in p.split("\n") if line.startswith("  role")] for p in prompts]
    return [json.dumps({"rows": r}, ensure_ascii=False) for r in rows]


@register(
    "mapped_records",
    """SELECT conv_id, CAST(turn // 5 AS INTEGER) AS chunk_idx, CAST(turn % 5 AS INTEGER) AS pos, 'role: ' || role AS name, '1' AS quantity FROM conversations""",
)
def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("row_idx"), F.array("role").alias("cells"))
    mapped = M.map_records(T.records(turns, ["conv_id"], F.array(F.lit("role"))), ["conv_id"], _echo)
    return mapped.select("conv_id", "chunk_idx", "pos", F.col("Наименование").alias("name"), F.col("Количество").alias("quantity"))


@register(
    "upload_duplicates",
    "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lang || ':' || octet_length(encode(text)) || ':' || md5(text)",
)
def upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridline.functions.text import signature

    docs = table(spark, sf_dir, "documents").select("doc_id", signature(F.col("lang"), F.col("text").cast("binary")).alias("sig"))
    return docs.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@register(
    "unique_names",
    r"""WITH n AS (SELECT page_id, 'page_' || split_part(url, '/', 4) AS stem FROM pages),
    c AS (SELECT page_id, lower(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(stem), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'file')) AS b FROM n),
    k AS (SELECT page_id, b, row_number() OVER (PARTITION BY b ORDER BY page_id) AS i FROM c),
    free AS (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY x) AS i FROM (SELECT b, unnest(range(1, count(*) + 10)) AS x FROM k GROUP BY b) WHERE NOT (b = 'page_en' AND x IN (2, 4, 5)))
    SELECT page_id, b || '_' || lpad(CAST(x AS VARCHAR), greatest(3, length(CAST(x AS VARCHAR)))::INT, '0') || '.html' AS name FROM k JOIN free USING (b, i)""",
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("page_"), F.coalesce(F.get(F.split("url", "/"), F.lit(3)), F.lit("")))
    names = table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"), F.lit(".HTML").alias("suffix"))
    taken = spark.createDataFrame([(f"page_en_{n}",) for n in ("004.html", "002.html", "005.html", "7.html", "006.txt")] + [("other.html",)], "name string")
    return T.unique_names(names, taken, "page_id").select("page_id", "name")


@register(
    "distinct_keys",
    """WITH k AS (SELECT DISTINCT conv_id, unnest(['turn', role]) AS name FROM conversations) SELECT conv_id, string_agg(name, ',' ORDER BY name) AS names FROM k GROUP BY conv_id""",
)
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    records = turns.select("conv_id", F.array(entry(F.lit("turn"), F.col("turn").cast("string")), entry(F.col("role"), F.col("text"))).alias("rec"))
    return T.distinct_keys(records, ["conv_id"]).select("conv_id", F.array_join("names", ",").alias("names"))


@register(
    "aligned_sample",
    """WITH s AS (SELECT o_orderkey FROM orders ORDER BY md5('align' || 'f:' || o_orderkey), o_orderkey LIMIT 50)
    SELECT 'input' AS sheet, o_orderkey AS row_idx FROM s UNION ALL SELECT 'extended', o_orderkey FROM s JOIN customer ON c_custkey = o_orderkey""",
)
def aligned_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same 50 rows of two sheets: a sampling operator's own limit."""
    drawn = R.aligned_sample(_sheets(spark, sf_dir), ["file"], 50, "align")
    return drawn["input"].select(F.lit("input").alias("sheet"), "row_idx").unionByName(drawn["extended"].select(F.lit("extended").alias("sheet"), "row_idx"))
