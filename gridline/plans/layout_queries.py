"""Queries on boxes and words, derived from the line items of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions.geometry import iou
from gridline.operators import layout as L
from gridline.operators import pdf as P
from gridline.plans.register import register, table

KEY = ["l_orderkey"]


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    x1, y1 = (F.col("l_partkey") * 37 % 1100).cast("double"), (F.col("l_suppkey") * 53 % 700).cast("double")
    idx = (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")
    text = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    boxes = items.select("l_orderkey", idx.alias("block_idx"), x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_quantity") * 3).alias("x2"), (y1 + 15 + F.col("l_partkey") % 20).alias("y2"), text.alias("text"))
    return boxes


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cell_idx")
    x, y, shift = (F.col("cell_idx") % 2) * 600, F.floor(F.col("cell_idx") / 2) * 400, F.col("l_orderkey") % 5 * 20
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cell)
    d = lambda c: c.cast("double")
    return cells.select("l_orderkey", "cell_idx", d(x + shift).alias("x1"), d(y).alias("y1"), d(x + 560).alias("x2"), d(y + 360).alias("y2"))


_BOXES = """
b AS (
  SELECT l_orderkey, (l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS block_idx, (l_partkey * 37 % 1100)::DOUBLE AS x1, (l_suppkey * 53 % 700)::DOUBLE AS y1,
    (l_partkey * 37 % 1100)::DOUBLE + 20 + l_quantity * 3 AS x2, (l_suppkey * 53 % 700)::DOUBLE + 15 + l_partkey % 20 AS y2, l_returnflag || l_linenumber AS text
  FROM lineitem
), c AS (
  SELECT o_orderkey AS l_orderkey, cell_idx, ((cell_idx % 2) * 600 + o_orderkey % 5 * 20)::DOUBLE AS x1, ((cell_idx // 2) * 400)::DOUBLE AS y1,
    ((cell_idx % 2) * 600 + 560)::DOUBLE AS x2, ((cell_idx // 2) * 400 + 360)::DOUBLE AS y2
  FROM (SELECT o_orderkey, unnest([0, 1, 2, 3]) AS cell_idx FROM orders)
)"""
_ASSIGNED = """
p AS (
  SELECT b.l_orderkey, block_idx, cell_idx, (b.x1 + b.x2) / 2 BETWEEN c.x1 AND c.x2 AND (b.y1 + b.y2) / 2 BETWEEN c.y1 AND c.y2 AS inside,
    CASE WHEN least(b.x2, c.x2) < greatest(b.x1, c.x1) OR least(b.y2, c.y2) < greatest(b.y1, c.y1) THEN 0.0::DOUBLE
      ELSE (least(b.x2, c.x2) - greatest(b.x1, c.x1)) * (least(b.y2, c.y2) - greatest(b.y1, c.y1)) END AS common,
    (b.x2 - b.x1) * (b.y2 - b.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS areas
  FROM b JOIN c ON b.l_orderkey = c.l_orderkey
), centre AS (
  SELECT l_orderkey, block_idx, min(cell_idx) AS cell_idx, 0 AS method FROM p WHERE inside GROUP BY ALL
), near AS (
  SELECT l_orderkey, block_idx, cell_idx, 1 AS method FROM p ANTI JOIN centre USING (l_orderkey, block_idx)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, block_idx ORDER BY common / (areas - common) DESC, cell_idx) = 1 AND common / (areas - common) >= 0.05
), a AS (SELECT * FROM centre UNION ALL SELECT * FROM near)"""


@register("cell_assignment", f"WITH {_BOXES}, {_ASSIGNED} SELECT l_orderkey, block_idx, cell_idx, method FROM a")
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocks_in_cells(_blocks(spark, sf_dir), _cells(spark, sf_dir), KEY)


@register(
    "cell_lines",
    f"""WITH {_BOXES}, {_ASSIGNED}, w AS (
      SELECT a.l_orderkey, a.cell_idx, method, block_idx, text, (b.x1 + b.x2) / 2 AS cx, (b.y1 + b.y2) / 2 AS cy,
        least(0.15::DOUBLE * (c.y2 - c.y1), 0.5::DOUBLE * avg(b.y2 - b.y1) OVER (PARTITION BY a.l_orderkey, a.cell_idx), 15.0::DOUBLE) AS lim
      FROM a JOIN b USING (l_orderkey, block_idx) JOIN c ON c.l_orderkey = a.l_orderkey AND c.cell_idx = a.cell_idx
    ), f AS (
      SELECT *, row_number() OVER o AS pos, CASE WHEN cy - lag(cy) OVER o > lim THEN 1 ELSE 0 END AS new FROM w
      WINDOW o AS (PARTITION BY l_orderkey, cell_idx ORDER BY cy, method, block_idx)
    ), g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey, cell_idx ORDER BY pos) AS line FROM f
    ), l AS (
      SELECT l_orderkey, cell_idx, line, any_value(lim) AS lim, first(cy ORDER BY cx, pos) AS y, string_agg(text, ' ' ORDER BY cx, pos) AS t FROM g GROUP BY l_orderkey, cell_idx, line
    ), s AS (
      SELECT *, lag(y) OVER (PARTITION BY l_orderkey, cell_idx ORDER BY y, line) AS before FROM l
    ), t AS (
      SELECT l_orderkey, cell_idx, string_agg(CASE WHEN before IS NULL THEN '' WHEN y - before > 1.5 * lim THEN chr(10) ELSE ' ' END || t, '' ORDER BY y, line) AS text FROM s GROUP BY ALL
    ) SELECT c.l_orderkey, c.cell_idx, coalesce(t.text, '') AS text FROM c LEFT JOIN t ON c.l_orderkey = t.l_orderkey AND c.cell_idx = t.cell_idx""",
)
def cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, cells = _blocks(spark, sf_dir), _cells(spark, sf_dir)
    return L.cell_texts(blocks, cells, L.blocks_in_cells(blocks, cells, KEY), KEY)


_GAPS = """
i AS (SELECT l_orderkey, CAST(trunc(greatest(x1, 0)) AS INTEGER) AS a, CAST(trunc(least(x2, 1199)) AS INTEGER) AS e FROM b),
g AS (SELECT l_orderkey, a, coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pe
  FROM (SELECT * FROM i WHERE e > a UNION ALL SELECT DISTINCT l_orderkey, 1200, 1200 FROM b)),
bounds AS (SELECT l_orderkey, CAST((pe + a) // 2 AS INTEGER) AS boundary FROM g WHERE a - pe > 10)"""


@register("column_gaps", f"WITH {_BOXES}, {_GAPS} SELECT * FROM bounds")
def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_gaps(_blocks(spark, sf_dir), KEY)


@register(
    "pivot_reconstruct",
    f"""WITH {_BOXES}, {_GAPS}, k AS (
      SELECT b.l_orderkey, block_idx, y1, text, CAST(coalesce(len(list_filter(l, lambda z: (x1 + x2) / 2 > z)), 0) AS INTEGER) AS col_idx
      FROM b LEFT JOIN (SELECT l_orderkey, list(boundary) AS l FROM bounds GROUP BY ALL) q ON q.l_orderkey = b.l_orderkey
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, col_idx ORDER BY y1, block_idx) - 1 AS INTEGER) AS row_idx FROM k),
    z AS (SELECT l_orderkey, max(row_idx) AS mr, max(col_idx) AS mc FROM r GROUP BY ALL),
    grid AS (SELECT l_orderkey, row_idx, unnest(range(0, mc + 1)) AS col_idx FROM (SELECT l_orderkey, mc, unnest(range(0, mr + 1)) AS row_idx FROM z))
    SELECT grid.l_orderkey, CAST(grid.row_idx AS INTEGER) AS row_idx, CAST(grid.col_idx AS INTEGER) AS col_idx, coalesce(text, '') AS text
    FROM grid LEFT JOIN r ON r.l_orderkey = grid.l_orderkey AND r.row_idx = grid.row_idx AND r.col_idx = grid.col_idx""",
)
def pivot_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return L.reconstruct(blocks, L.column_gaps(blocks, KEY), KEY)


@register(
    "interval_assign",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST((l_extendedprice > 1000)::INT + (l_extendedprice > 20000)::INT + (l_extendedprice > 50000)::INT AS INTEGER) AS column_idx,
      CASE WHEN l_quantity >= 5 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity < 40 THEN 2 END AS interval_idx FROM lineitem""",
)
def interval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    column = L.column_of(F.col("l_extendedprice"), bounds(1000, 20000, 50000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", column.alias("column_idx"), L.interval_of(F.col("l_quantity"), bounds(5, 10, 25, 40)).alias("interval_idx"))


@register(
    "box_overlap",
    """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 90)::DOUBLE AS y, l_quantity AS w FROM lineitem),
    k AS (SELECT *, greatest(least(x + w, 80) - greatest(x, 20), -1) AS dx, greatest(least(y + 30, 60) - greatest(y, 10), -1) AS dy FROM b)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN dx < 0 OR dy < 0 THEN 0.0 ELSE dx * dy / (w * 30 + 60 * 50 - dx * dy) END, 6)::DOUBLE AS overlap FROM k""",
)
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 90).cast("double")
    box = {"x1": x, "y1": y, "x2": x + F.col("l_quantity"), "y2": y + 30}
    fixed = {k: F.lit(v) for k, v in {"x1": 20.0, "y1": 10.0, "x2": 80.0, "y2": 60.0}.items()}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(iou(box, fixed), 6).alias("overlap"))


@register(
    "anchored_lines",
    """WITH RECURSIVE w AS (
      SELECT l_orderkey, (l_suppkey * 53 % 700) / 10.0::DOUBLE AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey * 53 % 700, l_partkey, l_linenumber, l_suppkey) AS n FROM lineitem
    ), r AS (
      SELECT l_orderkey, n, top, top AS anchor, 1 AS line FROM w WHERE n = 1
      UNION ALL SELECT w.l_orderkey, w.n, w.top, CASE WHEN w.top - r.anchor < 3.0 THEN r.anchor ELSE w.top END, CASE WHEN w.top - r.anchor < 3.0 THEN r.line ELSE r.line + 1 END
      FROM r JOIN w ON w.l_orderkey = r.l_orderkey AND w.n = r.n + 1
    ) SELECT l_orderkey, CAST(line - 1 AS INTEGER) AS line_idx, round(any_value(anchor), 6)::DOUBLE AS top, count(*) AS words FROM r GROUP BY l_orderkey, line""",
)
def anchored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    word = F.struct(((F.col("l_suppkey") * 53 % 700) / 10.0).alias("top"), F.col("l_partkey").cast("double").alias("x0"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"))
    pages = items.groupBy("l_orderkey").agg(F.collect_list(word).alias("w")).select("l_orderkey", L.lines_of(F.col("w")).alias("lines"))
    lines = pages.select("l_orderkey", F.posexplode("lines").alias("line_idx", "l"))
    return lines.select("l_orderkey", "line_idx", F.round("l.top", 6).alias("top"), F.size(F.split("l.text", " ")).cast("long").alias("words"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 7 % 300).cast("double")
    page = F.floor(F.col("l_orderkey") / 4).alias("page")
    return items.select(page, x.alias("x0"), (x + F.col("l_quantity") * 2).alias("x1"), y.alias("top"), (y + F.col("l_quantity")).alias("bottom"))


_ISLANDS = """
s AS (SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page, {a} AS a, {b} AS b FROM lineitem),
edge AS (SELECT page, CAST(min(floor(a)) AS INTEGER) AS lo, CAST(max(ceil(b)) AS INTEGER) AS hi FROM s WHERE ceil(b) > floor(a) GROUP BY page),
cov AS (SELECT page, p FROM (SELECT page, unnest(range(CAST(floor(a) AS BIGINT), CAST(ceil(b) AS BIGINT))) AS p FROM s) GROUP BY ALL HAVING count(*) >= 2),
emp AS (SELECT page, lo, hi, p FROM (SELECT *, unnest(range(lo, hi)) AS p FROM edge) ANTI JOIN cov USING (page, p)),
isl AS (SELECT page, lo, hi, min(p) AS f, max(p) AS t FROM (SELECT *, p - row_number() OVER (PARTITION BY page ORDER BY p) AS run FROM emp) GROUP BY page, lo, hi, run)"""


@register(
    "column_histogram",
    "WITH " + _ISLANDS.format(a="(l_partkey % 300)::DOUBLE", b="(l_partkey % 300) + l_quantity * 2") + """
    SELECT page, CASE WHEN t = hi - 1 THEN hi - 1 WHEN f = lo THEN lo ELSE (f + t) / 2.0 END::DOUBLE AS bound FROM isl UNION ALL SELECT page, hi::DOUBLE FROM edge""",
)
def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_histogram(_segments(spark, sf_dir), ["page"]).select("page", F.explode("bounds").alias("bound"))


@register(
    "row_histogram",
    "WITH RECURSIVE " + _ISLANDS.format(a="(l_suppkey * 7 % 300)::DOUBLE", b="(l_suppkey * 7 % 300) + l_quantity").strip() + """,
    r AS (SELECT page, f, t, t - f + 1 AS n, t = hi - 1 AS last, row_number() OVER (PARTITION BY page ORDER BY f) AS k FROM isl),
    fold AS (
      SELECT page, k, f, t, CASE WHEN last THEN NULL ELSE n END AS gap, last AS bound FROM r WHERE k = 1
      UNION ALL SELECT r.page, r.k, r.f, r.t,
        CASE WHEN CASE WHEN r.last THEN fold.gap IS NULL OR r.n > 2 * fold.gap ELSE fold.gap IS NOT NULL AND r.n > 5 * fold.gap END THEN NULL ELSE r.n END,
        CASE WHEN r.last THEN fold.gap IS NULL OR r.n > 2 * fold.gap ELSE fold.gap IS NOT NULL AND r.n > 5 * fold.gap END
      FROM fold JOIN r ON r.page = fold.page AND r.k = fold.k + 1
    ) SELECT page, ((f + t) / 2.0)::DOUBLE AS bound FROM fold WHERE bound UNION ALL SELECT page, hi::DOUBLE FROM edge""",
)
def row_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.row_histogram(_segments(spark, sf_dir), ["page"]).select("page", F.explode("bounds").alias("bound"))


@register(
    "header_bands",
    """WITH r AS (SELECT l_orderkey, list((l_suppkey * 7 % 300)::DOUBLE) AS rules FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, list_max(list_filter(rules, lambda x: x < 150)) AS above, list_min(list_filter(rules, lambda x: x > 160)) AS below FROM r""",
)
def header_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.lit(150.0).alias("top"), F.lit(160.0).alias("bottom"))
    rules = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_suppkey") * 7 % 300).cast("double")).alias("r"))
    return rules.select("l_orderkey", L.header_band(line, F.col("r")).alias("b")).select("l_orderkey", "b.above", "b.below")


@register(
    "page_kinds",
    """WITH k AS (SELECT page_id % 9 = 8 AS failed, page_id % 3 <> 0 AS has_text, contains(html, '<b>') AS has_images FROM pages)
    SELECT CASE WHEN failed THEN 'error' WHEN has_text THEN 'text' WHEN has_images THEN 'scan' ELSE 'unknown' END AS kind, count(*) AS pages FROM k GROUP BY ALL""",
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = L.page_kind(F.col("page_id") % 3 != 0, F.contains("html", F.lit("<b>")), F.col("page_id") % 9 == 8)
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages"))


@register(
    "word_grid",
    """WITH w AS (SELECT l_orderkey, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, (l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS n, l_returnflag || l_linenumber AS t FROM lineitem),
    g AS (SELECT l_orderkey, r AS row_idx, c AS col_idx FROM (SELECT DISTINCT l_orderkey FROM w), (VALUES (0), (1)) a(r), (VALUES (0), (1), (2)) b(c)),
    p AS (SELECT l_orderkey, CASE WHEN y >= 5 AND y < 25 THEN 0 WHEN y >= 25 AND y < 45 THEN 1 END AS row_idx, CASE WHEN x >= 0 AND x < 30 THEN 0 WHEN x >= 30 AND x < 60 THEN 1 WHEN x >= 60 AND x < 90 THEN 2 END AS col_idx, n, t FROM w)
    SELECT g.l_orderkey, g.row_idx, g.col_idx, coalesce(string_agg(t, ' ' ORDER BY n), '') AS text FROM g LEFT JOIN p ON p.l_orderkey = g.l_orderkey AND p.row_idx = g.row_idx AND p.col_idx = g.col_idx GROUP BY ALL""",
)
def word_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    idx = (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")
    words = items.select("l_orderkey", idx.alias("word_idx"), (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_suppkey") % 50).cast("double").alias("top"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    pages = blocks.select("l_orderkey").distinct()
    bounds = lambda *v: pages.select("l_orderkey", F.array(*[F.lit(float(x)) for x in v]).alias("bounds"))
    return L.grid_of_words(words, bounds(0, 30, 60, 90), bounds(5, 25, 45), KEY)


@register(
    "page_kind_counts",
    """SELECT page_id // 10 AS doc_id, count(*) FILTER (WHERE page_id % 9 <> 8 AND page_id % 3 <> 0) AS text, count(*) FILTER (WHERE page_id % 9 <> 8 AND page_id % 3 = 0 AND page_id % 2 = 0) AS scan,
      count(*) FILTER (WHERE page_id % 9 <> 8 AND page_id % 3 = 0 AND page_id % 2 = 1) AS unknown, count(*) FILTER (WHERE page_id % 9 = 8) AS error FROM pages GROUP BY ALL""",
)
def page_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    features = table(spark, sf_dir, "pages").select(
        F.floor(p / 10).alias("doc_id"), p.alias("page"), F.lit(False).alias("has_chars"), F.when(p % 3 != 0, F.col("html")).alias("text"), (p % 2 == 0).alias("has_images"), (p % 9 == 8).alias("failed")
    )
    return P.kind_counts(P.page_kinds(features))
