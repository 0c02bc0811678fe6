"""Queries on PDF pages whose words, rules and images are derived from orders and their line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.operators import pdf as P
from gridline.operators import ruled as R
from gridline.plans.register import register, table

#: Anchors that flags and states of line items hit.
ANCHORS = {"a": ["a"], "n": ["n"], "r": ["r"]}

_RUNS = """
{n}_edge AS (SELECT {k}, CAST(min(floor(a)) AS INTEGER) AS lo, CAST(max(ceil(b)) AS INTEGER) AS hi FROM {n}_s GROUP BY {k}),
{n}_cov AS (SELECT {k}, p FROM (SELECT {k}, unnest(range(CAST(floor(a) AS BIGINT), CAST(ceil(b) AS BIGINT))) AS p FROM {n}_s) GROUP BY ALL HAVING count(*) >= 2),
{n}_emp AS (SELECT {k}, lo, hi, p FROM (SELECT *, unnest(range(lo, hi)) AS p FROM {n}_edge) ANTI JOIN {n}_cov USING ({k}, p)),
{n}_isl AS (SELECT {k}, lo, hi, min(p) AS f, max(p) AS t FROM (SELECT *, p - row_number() OVER (PARTITION BY {k} ORDER BY p) AS run FROM {n}_emp) GROUP BY {k}, lo, hi, run)"""

#: Tables by places of w(doc_id, page, n, x0, x1, top, bottom, t), im (boxes) and ru (heights y), whose lines have tops of their own.
_BY_PLACES = f"""
lines AS (SELECT doc_id, page, top, lower(string_agg(t, ' ')) AS s, max(bottom) AS bottom FROM w GROUP BY ALL),
scored AS (SELECT *, contains(s, 'a')::INT + contains(s, 'n')::INT + contains(s, 'r')::INT AS score FROM lines QUALIFY page = min(page) OVER (PARTITION BY doc_id)),
head AS (SELECT doc_id, page, CASE WHEN max(score) >= 2 THEN arg_max(top, (score, -top)) ELSE min(top) END AS top FROM scored GROUP BY doc_id, page),
band AS (
  SELECT head.doc_id, head.page, head.top, max(y) FILTER (WHERE y < head.top) AS above, min(y) FILTER (WHERE y > bottom) AS below
  FROM head JOIN lines USING (doc_id, page, top) LEFT JOIN ru ON ru.doc_id = head.doc_id AND ru.page = head.page GROUP BY ALL
), hw AS (SELECT w.* FROM w JOIN band USING (doc_id, page) WHERE CASE WHEN above IS NOT NULL AND below IS NOT NULL THEN w.top > above AND w.top < below ELSE w.top = band.top END),
ranks AS (SELECT doc_id, page, top, row_number() OVER (PARTITION BY doc_id, page ORDER BY top) AS k FROM lines),
ext AS (SELECT doc_id, page, min(k) AS first, max(k) + 30 AS last FROM hw JOIN ranks USING (doc_id, page, top) GROUP BY ALL),
sw AS (SELECT w.* FROM w JOIN ranks USING (doc_id, page, top) JOIN ext USING (doc_id, page) WHERE k BETWEEN first AND last),
sy AS (SELECT doc_id, page, min(top) AS y0, max(bottom) AS y1 FROM sw GROUP BY ALL),
c_s AS (SELECT doc_id, x0 AS a, x1 AS b FROM sw UNION ALL SELECT doc_id, x0, x1 FROM im JOIN sy USING (doc_id, page) WHERE bottom > y0 AND top < y1), {_RUNS.format(n="c", k="doc_id").strip()},
cb AS (SELECT doc_id, list_append(coalesce(b, []), hi::DOUBLE) AS cb FROM c_edge LEFT JOIN (SELECT doc_id, list_sort(list(CASE WHEN t = hi - 1 THEN hi - 1 WHEN f = lo THEN lo ELSE (f + t) / 2.0 END::DOUBLE)) AS b FROM c_isl GROUP BY doc_id) USING (doc_id)),
py AS (SELECT doc_id, page, min(top) AS y0, max(bottom) AS y1 FROM w GROUP BY ALL),
r_s AS (SELECT doc_id, page, top AS a, bottom AS b FROM w UNION ALL SELECT doc_id, page, top, bottom FROM im JOIN py USING (doc_id, page) WHERE bottom > y0 AND top < y1), {_RUNS.format(n="r", k="doc_id, page").strip()},
runs AS (SELECT doc_id, page, f, t, t - f + 1 AS n, t = hi - 1 AS last, row_number() OVER (PARTITION BY doc_id, page ORDER BY f) AS k FROM r_isl),
fold AS (
  SELECT doc_id, page, k, f, t, CASE WHEN last THEN NULL ELSE n END AS gap, last AS bound FROM runs WHERE k = 1
  UNION ALL SELECT doc_id, page, k, f, t, CASE WHEN big THEN NULL ELSE n END, big FROM (
    SELECT runs.*, CASE WHEN runs.last THEN fold.gap IS NULL OR runs.n > 2 * fold.gap ELSE fold.gap IS NOT NULL AND runs.n > 5 * fold.gap END AS big
    FROM fold JOIN runs ON runs.doc_id = fold.doc_id AND runs.page = fold.page AND runs.k = fold.k + 1)
), rb AS (SELECT doc_id, page, list_append(coalesce(b, []), hi::DOUBLE) AS rb FROM r_edge LEFT JOIN (SELECT doc_id, page, list_sort(list(((f + t) / 2.0)::DOUBLE)) AS b FROM fold WHERE bound GROUP BY doc_id, page) USING (doc_id, page)),
bounds AS (SELECT doc_id, page, cb, rb FROM rb JOIN cb USING (doc_id)),
grid AS (SELECT doc_id, page, CAST(r AS INTEGER) AS row_idx, CAST(unnest(range(0, len(cb) - 1)) AS INTEGER) AS col_idx FROM (SELECT *, unnest(range(0, len(rb) - 1)) AS r FROM bounds)),
placed AS (SELECT doc_id, page, n, x0, top, t, len(list_filter(rb, lambda b: b <= top)) - 1 AS row_idx, len(list_filter(cb, lambda b: b <= x0)) - 1 AS col_idx FROM w JOIN bounds USING (doc_id, page)),
titles AS (SELECT doc_id, page, n, t, x0, top, len(list_filter(cb, lambda b: b <= (x0 + x1) / 2.0)) - 1 AS col_idx FROM hw JOIN cb USING (doc_id)),
title_grid AS (SELECT DISTINCT doc_id, page, top, CAST(c AS INTEGER) AS col_idx FROM (SELECT hw.doc_id, page, top, unnest(range(0, len(cb) - 1)) AS c FROM hw JOIN cb USING (doc_id))),
title_lines AS (SELECT doc_id, page, top, col_idx, coalesce(string_agg(t, ' ' ORDER BY x0, n), '') AS part FROM title_grid LEFT JOIN titles USING (doc_id, page, top, col_idx) GROUP BY ALL),
by_places AS (
  SELECT doc_id, page, row_idx, col_idx, coalesce(string_agg(t, ' ' ORDER BY top, x0, n), '') AS text FROM grid LEFT JOIN placed USING (doc_id, page, row_idx, col_idx) GROUP BY doc_id, page, row_idx, col_idx
  UNION ALL SELECT doc_id, page, -1, col_idx, trim(string_agg(part, ' ' ORDER BY top)) FROM title_lines GROUP BY doc_id, page, col_idx
)"""

#: Ruled tables of rules(doc_id, page, o, pos, lo, hi), o 'v' or 'h', and their words w, by corners that lie within 3 (else 5).
_RULED = """
snap0 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, page, o ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS new FROM rules),
snap1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, o ORDER BY pos) AS g FROM snap0),
snap2 AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id, page, o, g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS new2, avg(pos) OVER (PARTITION BY doc_id, page, o, g) AS mean FROM snap1),
snap3 AS (SELECT *, sum(new2) OVER (PARTITION BY doc_id, page, o, g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM snap2),
edges AS (SELECT doc_id, page, o, any_value(mean) AS pos, min(lo) AS lo, max(hi) AS hi, row_number() OVER () AS id FROM snap3 GROUP BY doc_id, page, o, g, run HAVING max(hi) - min(lo) >= 3),
corners AS (
  SELECT v.doc_id, v.page, cross_by, v.id AS v, h.id AS h, v.pos AS x, h.pos AS y
  FROM edges v JOIN edges h ON v.doc_id = h.doc_id AND v.page = h.page AND v.o = 'v' AND h.o = 'h', (VALUES (3), (5)) t(cross_by)
  WHERE v.lo <= h.pos + cross_by AND v.hi >= h.pos - cross_by AND v.pos >= h.lo - cross_by AND v.pos <= h.hi + cross_by
), cells0 AS (
  SELECT a.doc_id, a.page, a.cross_by, a.y AS top, a.x AS x0, min({'b': d.y, 'r': d.x}) AS far
  FROM corners a JOIN corners b ON a.doc_id = b.doc_id AND a.page = b.page AND a.cross_by = b.cross_by AND a.h = b.h AND b.x > a.x
  JOIN corners c ON a.doc_id = c.doc_id AND a.page = c.page AND a.cross_by = c.cross_by AND a.v = c.v AND c.y > a.y
  JOIN corners d ON a.doc_id = d.doc_id AND a.page = d.page AND a.cross_by = d.cross_by AND d.v = b.v AND d.h = c.h
  GROUP BY a.doc_id, a.page, a.cross_by, a.y, a.x
), cells1 AS (SELECT doc_id, page, cross_by, top, x0, far.b AS bottom, far.r AS x1, row_number() OVER () AS id FROM cells0),
points AS (SELECT doc_id, page, cross_by, id, unnest([top, top, bottom, bottom]) AS y, unnest([x0, x1, x0, x1]) AS x FROM cells1),
touch AS (SELECT DISTINCT a.id AS a, b.id AS b FROM points a JOIN points b ON a.doc_id = b.doc_id AND a.page = b.page AND a.cross_by = b.cross_by AND a.x = b.x AND a.y = b.y),
reach AS (SELECT a, b FROM touch UNION SELECT reach.a, touch.b FROM reach JOIN touch ON reach.b = touch.a),
member AS (SELECT a AS id, min(b) AS part, count(*) AS size FROM reach GROUP BY a),
cells2 AS (SELECT cells1.*, part FROM cells1 JOIN member USING (id) WHERE size > 1),
cells3 AS (SELECT * FROM cells2 QUALIFY cross_by = min(cross_by) OVER (PARTITION BY doc_id, page)),
firsts AS (SELECT doc_id, page, part, min({'y': top, 'x': x0}) AS corner FROM cells3 GROUP BY ALL),
numbers AS (SELECT doc_id, page, part, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY corner) - 1 AS INTEGER) AS table_idx FROM firsts),
cells AS (SELECT cells3.*, table_idx, dense_rank() OVER (PARTITION BY doc_id, page, part ORDER BY top) - 1 AS r, dense_rank() OVER (PARTITION BY doc_id, page, part ORDER BY x0) - 1 AS c FROM cells3 JOIN numbers USING (doc_id, page, part)),
sizes AS (SELECT doc_id, page, table_idx, max(r) AS mr, max(c) AS mc FROM cells GROUP BY ALL),
places AS (SELECT doc_id, page, table_idx, r, unnest(range(0, mc + 1)) AS c FROM (SELECT *, unnest(range(0, mr + 1)) AS r FROM sizes)),
held AS (
  SELECT w.doc_id, w.page, table_idx, r, c, w.top, string_agg(t, ' ' ORDER BY w.x0, n) AS line FROM w JOIN cells ON w.doc_id = cells.doc_id AND w.page = cells.page
    AND (w.x0 + w.x1) / 2 >= cells.x0 AND (w.x0 + w.x1) / 2 < cells.x1 AND (w.top + w.bottom) / 2 >= cells.top AND (w.top + w.bottom) / 2 < cells.bottom GROUP BY w.doc_id, w.page, table_idx, r, c, w.top
), held_texts AS (SELECT doc_id, page, table_idx, r, c, string_agg(line, chr(10) ORDER BY top) AS text FROM held GROUP BY ALL),
ruled AS (
  SELECT doc_id, page, table_idx, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx, CASE WHEN cells.x0 IS NOT NULL THEN coalesce(text, '') END AS text
  FROM places LEFT JOIN cells USING (doc_id, page, table_idx, r, c) LEFT JOIN held_texts USING (doc_id, page, table_idx, r, c)
)"""


def _double(c: Column) -> Column:
    return c.cast("double")


@register(
    "pdf_tables",
    f"""WITH RECURSIVE w AS (
      SELECT l_orderkey // 64 AS doc_id, CAST((l_orderkey // 32) % 2 AS INTEGER) AS page, (l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS n, (l_linenumber * 60 + l_partkey % 5)::DOUBLE AS x0,
        l_linenumber * 60 + l_partkey % 5 + 10 + CAST(l_quantity AS BIGINT) % 30 AS x1, ((l_suppkey * 7 + l_partkey) % 48 * 14)::DOUBLE AS top, (l_suppkey * 7 + l_partkey) % 48 * 14 + 9 AS bottom, l_returnflag || l_linestatus AS t FROM lineitem
    ), im AS (SELECT o_orderkey // 64 AS doc_id, CAST((o_orderkey // 32) % 2 AS INTEGER) AS page, 470 AS x0, 490 + o_custkey % 40 AS x1, -20 - o_custkey % 7 AS top, o_custkey % 17 - 8 AS bottom FROM orders WHERE o_orderkey % 32 = 5),
    ru AS (SELECT o_orderkey // 64 AS doc_id, CAST((o_orderkey // 32) % 2 AS INTEGER) AS page, (o_custkey % 50 * 14 - 3)::DOUBLE AS y FROM orders WHERE o_orderkey % 11 = 3), {_BY_PLACES.strip()}
    SELECT * FROM by_places""",
)
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words on pages of 48 lines, with images and rules, read as tables."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    place = lambda key: [F.floor(key / 64).alias("doc_id"), (F.floor(key / 32) % 2).cast("int").alias("page")]
    idx = (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")
    x = _double(F.col("l_linenumber") * 60 + F.col("l_partkey") % 5)
    top = _double((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 48 * 14)
    words = items.select(*place(F.col("l_orderkey")), idx.alias("word_idx"), x.alias("x0"), (x + 10 + F.col("l_quantity") % 30).alias("x1"), top.alias("top"), (top + 9).alias("bottom"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    box = lambda **c: [v.alias(k) for k, v in c.items()]
    customer = F.col("o_custkey")
    images = orders.where("o_orderkey % 32 = 5").select(*place(F.col("o_orderkey")), *box(x0=F.lit(470), x1=490 + customer % 40, top=-20 - customer % 7, bottom=customer % 17 - 8))
    height = _double(customer % 50 * 14 - 3)
    rules = orders.where("o_orderkey % 11 = 3").select(*place(F.col("o_orderkey")), *box(x0=F.lit(0.0), x1=F.lit(500.0), top=height, bottom=height))
    return P.geometric_tables(words, ANCHORS, images, rules)


#: An order is a page: its customer's number gives one or two grids of rules, some broken, shifted or left out.
_PAGES = """
o AS (SELECT o_orderkey // 3 AS doc_id, CAST(o_orderkey % 3 AS INTEGER) AS page, o_custkey AS k, 2 + o_custkey % 3 AS nc, 2 + (o_custkey // 3) % 4 AS nr FROM orders WHERE o_custkey % 7 <> 6 AND o_orderkey // 3 % 4 <> 3),
o2 AS (SELECT *, unnest(range(0, 1 + k % 2)) AS z FROM o),
g AS (SELECT *, unnest(range(0, nc + 1)) AS c FROM (SELECT *, unnest(range(0, nr + 1)) AS r FROM o2)),
rules AS (
  SELECT doc_id, page, 'h' AS o, (100 + 300 * z + r * 24 + (k + r * c) % 3)::DOUBLE AS pos, (50 + c * 80 + (k + c) % 4)::DOUBLE AS lo, (50 + (c + 1) * 80 - (k + r + c) % 2)::DOUBLE AS hi FROM g WHERE c < nc AND (k * 7 + r * 5 + c * 3) % 11 <> 0
  UNION ALL SELECT doc_id, page, 'v', (50 + c * 80 + (k + c * r) % 2)::DOUBLE, (100 + 300 * z + r * 24 + (k + r) % 5)::DOUBLE, (100 + 300 * z + (r + 1) * 24)::DOUBLE FROM g WHERE r < nr AND (k * 3 + r * 7 + c * 5) % 9 <> 0
), w AS (
  SELECT l_orderkey // 3 AS doc_id, CAST(l_orderkey % 3 AS INTEGER) AS page, (l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS n, (45 + l_partkey % 260)::DOUBLE AS x0, 45 + l_partkey % 260 + 10 + l_quantity AS x1,
    (96 + (l_suppkey + l_partkey) % 25 * 4 + l_linenumber % 2 * 300)::DOUBLE AS top, 105 + (l_suppkey + l_partkey) % 25 * 4 + l_linenumber % 2 * 300 AS bottom, l_returnflag || '.' || l_linestatus || ' ' || l_returnflag AS t FROM lineitem
)"""


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    idx = (c("l_partkey") * 1000000 + c("l_suppkey") * 10 + c("l_linenumber")) * 100 + c("l_quantity").cast("long")
    x, y = _double(45 + c("l_partkey") % 260), _double(96 + (c("l_suppkey") + c("l_partkey")) % 25 * 4 + c("l_linenumber") % 2 * 300)
    text = F.concat("l_returnflag", F.lit("."), "l_linestatus", F.lit(" "), "l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 3).alias("doc_id"), (c("l_orderkey") % 3).cast("int").alias("page"), idx.alias("word_idx"), x.alias("x0"), (x + 10 + c("l_quantity")).alias("x1"), y.alias("top"), (y + 9).alias("bottom"), text.alias("text"))


def _page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    orders = table(spark, sf_dir, "orders").where("o_custkey % 7 <> 6 AND floor(o_orderkey / 3) % 4 <> 3")
    orders = orders.select(F.floor(c("o_orderkey") / 3).alias("doc_id"), (c("o_orderkey") % 3).cast("int").alias("page"), c("o_custkey").alias("k"), (2 + c("o_custkey") % 3).alias("nc"), (2 + F.floor(c("o_custkey") / 3) % 4).alias("nr"))
    orders = orders.repartition("doc_id", "page")  # few splits, many rules, which are dealt by page so
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    grid = orders.select("*", each(c("k") % 2).alias("z")).select("*", each(c("nr")).alias("r")).select("*", each(c("nc")).alias("c"))
    k, r, z, at = c("k"), c("r"), c("z"), c("c")
    y = 100 + 300 * z + r * 24
    level, upright = y + (k + r * at) % 3, 50 + at * 80 + (k + at * r) % 2
    box = lambda *v: F.struct(*[_double(e).alias(n) for e, n in zip(v, ("x0", "x1", "top", "bottom"), strict=True)])
    across = F.when((at < c("nc")) & ((k * 7 + r * 5 + at * 3) % 11 != 0), box(50 + at * 80 + (k + at) % 4, 50 + (at + 1) * 80 - (k + r + at) % 2, level, level))
    down = F.when((r < c("nr")) & ((k * 3 + r * 7 + at * 5) % 9 != 0), box(upright, upright, y + (k + r) % 5, y + 24))
    return grid.select("doc_id", "page", F.explode(F.array(across, down)).alias("rule")).where("rule IS NOT NULL").select("doc_id", "page", "rule.*")


@register("ruled_tables", f"WITH RECURSIVE {_PAGES.strip()}, {_RULED.strip()} SELECT * FROM ruled")
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words on pages with grids of rules: every place of every table."""
    return R.ruled_tables(_page_words(spark, sf_dir), _page_rules(spark, sf_dir))


@register(
    "document_tables",
    f"""WITH RECURSIVE {_PAGES.strip().replace("), w AS (", "), every AS (")}, {_RULED.strip().replace("FROM w JOIN cells", "FROM every w JOIN cells")},
    normal AS (SELECT doc_id, page, table_idx, row_idx, col_idx, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM ruled),
    hits AS (SELECT doc_id, page, table_idx, sum(contains(lower(text), 'a')::INT + contains(lower(text), 'n')::INT + contains(lower(text), 'r')::INT) AS n FROM normal WHERE row_idx = 0 GROUP BY ALL),
    w AS (SELECT * FROM every ANTI JOIN ruled USING (doc_id)), im AS (SELECT 0::BIGINT AS doc_id, 0 AS page, 0 AS x0, 0 AS x1, 0 AS top, 0 AS bottom WHERE false), ru AS (SELECT doc_id, page, pos AS y FROM rules WHERE o = 'h'), {_BY_PLACES.strip()}
    SELECT normal.*, true AS ruled FROM normal JOIN hits USING (doc_id, page, table_idx) WHERE hits.n >= 3
    UNION ALL SELECT doc_id, page, 0, row_idx, col_idx, text, false FROM by_places""",
)
def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages' tables, normalised and chosen by their first row; documents without any, by the places of words."""
    return P.document_tables(_page_words(spark, sf_dir), _page_rules(spark, sf_dir), anchors=ANCHORS)
