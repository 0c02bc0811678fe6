"""Tables from boxes and words: joins by place, lines by gaps, columns by islands.

Everything is keyed by a document (and page or cell), so that range conditions
are residuals of equi-joins and windows never span the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridline.functions.geometry import iou
from gridline.operators import spans as S

LEAST_IOU = 0.05


def _box(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")}


def blocks_in_cells(blocks: DataFrame, cells: DataFrame, keys: list[str], least: float = LEAST_IOU) -> DataFrame:
    """keys, block_idx, cell_idx, method for every block that finds a cell.

    blocks: keys, block_idx, x1, y1, x2, y2; cells: keys, cell_idx and a box.
    Method 0: the block's centre lies in the cell, bounds included, lowest cell
    first. Method 1, for the others: the cell of the largest overlap, lowest
    first, from least on. The cells of a document are few and go to its blocks
    as one array, by one equi-join; no pair of block and cell is a row.
    """
    cell = F.struct("cell_idx", *[F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    held = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = F.filter("_cells", lambda c: cx.between(c["x1"], c["x2"]) & cy.between(c["y1"], c["y2"]))
    joined = blocks.select(*keys, "block_idx", *_box("").values()).join(held, keys).withColumn("_centre", F.get(inside, F.lit(0))["cell_idx"])
    overlaps = F.transform("_cells", lambda c: F.struct(iou(_box(""), {k: c[k] for k in ("x1", "y1", "x2", "y2")}).alias("iou"), (-c["cell_idx"]).alias("last")))
    best = joined.withColumn("_near", F.when(F.col("_centre").isNull(), F.array_max(overlaps)))
    found = best.where(F.col("_centre").isNotNull() | (F.col("_near.iou") >= least))
    return found.select(*keys, "block_idx", F.coalesce("_centre", -F.col("_near.last")).alias("cell_idx"), F.when(F.col("_centre").isNotNull(), 0).otherwise(1).alias("method"))


def cell_texts(blocks: DataFrame, cells: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell_idx, text of every cell: its blocks as lines, empty where it has none.

    Blocks in order of their middle height; one joins the line of the block
    before it unless the gap exceeds min(0.15 cell height, 0.5 mean block
    height, 15). Lines read from left to right and are ordered by the height of
    their leftmost block; a gap of 1.5 times the limit is a line break.
    """
    cell = [*keys, "cell_idx"]
    high = cells.select(*cell, (F.col("y2") - F.col("y1")).alias("_ch"))
    placed = blocks.join(assigned, [*keys, "block_idx"]).join(high, cell)
    placed = placed.select(*cell, "_ch", "method", "block_idx", "text", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("y2") - F.col("y1")).alias("_h"))
    whole, order = Window.partitionBy(*cell), Window.partitionBy(*cell).orderBy("cy", "method", "block_idx")
    limit = F.least(0.15 * F.col("_ch"), 0.5 * F.avg("_h").over(whole), F.lit(15.0))
    lined = placed.withColumn("_limit", limit).withColumn("_pos", F.row_number().over(order))
    new = (F.col("cy") - F.lag("cy").over(order) > F.col("_limit")).cast("int")
    lined = lined.withColumn("_line", F.sum(F.coalesce(new, F.lit(0))).over(order))
    lines = lined.groupBy(*cell, "_line").agg(F.first("_limit").alias("_limit"), F.sort_array(F.collect_list(F.struct("cx", "_pos", "cy", "text"))).alias("_b"))
    lines = lines.select(*cell, "_line", "_limit", F.get("_b", F.lit(0))["cy"].alias("_y"), F.array_join(F.transform("_b", lambda b: b["text"]), " ").alias("_t"))
    down = Window.partitionBy(*cell).orderBy("_y", "_line")
    gap = F.col("_y") - F.lag("_y").over(down)
    mark = F.when(gap.isNull(), "").when(gap > 1.5 * F.col("_limit"), "\n").otherwise(" ")
    parts = lines.withColumn("_n", F.row_number().over(down)).withColumn("_t", F.concat(mark, F.col("_t")))
    texts = parts.groupBy(*cell).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda p: p["_t"]), "").alias("text"))
    return cells.select(*cell).join(texts, cell, "left").na.fill("", ["text"])


def column_gaps(boxes: DataFrame, keys: list[str], width: int = 1200, least: int = 10) -> DataFrame:
    """keys, boundary: the middle of every gap wider than least between boxes, margins included."""
    a, b = F.greatest(F.col("x1"), F.lit(0)).cast("int"), F.least(F.col("x2"), F.lit(width - 1)).cast("int")
    spans = boxes.select(*keys, a.alias("a"), b.alias("b")).where("b > a")
    ends = boxes.select(*keys).distinct().select(*keys, F.lit(width).alias("a"), F.lit(width).alias("b"))
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.unionByName(ends).withColumn("_e", F.coalesce(F.max("b").over(before), F.lit(0)))
    return gaps.where(F.col("a") - F.col("_e") > least).select(*keys, F.floor((F.col("_e") + F.col("a")) / 2).cast("int").alias("boundary"))


def column_of(x: Column, bounds: Column) -> Column:
    """Column of a centre: the number of boundaries left of it; on a boundary it stays left."""
    return F.size(F.filter(bounds, lambda b: x > b))


def interval_of(x: Column, bounds: Column) -> Column:
    """Index of the half-open interval [b, next b) that holds x; null outside."""
    at = F.size(F.filter(bounds, lambda b: b <= x)) - 1
    return F.when((at >= 0) & (at < F.size(bounds) - 1), at)


def reconstruct(blocks: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_idx, col_idx, text: blocks ranked by height inside their column.

    Columns of unequal length are filled with empty cells at the bottom.
    """
    bounds = boundaries.groupBy(*keys).agg(F.sort_array(F.collect_list("boundary")).alias("_bounds"))
    column = column_of((F.col("x1") + F.col("x2")) / 2, F.coalesce("_bounds", F.array().cast("array<int>")))
    placed = blocks.join(bounds, keys, "left").withColumn("col_idx", column)
    order = Window.partitionBy(*keys, "col_idx").orderBy("y1", "block_idx")
    placed = placed.withColumn("row_idx", F.row_number().over(order) - 1)
    sizes = placed.groupBy(*keys).agg(F.max("row_idx").alias("_r"), F.max("col_idx").alias("_c"))
    grid = sizes.select(*keys, F.explode(F.sequence(F.lit(0), "_r")).alias("row_idx"), "_c").select(*keys, "row_idx", F.explode(F.sequence(F.lit(0), "_c")).alias("col_idx"))
    return grid.join(placed.select(*keys, "row_idx", "col_idx", "text"), [*keys, "row_idx", "col_idx"], "left").na.fill("", ["text"])


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_lines(words: Column, limit: float = 3.0) -> Column:
    """array<array<word>>: words (struct<top, x0, ...>, doubles) grouped by height, each line from left to right.

    A word joins the line if its top is less than limit below the line's first
    word. That depends on where a line began, so the heights at which lines
    begin come from a fold over the ordered words of one page, which keeps
    only those heights; each line then takes its words by their place.
    """
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, word: Column) -> Column:
        new = F.coalesce(word["top"] - state["top"] >= limit, F.lit(True))
        return F.struct(F.when(new, word["top"]).otherwise(state["top"]).alias("top"), (state["n"] + 1).alias("n"), F.when(new, F.array_append(state["at"], state["n"])).otherwise(state["at"]).alias("at"))

    def line_of(held: Column, begins: Column, at: Column, i: Column) -> Column:
        own = F.slice(held, at + 1, F.coalesce(F.get(begins, i + 1), F.size(held)) - at)
        read = F.sort_array(F.transform(own, lambda w, n: F.struct(w["x0"].alias("x0"), n.alias("n"), w.alias("w"))))
        return F.transform(read, lambda r: r["w"])

    return let(F.sort_array(words), lambda held: let(F.aggregate(held, start, step)["at"], lambda b: F.transform(b, lambda at, i: line_of(held, b, at, i))))


def lines_of(words: Column, limit: float = 3.0) -> Column:
    """array<struct<top, text>>: the lines of words (top, x0, text), at the height of their first word."""
    exact = F.transform(words, lambda w: F.struct(w["top"].cast("double").alias("top"), w["x0"].cast("double").alias("x0"), w["text"].alias("text")))
    line = lambda own: F.struct(F.array_min(F.transform(own, lambda w: w["top"])).alias("top"), F.array_join(F.transform(own, lambda w: w["text"]), " ").alias("text"))
    return F.transform(word_lines(exact, limit), line)


def _bounds(segments: DataFrame, keys: list[str], low: str, high: str, read: Callable[[S.Runs], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """keys, bounds of the segments of each key, which are dealt and ordered by key and read many keys at a time; null without segments."""
    span = segments.select(*keys, F.col(low).cast("double").alias("_lo"), F.col(high).cast("double").alias("_hi"))
    named = [f"{k} {span.schema[k].dataType.simpleString()}" for k in keys]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, begins in S.whole_groups(batches, keys, S.ROWS):
            n = int(begins.sum())
            group, at = read(S.empty_runs(np.cumsum(begins) - 1, held.column("_lo").to_numpy(), held.column("_hi").to_numpy(), n))
            sizes = np.bincount(group, minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(S.starts(sizes), pa.int32()), pa.array(at), mask=pa.array(sizes == 0))
            own = [held.column(k).take(pa.array(np.flatnonzero(begins))) for k in keys]
            yield from pa.table([*own, lists], names=[*keys, "bounds"]).combine_chunks().to_batches(S.ROWS)

    return span.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(bounds, ", ".join([*named, "bounds array<double>"]))


def column_histogram(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bounds: spans.column_bounds of the segments (x0, x1) of a page."""
    return _bounds(segments, keys, "x0", "x1", S.column_bounds)


def row_histogram(segments: DataFrame, keys: list[str], jump: float = 5.0, last: float = 2.0) -> DataFrame:
    """keys, bounds: spans.row_bounds of the segments (top, bottom) of a page."""
    return _bounds(segments, keys, "top", "bottom", lambda runs: S.row_bounds(runs, jump, last))


def header_band(line: Column, rules: Column) -> Column:
    """struct<above, below>: the nearest rules (heights) above and below a line (top, bottom); null where missing."""
    above = F.array_max(F.filter(rules, lambda r: r < line["top"]))
    below = F.array_min(F.filter(rules, lambda r: r > line["bottom"]))
    return F.struct(above.alias("above"), below.alias("below"))


def page_kind(has_text: Column, has_images: Column, failed: Column) -> Column:
    return F.when(failed, "error").when(has_text, "text").when(has_images, "scan").otherwise("unknown")


def grid_of_words(words: DataFrame, columns: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_idx, col_idx, text of every grid cell; words outside all cells vanish.

    words: keys, word_idx, x0, top, text; columns and rows: keys, bounds, of
    which neighbours enclose a half-open cell. A page's bounds are few, so a
    word finds its cell by array functions, without a range join.
    """
    both = columns.select(*keys, F.col("bounds").alias("_x")).join(rows.select(*keys, F.col("bounds").alias("_y")), keys)
    numbers = lambda b: F.when(F.size(b) > 1, F.sequence(F.lit(0), F.size(b) - 2)).otherwise(F.array().cast("array<int>"))
    grid = both.select(*keys, "_x", F.explode(numbers(F.col("_y"))).alias("row_idx")).select(*keys, "row_idx", F.explode(numbers(F.col("_x"))).alias("col_idx"))
    placed = words.join(both, keys).withColumn("col_idx", interval_of(F.col("x0"), F.col("_x"))).withColumn("row_idx", interval_of(F.col("top"), F.col("_y")))
    cell = [*keys, "row_idx", "col_idx"]
    texts = placed.where("row_idx IS NOT NULL AND col_idx IS NOT NULL").groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("word_idx", "text"))).alias("_w"))
    texts = texts.select(*cell, F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"))
    return grid.join(texts, cell, "left").na.fill("", ["text"])


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], ids: list[str], tile: float = 64.0, every: bool = False) -> DataFrame:
    """The columns of points and the ids of boxes, for each box that holds a point.

    points: keys, x, y; boxes: keys, ids, x0, x1, top, bottom, half-open. A
    point lies in one tile of its page and a box in those it touches; they meet
    by an equi-join of page and tile, so that a dense page isn't one key and
    each hit counts once. every: boxes are read once and none is lost; one
    without points in its first tile, or without bounds, has a row without a
    point as well.
    """
    number = lambda c: F.floor(c / tile).cast("int")
    explode = F.explode_outer if every else F.explode
    some = (F.col("x1") > F.col("x0")) & (F.col("bottom") > F.col("top"))
    across = lambda a, b: explode(F.when(some, F.sequence(number(F.col(a)), number(F.col(b)))))
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")]).alias("_box")
    tiles = boxes.select(*keys, *ids, box, across("x0", "x1").alias("_tx"), "x0", "x1", "top", "bottom")
    tiles = tiles.select(*keys, *ids, "_box", "_tx", across("top", "bottom").alias("_ty"))
    placed = points.withColumns({"_tx": number(F.col("x")), "_ty": number(F.col("y"))})
    inside = F.expr("p.x >= _box.x0 AND p.x < _box.x1 AND p.y >= _box.top AND p.y < _box.bottom")
    same = [F.col(f"b.{k}") == F.col(f"p.{k}") for k in [*keys, "_tx", "_ty"]]
    met = tiles.alias("b").join(placed.alias("p"), reduce(and_, [*same, inside]), "left" if every else "inner")
    if every:
        first = (F.col("b._tx") == number(F.col("_box.x0"))) & (F.col("b._ty") == number(F.col("_box.top")))
        met = met.where(F.col("p.x").isNotNull() | F.coalesce(first, F.lit(True)))
    return met.select(*[f"b.{c}" if c in keys else f"p.{c}" for c in points.columns], *[f"b.{c}" for c in ids])


def has_table(labels: Column, blocks: Column) -> Column:
    """True for a recognition result with a region labelled table and at least one text block."""
    return F.coalesce(F.exists(labels, lambda x: x == "table") & (F.size(blocks) > 0), F.lit(False))


def tables_of_results(results: DataFrame, keys: list[str], width: int = 1200, least: int = 10) -> DataFrame:
    """keys, row_idx, col_idx, text of every result with a table.

    results: keys, labels array<string>, blocks array<struct<x1, y1, x2, y2,
    text>>, cell_boxes array<struct<x1, y1, x2, y2>> (null: none). Column
    boundaries come from the blocks; texts from cells where there are any,
    else from the blocks themselves.
    """
    kept = results.where(has_table(F.col("labels"), F.col("blocks")))
    box = ["x1", "y1", "x2", "y2"]
    blocks = kept.select(*keys, F.size(F.coalesce("cell_boxes", F.array())).alias("_cells"), F.posexplode("blocks").alias("block_idx", "_b"))
    blocks = blocks.select(*keys, "_cells", "block_idx", *[F.col("_b")[c].cast("double").alias(c) for c in box], F.col("_b")["text"].alias("text"))
    cells = kept.select(*keys, F.posexplode("cell_boxes").alias("cell_idx", "_c")).select(*keys, "cell_idx", *[F.col("_c")[c].cast("double").alias(c) for c in box])
    filled = cell_texts(blocks, cells, blocks_in_cells(blocks, cells, keys), keys)
    merged = cells.join(filled, [*keys, "cell_idx"]).select(*keys, F.col("cell_idx").alias("block_idx"), *box, "text")
    plain = blocks.where("_cells = 0").select(*keys, "block_idx", *box, "text")
    return reconstruct(merged.unionByName(plain), column_gaps(blocks, keys, width, least), keys)
