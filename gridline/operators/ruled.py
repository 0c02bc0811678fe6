"""Tables that a page's ruling lines enclose.

Rules that nearly coincide are snapped to one line and joined over small gaps.
Where a vertical and a horizontal one cross is a corner; the least rectangle
right and below of a corner whose four sides run along rules is a cell; cells
that share corners are a table. Rules are dealt and ordered by page once, and those
of many pages are read at a time, by NumPy; no pair of rules is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridline.operators.layout import let
from gridline.operators.spans import line_begins, whole_groups

PAGE = ["doc_id", "page"]
#: Rules this near are one line; ends this near are joined; shorter ones are none.
SNAP, JOIN, LEAST = 3.0, 3.0, 3.0
#: How far a rule may miss another at a corner: the second if the first finds no table on a page.
CROSS = (3.0, 5.0)
#: A rule that leans by less is straight.
STRAIGHT = 0.5
#: Pairs of edges or corners that are compared at a time.
PAIRS = 1 << 20
#: Rules that are read at a time, and places that are handed on.
ROWS = 1 << 16
_BOX = ["x0", "x1", "top", "bottom"]


def runs(held: Column, apart) -> Column:
    """A sorted array cut into arrays wherever apart(element, next) holds."""
    begins = F.filter(F.transform(held, lambda e, i: F.when((i == 0) | apart(F.get(held, i - 1), e), i)), lambda i: i.isNotNull())
    return let(begins, lambda b: F.transform(b, lambda at, k: F.slice(held, at + 1, F.coalesce(F.get(b, k + 1), F.size(held)) - at)))


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n items of some counts: the item of each of their places, and the place's number in its item."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _chunks(counts: np.ndarray) -> Iterator[slice]:
    """Slices of items whose counts add up to PAIRS or are one item's."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        yield slice(start, stop)
        start = stop


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Whether an item of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Edges(NamedTuple):
    """Edges of one direction of many pages, in order of page and place."""

    page: np.ndarray
    pos: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def snapped(edges: Edges, snap: float = SNAP, join: float = JOIN, least: float = LEAST) -> Edges:
    """Edges of one direction, near ones of a page moved to their mean and joined, in order."""
    by_place = np.lexsort((edges.hi, edges.lo, edges.pos, edges.page))
    page, pos, lo, hi = (c[by_place] for c in edges)
    if not len(page):
        return edges
    apart = _begins(page)
    apart[1:] |= ~(pos[1:] - pos[:-1] <= snap)
    line = np.cumsum(apart) - 1
    mean = np.bincount(line, pos) / np.bincount(line)
    along = np.lexsort((hi, lo, line))
    page, lo, hi = page[along], lo[along], hi[along]
    values, rank = np.unique(hi, return_inverse=True)
    reach = values[np.maximum.accumulate(rank + line * len(values)) - line * len(values)]  # the largest hi of the line so far
    new = _begins(line)
    new[1:] |= ~(lo[1:] <= reach[:-1] + join)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    long = reach[last] - lo[first] >= least
    first, last = first[long], last[long]
    return Edges(page[first], mean[line[first]], lo[first], reach[last])


def _corners(v: Edges, h: Edges, cross: float) -> tuple[np.ndarray, np.ndarray]:
    """(horizontal, vertical) numbers of edges that meet, in order."""
    empty = np.zeros(0, np.int64)
    found = [(empty, empty)]
    start, stop = np.searchsorted(v.page, h.page, "left"), np.searchsorted(v.page, h.page, "right")
    for part in _chunks(stop - start):
        own, at = _counted((stop - start)[part])
        j = own + part.start
        i = start[j] + at
        meets = (v.lo[i] <= h.pos[j] + cross) & (v.hi[i] >= h.pos[j] - cross) & (v.pos[i] >= h.lo[j] - cross) & (v.pos[i] <= h.hi[j] + cross)
        found.append((j[meets], i[meets]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def lattice(v: Edges, h: Edges, cross: float) -> np.ndarray:
    """Rows (page, top, x0, bottom, x1) of the cells between snapped edges, in reading order.

    Each corner looks down its vertical edge, one corner a round, until it and
    the corner there have one to the right on a common vertical edge.
    """
    j, i = _corners(v, h, cross)
    n, width = len(j), max(len(v.pos), 1)
    key = j * width + i
    ends = np.searchsorted(j, j, "right")
    down = np.lexsort((j, i))
    below = np.full(n, -1)
    same = i[down[1:]] == i[down[:-1]]
    below[down[:-1][same]] = down[1:][same]
    right, under = np.full(n, -1), below.copy()
    looking = np.flatnonzero(under >= 0)
    while len(looking):
        deep = h.pos[j[under[looking]]] > h.pos[j[looking]]
        counts = np.where(deep, ends[looking] - looking - 1, 0)
        for part in _chunks(counts):
            own, at = _counted(counts[part])
            corner = looking[part][own]
            k = i[corner + 1 + at]
            sought = j[under[corner]] * width + k
            hit = np.minimum(np.searchsorted(key, sought), n - 1)
            fits = (key[hit] == sought) & (v.pos[k] > v.pos[i[corner]])
            of, first = np.unique(corner[fits], return_index=True)
            right[of] = k[fits][first]
        looking = looking[right[looking] < 0]
        under[looking] = below[under[looking]]
        looking = looking[under[looking] >= 0]
    c = np.flatnonzero(right >= 0)
    cells = np.column_stack([h.page[j[c]], h.pos[j[c]], v.pos[i[c]], h.pos[j[under[c]]], v.pos[right[c]]]).astype(float)
    cells = cells[np.lexsort(cells.T[::-1])]
    return cells[_begins(*cells.T[:3])]


def connected(cells: np.ndarray) -> np.ndarray:
    """For each cell the number of the first one that it reaches over shared corners, itself included."""
    n = len(cells)
    points = np.concatenate([cells[:, [0, y, x]] for y in (1, 3) for x in (2, 4)])
    order = np.lexsort(points.T[::-1])
    begins = np.flatnonzero(_begins(*points[order].T))
    owner = order % max(n, 1)
    label = np.arange(n)
    while n:
        least = np.minimum.reduceat(label[owner], begins)
        near = np.repeat(least, np.diff(np.append(begins, len(owner))))
        new = label.copy()
        np.minimum.at(new, owner, near)
        np.minimum.at(new, label[owner], near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def numbered(cells: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """page, table, row, column and cell (-1: none) of each place of the tables, which have several cells."""
    kept = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    kept = kept[np.argsort(label[kept], kind="stable")]
    page, top, x0 = cells[kept, 0], cells[kept, 1], cells[kept, 2]
    begins = _begins(label[kept])
    table = np.cumsum(begins) - 1
    count = int(begins.sum())

    def levels(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each cell's value among its table's, and how many there are."""
        order = np.lexsort((value, table))
        total = np.cumsum(_begins(table[order], value[order]))
        out, first = np.empty(len(value), np.int64), np.searchsorted(table[order], np.arange(count))
        out[order] = total - total[first][table[order]] if count else total
        sizes = np.zeros(count, np.int64)
        np.maximum.at(sizes, table, out + 1)
        return out, sizes

    (row, rows), (col, cols) = levels(top), levels(x0)
    start = np.cumsum(rows * cols) - rows * cols
    own, at = _counted(rows * cols)
    held = np.full(len(own), -1)
    held[start[table] + row * cols[table] + col] = kept
    pages = page[begins]
    number = np.arange(count) - np.searchsorted(pages, pages)
    return pages[own].astype(np.int64), number[own], at // cols[own], at % cols[own], held


def edges_of(page: np.ndarray, rules: dict[str, np.ndarray], horizontal: bool) -> Edges:
    """Edges of one direction of rules (x0, x1, top, bottom); slanted rules are none."""
    a, b, c, d = (rules[n] for n in (("top", "bottom", "x0", "x1") if horizontal else ("x0", "x1", "top", "bottom")))
    straight = (np.abs(a - b) < STRAIGHT) & (np.abs(c - d) >= STRAIGHT)
    return Edges(page[straight], a[straight], np.minimum(c, d)[straight], np.maximum(c, d)[straight])


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole pages of batches ordered by page, ROWS rows or more at a time, and where pages begin."""
    return whole_groups(batches, PAGE, ROWS)


def places(page: np.ndarray, rules: dict[str, np.ndarray], cross: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """page, table, row, column, top, x0, bottom, x1 of all places of the ruled tables of numbered pages; NaN without a cell."""
    v, h = snapped(edges_of(page, rules, False)), snapped(edges_of(page, rules, True))
    out = []
    for near in cross:
        cells = lattice(v, h, near)
        *where, held = numbered(cells, connected(cells))
        bounds = np.where(held[:, None] >= 0, np.append(cells[:, 1:], [[np.nan] * 4], axis=0)[held], np.nan)
        out.append((*where, *bounds.T))
        v, h = (Edges(*[c[~np.isin(e.page, where[0])] for c in e]) for e in (v, h))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def rectangle_edges(boxes: DataFrame) -> DataFrame:
    """The four sides of boxes(doc_id, page, x0, x1, top, bottom) as rules."""
    side = lambda a, b, c, d: F.struct(F.col(a).alias("x0"), F.col(b).alias("x1"), F.col(c).alias("top"), F.col(d).alias("bottom"))
    sides = F.array(side("x0", "x1", "top", "top"), side("x0", "x1", "bottom", "bottom"), side("x0", "x0", "top", "bottom"), side("x1", "x1", "top", "bottom"))
    return boxes.select(*PAGE, F.explode(sides).alias("_s")).select(*PAGE, "_s.*")


def ruled_cells(rules: DataFrame, cross: tuple[float, ...] = CROSS) -> DataFrame:
    """doc_id, page, table_idx, row_idx, col_idx, top, x0, bottom, x1: the grid places of all ruled tables.

    rules: doc_id, page, x0, x1, top, bottom. The first tolerance of cross that
    finds a table on a page counts. Places where a table has no cell of its own
    (merged with another, or missing) have null bounds. Null and slanted rules
    are left out; pages without tables have no rows.
    """
    rows = rules.dropna(subset=_BOX).select(*PAGE, *[F.col(c).cast("double").alias(c) for c in _BOX])
    keys = [f"{c} {rules.schema[c].dataType.simpleString()}" for c in PAGE]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, begins in _whole_pages(batches):
            page, *numbers, top, x0, bottom, x1 = places(np.cumsum(begins) - 1, {n: held.column(n).to_numpy() for n in _BOX}, cross)
            at = pa.array(np.flatnonzero(begins)[page])
            own = [held.column(c).take(at) for c in PAGE]
            bounds = [pa.array(b, mask=np.isnan(b)) for b in (top, x0, bottom, x1)]
            found = pa.table([*own, *[pa.array(n.astype(np.int32)) for n in numbers], *bounds], names=[*PAGE, "table_idx", "row_idx", "col_idx", "top", "x0", "bottom", "x1"])
            yield from found.combine_chunks().to_batches(ROWS)

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(read, ", ".join([*keys, "table_idx int, row_idx int, col_idx int, top double, x0 double, bottom double, x1 double"]))


def _by_page(rules: DataFrame) -> DataFrame:
    """doc_id, page and the rules of each page as an array; rules that are dealt by page already stay where they are."""
    rows = rules.dropna(subset=_BOX).select(*PAGE, F.struct(*[F.col(c).cast("double").alias(c) for c in _BOX]).alias("rule"))
    return rows.groupBy(*PAGE).agg(F.collect_list("rule").alias("rules"))


def _pages(batches: Iterator[pa.RecordBatch], lists: list[str]) -> Iterator[pa.Table]:
    """Pages of batches whose lists hold ROWS items or more together, or of one batch."""
    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.list_value_length(batch.column(n)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in lists))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ROWS)) + 1
            yield pa.Table.from_batches([batch.slice(start, stop - start)]).combine_chunks()
            start = stop


def _items(pages: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """The number of its page for each item of a column of lists, and the items."""
    lists = pages.column(name).combine_chunks()
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64), pc.list_flatten(lists)


def _places_of(pages: pa.Table, cross: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    page, rules = _items(pages, "rules")
    return places(page, {n: pc.struct_field(rules, n).to_numpy(zero_copy_only=False) for n in _BOX}, cross)


def ruled_documents(rules: DataFrame, cross: tuple[float, ...] = CROSS) -> DataFrame:
    """The distinct doc_id of ruled tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _pages(batches, ["rules"]):
            at = np.unique(_places_of(pages, cross)[0])
            yield from pa.table([pages.column("doc_id").take(pa.array(at))], names=["doc_id"]).combine_chunks().to_batches()

    return _by_page(rules).mapInArrow(read, f"doc_id {rules.schema['doc_id'].dataType.simpleString()}").distinct()


def _held(box: tuple[np.ndarray, ...], place_page: np.ndarray, page: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) of all words (x, y) in half-open boxes (top, x0, bottom, x1) of their pages, in order. Only words at a box's height are compared."""
    top, x0, bottom, x1 = box
    values = np.unique(y[~np.isnan(y)])
    width = len(values) + 2
    down = np.lexsort((y, page))
    key = page[down] * width + np.searchsorted(values, y[down])  # NaN comes last on its page
    key[np.isnan(y[down])] = page[down][np.isnan(y[down])] * width + width - 1
    level = lambda v: place_page * width + np.searchsorted(values, v)
    some = bottom > top  # not without a cell
    start, stop = np.searchsorted(key, level(top)), np.searchsorted(key, level(np.where(some, bottom, np.inf)))
    counts = np.where(some, np.maximum(stop - start, 0), 0)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part in _chunks(counts):
        own, at = _counted(counts[part])
        place = own + part.start
        word = down[start[place] + at]
        inside = (x[word] >= x0[place]) & (x[word] < x1[place])
        found.append((place[inside], word[inside]))
    place, word = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.lexsort((word, place))
    return place[order], word[order]


def _texts(place: np.ndarray, word: np.ndarray, top: np.ndarray, x0: np.ndarray, texts: pa.Array, n: int, near: float) -> pa.Array:
    """The text of each of n places from its words: lines from left to right."""
    new = _begins(place)
    begins = line_begins(new, top[word], near)
    order = np.lexsort((x0[word], np.cumsum(begins)))  # lines keep their places
    marks = pa.DictionaryArray.from_arrays(pa.array(np.where(new, 0, np.where(begins, 1, 2)).astype(np.int8)), pa.array(["", "\n", " "])).cast(pa.string())
    parts = pc.binary_join_element_wise(marks, texts.take(pa.array(word[order])).cast(pa.string()), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(place, np.arange(n + 1)).astype(np.int32)), parts), "")


def page_tables(words: DataFrame, rules: DataFrame, cross: tuple[float, ...] = CROSS, near: float = 3.0) -> DataFrame:
    """doc_id, page, table_idx, cells array<struct<row_idx, col_idx, text>>: ruled_tables, a row for each table.

    Words and rules are dealt by page once and meet there; NumPy reads many
    pages at a time. Neither cells nor their words are shuffled.
    """
    double = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    word = F.struct(*double("top", "x0"), "word_idx", "text", *double("x1", "bottom"))
    own = words.where(F.col("text").isNotNull()).select(*PAGE, word.alias("word")).groupBy(*PAGE).agg(F.sort_array(F.collect_list("word")).alias("words"))
    plain = F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in ("top", "x0", "text", "x1", "bottom")]))
    pages = _by_page(rules).join(own, PAGE, "left").select(*PAGE, "rules", plain.alias("words"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pages(batches, ["rules", "words"]):
            page, table, row, col, *box = _places_of(held, cross)
            of, items = _items(held, "words")
            at = {n: pc.struct_field(items, n).to_numpy(zero_copy_only=False) for n in _BOX}
            place, word = _held(tuple(box), page, of, (at["x0"] + at["x1"]) / 2, (at["top"] + at["bottom"]) / 2)
            texts = _texts(place, word, at["top"], at["x0"], pc.struct_field(items, "text"), len(page), near)
            texts = pc.if_else(pa.array(np.isnan(box[0])), pa.scalar(None, pa.string()), texts)
            begins = np.flatnonzero(_begins(page, table))
            cells = pa.StructArray.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), texts], ["row_idx", "col_idx", "text"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(page)).astype(np.int32)), cells)
            keys = [held.column(c).take(pa.array(page[begins])) for c in PAGE]
            found = pa.table([*keys, pa.array(table[begins].astype(np.int32)), lists], names=[*PAGE, "table_idx", "cells"])
            yield from found.combine_chunks().to_batches(ROWS)

    named = [f"{c} {rules.schema[c].dataType.simpleString()}" for c in PAGE]
    return pages.mapInArrow(read, ", ".join([*named, "table_idx int, cells array<struct<row_idx:int,col_idx:int,text:string>>"]))


def ruled_tables(words: DataFrame, rules: DataFrame, cross: tuple[float, ...] = CROSS, near: float = 3.0) -> DataFrame:
    """doc_id, page, table_idx, row_idx, col_idx, text of all places of ruled tables.

    words: doc_id, page, word_idx, x0, x1, top, bottom, text. A cell holds the
    words whose middles lie in it, as lines from top to bottom, joined by line
    breaks; without words it's empty, a place without a cell is null. Words
    outside all tables vanish.
    """
    return page_tables(words, rules, cross, near).select(*PAGE, "table_idx", F.inline("cells"))
