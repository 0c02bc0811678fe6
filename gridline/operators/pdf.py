"""Tables of PDF pages: ruled ones, or from the places of words where a document has no rules."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridline.functions import text as X
from gridline.model import HEADER_ANCHORS
from gridline.operators import layout as L
from gridline.operators import ruled as R
from gridline.operators import spans as S
from gridline.operators.tables import LEAST_GROUPS, SELECTED, anchor_score
from gridline.session import cut

PAGE = ["doc_id", "page"]
#: Lines below the header that shape the columns; words this near to a line's top belong to it.
LINES, NEAR = 30, 3.0
#: A rule that leans by less is horizontal.
STRAIGHT = 0.5
_BOX = ["x0", "x1", "top", "bottom"]


def page_kinds(features: DataFrame) -> DataFrame:
    """doc_id, page, kind, has_images of features(doc_id, page, has_chars, text, has_images, failed)."""
    has_text = F.col("has_chars") | (F.trim(F.coalesce("text", F.lit(""))) != "")
    kind = L.page_kind(F.coalesce(has_text, F.lit(False)), F.coalesce("has_images", F.lit(False)), F.coalesce("failed", F.lit(False)))
    return features.select(*PAGE, kind.alias("kind"), "has_images")


def kind_counts(kinds: DataFrame) -> DataFrame:
    """doc_id and the pages of each kind."""
    return kinds.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("text", "scan", "unknown", "error")])


def page_facts(words: DataFrame, pages: DataFrame | None = None, **others: DataFrame | None) -> DataFrame:
    """doc_id, page, words and each of others: the arrays of each page with words, of pages or all, dealt by page once.

    words: array<struct<top, x0, word_idx, x1, bottom, text>>, in that order;
    others: array<struct<x0, x1, top, bottom>> of boxes, or of whatever else a
    frame has, in no order.
    """
    double = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    rows = words.select(*PAGE, F.struct(*double("top", "x0"), "word_idx", *double("x1", "bottom"), "text").alias("words"))
    for name, frame in others.items():
        if frame is not None:
            more = [c for c in frame.columns if c not in (*PAGE, *_BOX)] if name == "bounds" else []
            part = frame.select(*PAGE, F.struct(*double(*[c for c in _BOX if c in frame.columns]), *more).alias(name))
            rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows if pages is None else rows.join(pages, PAGE, "left_semi")
    held = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list("words")).alias("words"), *[F.collect_list(n).alias(n) for n, f in others.items() if f is not None])
    boxes = "array<struct<x0:double,x1:double,top:double,bottom:double>>"
    return held.where(F.size("words") > 0).withColumns({n: F.array().cast(boxes) for n, f in others.items() if f is None})


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The elements of lists, and the number of each one's list."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), lists.flatten()


def _numbers(rows: pa.Array, name: str) -> np.ndarray:
    """A field of structs as numbers, null as NaN."""
    return pc.struct_field(rows, name).to_numpy(zero_copy_only=False)


def _said(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False)


def _of(lists: pa.Array) -> SimpleNamespace:
    """The words or boxes of pages as arrays: page, box and, of words, texts, which say something, and x0 with null before all numbers."""
    page, rows = _flat(lists)
    out = SimpleNamespace(page=page, **{c: _numbers(rows, c) for c in _BOX})
    if rows.type.get_field_index("text") >= 0:
        out.texts, out.begin = pc.struct_field(rows, "text"), pc.fill_null(pc.struct_field(rows, "x0"), -np.inf).to_numpy(zero_copy_only=False)
        out.said = _said(out.texts)
    return out


def _runs(words: SimpleNamespace, some: np.ndarray | slice, images: SimpleNamespace, low: str, high: str, n: int) -> S.Runs:
    """The empty runs of some words of n pages and of the images that overlap them in height."""
    top, bottom = S.extremes(words.page[some], words.top[some], words.bottom[some], n)
    beside = (images.bottom > top[images.page]) & (images.top < bottom[images.page])
    return S.empty_runs(*[np.concatenate([getattr(words, c)[some], getattr(images, c)[beside]]) for c in ("page", low, high)], n)


def _lines(page: np.ndarray, top: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line of each ordered word, the page of each line, and the words in reading order."""
    new = S.line_begins(np.append(True, page[1:] != page[:-1])[: len(page)], top, NEAR)
    line = np.cumsum(new) - 1
    return line, page[new], np.lexsort((begin, line))


def _grouped(texts: pa.Array, order: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The texts of each of n owners, in the given order, joined by spaces."""
    order = order[np.argsort(owner[order], kind="stable")]
    return S.joined(texts.take(pa.array(order)), np.searchsorted(owner[order], np.arange(n + 1)))


def _header_lines(line: np.ndarray, page: np.ndarray, order: np.ndarray, plain: pa.Array, n: int, anchors: dict[str, list[str]]) -> np.ndarray:
    """The number of each page's header line by its normalised words: the first of the highest score; without one, the first line."""
    texts = _grouped(plain, order[_said(plain)[order]], line, len(page))
    hit = lambda word: pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
    score = sum(np.any([hit(word) for word in group], axis=0).astype(int) for group in anchors.values())
    ranked = np.lexsort((-score, page))
    first = np.searchsorted(page, np.arange(n))
    best = ranked[first]
    return np.where(score[best] >= LEAST_GROUPS, best, first)


def _columns_of(words: pa.Array, plain: pa.Array, images: pa.Array, rules: pa.Array, anchors: dict[str, list[str]]) -> pa.Array:
    """The columns of documents by the facts of their first pages: where they begin and their titles, then where the last ends."""
    n, words, images, rules = len(words), _of(words), _of(images), _of(rules)
    own, (line, line_page, order) = words.page, _lines(words.page, words.top, words.begin)
    at = _header_lines(line, line_page, order, plain.flatten(), n, anchors)
    top, bottom = (edge[at] for edge in S.extremes(line, words.top, words.bottom, len(line_page)))
    level = np.abs(rules.top - rules.bottom) < STRAIGHT
    over, under = level & (rules.top < top[rules.page]), level & (rules.top > bottom[rules.page])
    above = S.extremes(rules.page[over], rules.top[over], rules.top[over], n)[1]
    below = S.extremes(rules.page[under], rules.top[under], rules.top[under], n)[0]
    banded = (~np.isnan(above) & ~np.isnan(below))[own]
    title = np.flatnonzero(np.where(banded, (words.top > above[own]) & (words.top < below[own]), line == at[own]))
    begin, end = S.extremes(own[title], line[title], line[title], n)
    group, bounds = S.column_bounds(_runs(words, (line >= begin[own]) & (line <= end[own] + LINES), images, "x0", "x1", n))

    held_by, col = own[title], S.interval_of(own[title], ((words.x0 + words.x1) / 2)[title], group, bounds, n)
    line, line_page, order = _lines(held_by, words.top[title], words.begin[title])
    wide, high = np.maximum(np.bincount(group, minlength=n) - 1, 0), np.bincount(line_page, minlength=n)
    part = (S.starts(wide * high)[:-1] - S.starts(high)[:-1])[held_by] + col * high[held_by] + line
    some = (col >= 0) & words.said[title]
    parts = _grouped(words.texts.take(pa.array(title)), order[some[order]], part, int((wide * high).sum()))
    titles = pc.utf8_trim(S.joined(parts, S.starts(np.repeat(high, wide))), " ")
    last = np.append(group[1:] != group[:-1], True)[: len(group)]
    column = pa.StructArray.from_arrays([pa.array(bounds), titles.take(pa.array(np.cumsum(~last) - 1, mask=last))], ["bound", "title"])
    return S.listed(column, np.bincount(group, minlength=n))


def _rows_of(words: pa.Array, images: pa.Array, bounds: pa.Array) -> pa.Array:
    """The rows of pages by the bounds of their documents' columns, after row -1 where bounds have titles."""
    n, words, images, (held_by, bounds) = len(words), _of(words), _of(images), _flat(bounds)
    own, (_, _, order) = words.page, _lines(words.page, words.top, words.begin)
    group, heights = S.row_bounds(_runs(words, slice(None), images, "top", "bottom", n))
    row, col = S.interval_of(own, words.top, group, heights, n), S.interval_of(own, words.x0, held_by, _numbers(bounds, "bound"), n)
    title = pc.struct_field(bounds, "title")
    titled = np.flatnonzero(title.is_valid().to_numpy(zero_copy_only=False))
    wide = np.maximum(np.bincount(held_by, minlength=n) - 1, 0)
    above = (np.bincount(held_by[titled], minlength=n) > 0).astype(int)
    high = np.where(wide > 0, np.maximum(np.bincount(group, minlength=n) - 1, 0) + above, 0)
    base = S.starts(wide * high)
    order = order[((row >= 0) & (col >= 0) & words.said)[order]]
    cell = (base[own] + (row + above[own]) * wide[own] + col)[order]
    cell = np.concatenate([cell, base[held_by[titled]] + _numbers(bounds, "col")[titled]])
    texts = pa.concat_arrays([words.texts.take(pa.array(order)), title.take(pa.array(titled))])
    texts = pc.utf8_trim(_grouped(texts, np.arange(len(cell)), cell, int(base[-1])), " ")
    page = np.repeat(np.arange(n), high)
    number = np.arange(len(page)) - S.starts(high)[page] - above[page]
    rows = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), S.listed(texts, wide[page])], ["row_idx", "cells"])
    return S.listed(rows, high)


def geometric_tables(words: DataFrame, anchors: dict[str, list[str]] = HEADER_ANCHORS, images: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """doc_id, page, row_idx, col_idx, text: a table for each page of words.

    words: doc_id, page, word_idx, x0, x1, top, bottom, text, of text pages
    only; images and rules: doc_id, page, x0, x1, top, bottom. The header is the
    line of the highest anchor score on a document's first page (without one,
    the first line) and all words between the horizontal rules next above and
    below it. Its lines and the 30 below shape the columns of all pages; all
    words of a page shape its rows. Images that overlap those words in height
    count as words do. Row -1 of the first page holds the titles, a title for
    each column. Words left of the first column bound or above the first row
    bound vanish. A document's columns are a short array, which meets its pages
    by a join; no word is shuffled by document. Words are dealt by page, first
    pages once more; NumPy reads many pages at a time, by sorts and running sums.
    """

    def columns(words: pa.Array, plain: pa.Array, images: pa.Array, rules: pa.Array) -> pa.Array:
        return _columns_of(words, plain, images, rules, anchors)

    pages = words.select(*PAGE).distinct()
    first = pages.groupBy("doc_id").agg(F.min("page").alias("page"))
    plain = F.transform("words", lambda w: X.normalize(w["text"]))
    found = F.arrow_udf(columns, "array<struct<bound:double,title:string>>")("words", plain, "images", "rules")
    heads = page_facts(words, first, images=images, rules=rules).select("doc_id", F.col("page").alias("_first"), found.alias("_columns"))
    bounds = pages.join(heads, "doc_id").select(*PAGE, "_first", F.posexplode_outer("_columns").alias("col", "_c")).where("col IS NOT NULL")
    bounds = bounds.select(*PAGE, "col", "_c.bound", F.when(F.col("page") == F.col("_first"), F.col("_c.title")).alias("title"))
    read = F.arrow_udf(_rows_of, "array<struct<row_idx:int,cells:array<string>>>")("words", "images", "bounds")
    rows = page_facts(words, images=images, bounds=bounds).select(*PAGE, F.explode_outer(read).alias("_r"))
    cells = rows.select(*PAGE, "_r.row_idx", F.posexplode_outer("_r.cells").alias("col_idx", "text"))
    return cells.where("row_idx IS NOT NULL AND col_idx IS NOT NULL")


def document_tables(words: DataFrame, rules: DataFrame, images: DataFrame | None = None, anchors: dict[str, list[str]] = HEADER_ANCHORS) -> DataFrame:
    """doc_id, page, table_idx, row_idx, col_idx, text, ruled: the tables of documents, cells normalised.

    A document with ruled tables on any page gives those whose first row is
    selected (tables.is_selected); one without any gives the tables of its
    words' places, a table of number 0 a page. Columns as in geometric_tables.
    """
    found = R.page_tables(words, rules)
    score = lambda c: F.coalesce(anchor_score(X.normalize(X.pdf_cell(c["text"])), anchors), F.lit(0))
    hits = F.aggregate(F.filter("cells", lambda c: c["row_idx"] == 0), F.lit(0), lambda n, c: n + score(c))
    chosen = found.where(hits >= SELECTED).select(*PAGE, "table_idx", F.inline("cells")).withColumn("text", X.pdf_cell(F.col("text")))
    ruled = cut(R.ruled_documents(rules))
    others = lambda df: None if df is None else df.join(ruled, "doc_id", "left_anti")
    shaped = geometric_tables(others(words), anchors, images, others(rules))
    shaped = shaped.select(*PAGE, F.lit(0).alias("table_idx"), "row_idx", "col_idx", "text", F.lit(False).alias("ruled"))
    return chosen.withColumn("ruled", F.lit(True)).unionByName(shaped)
