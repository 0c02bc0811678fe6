"""Spans, lines and intervals of many pages at a time, by NumPy.

Rows are dealt and ordered by their keys in Spark; a task reads batches of whole
groups (pages), numbered from 0. All steps are sorts, running sums and single
passes, so a group's work grows as its rows and their order do, not with their
square.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are read at a time, and places that are handed on.
ROWS = 1 << 16


def _begins(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before it."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in (rows.column(name) for name in keys):
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy()
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of batches ordered by keys, most rows or more at a time, and where groups begin."""
    held, size, least = [], 0, most
    for batch in batches:
        held, size = [*held, pa.Table.from_batches([batch])], size + batch.num_rows
        if size >= least:
            rows = pa.concat_tables(held)
            begins = _begins(rows, keys)
            last = int(np.flatnonzero(begins)[-1])
            if last:
                yield rows.slice(0, last), begins[:last]
            held, size = [rows.slice(last)], size - last
            least = max(most, 2 * size)
    if size:
        rows = pa.concat_tables(held)
        yield rows, _begins(rows, keys)


def extremes(group: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least low and the greatest high of each of n groups; NaN without any."""
    least, most = np.full(n, np.nan), np.full(n, np.nan)
    np.fmin.at(least, group, low)
    np.fmax.at(most, group, high)
    return least, most


class Runs(NamedTuple):
    """Runs of pixels that fewer than two spans cover, in order, and what encloses the spans of each group."""

    group: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray


def empty_runs(group: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> Runs:
    """The empty runs of the spans of n groups.

    A span is two events, at its first pixel and behind its last; running sums
    over the ordered events tell how many cover what lies between two of them.
    """
    low, high = np.floor(low) + 0.0, np.ceil(high) + 0.0  # no negative zero
    left, right = extremes(group, low, high, n)
    wide, edged = high > low, np.flatnonzero(~np.isnan(left) & ~np.isnan(right))
    at = np.concatenate([low[wide], high[wide], left[edged], right[edged]])
    own = np.concatenate([group[wide], group[wide], edged, edged])
    step = np.repeat([1, -1, 0], [wide.sum(), wide.sum(), 2 * len(edged)])
    order = np.lexsort((at, own))
    at, own, cover = at[order], own[order], np.cumsum(step[order])
    behind = np.append((at[1:] != at[:-1]) | (own[1:] != own[:-1]), True)[: len(at)]
    at, own, cover = at[behind], own[behind], cover[behind]
    empty = (own[1:] == own[:-1]) & (cover[:-1] < 2)
    begin, end = empty & ~np.append(False, empty)[: len(empty)], empty & ~np.append(empty[1:], False)[: len(empty)]
    return Runs(own[:-1][begin], at[:-1][begin], at[1:][end] - 1, left, right)


def _closed(runs: Runs, group: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of groups, then the right edge of each."""
    edged = np.flatnonzero(~np.isnan(runs.right))
    group = np.concatenate([group, edged])
    order = np.argsort(group, kind="stable")
    return group[order], np.concatenate([bounds, runs.right[edged]])[order]


def column_bounds(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """group, bound: the middles of empty runs, then the right edge.

    A leading run counts at the left edge, a trailing one at its last pixel.
    """
    left, end = runs.left[runs.group], runs.right[runs.group] - 1
    return _closed(runs, runs.group, np.where(runs.last == end, end, np.where(runs.first == left, left, (runs.first + runs.last) / 2)))


def row_bounds(runs: Runs, jump: float = 5.0, last: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """group, bound: the middles of empty runs that are jump times the one before, then the bottom.

    After such a jump the comparison starts anew; a run at the bottom needs
    only last times, and no run before it.
    """
    kept, gap, before = [], None, None
    for group, size, end in zip(runs.group.tolist(), (runs.last - runs.first + 1).tolist(), (runs.last == runs.right[runs.group] - 1).tolist(), strict=True):
        gap = gap if group == before else None
        big = end if gap is None else size > (last if end else jump) * gap
        kept.append(big)
        gap, before = None if big else size, group
    big = np.array(kept, bool)
    return _closed(runs, runs.group[big], ((runs.first + runs.last) / 2)[big])


def line_begins(new: np.ndarray, top: np.ndarray, limit: float) -> np.ndarray:
    """Whether a line begins at a word: on a new page, or where its top is limit or more below the line's first word.

    That depends on where a line began, so it's one pass over ordered words. A
    word without a top is a line of its own.
    """
    out, began = [], 0.0
    for first, at in zip(new.tolist(), top.tolist(), strict=True):
        first = first or not at - began < limit
        out.append(first)
        began = at if first else began
    return np.array(out, bool)


def interval_of(group: np.ndarray, x: np.ndarray, owner: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Number of the half-open interval between its group's bounds that holds x; -1 outside."""
    size = np.bincount(owner, minlength=n)
    order = np.lexsort((np.repeat([0, 1], [len(bounds), len(x)]), np.concatenate([bounds, x]), np.concatenate([owner, group])))
    seen = np.empty(len(order), np.int64)
    seen[order] = np.cumsum(order < len(bounds))
    at = seen[len(bounds) :] - (np.cumsum(size) - size)[group] - 1
    return np.where((at >= 0) & (at < size[group] - 1), at, -1)


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each of counted runs begins, then where the last ends."""
    return np.append(0, np.cumsum(counts)).astype(np.int64)


def listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Values as lists of counted lengths."""
    return pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), values)


def joined(texts: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Texts between neighbouring offsets, joined by spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), pa.scalar(" ", texts.type))
