"""Spans, lines and intervals on pages of many words and on odd numbers."""

import time

import numpy as np

from gridline.operators import layout as L
from gridline.operators import pdf as P
from gridline.operators import spans as S

WORD = "doc_id int, page int, word_idx int, x0 double, x1 double, top double, bottom double, text string"
ANCHORS = {"a": ["alpha"], "b": ["beta"]}


def test_a_dense_page_costs_as_its_words(spark):
    blocks = 6000
    lines = [(60.0 * b + 12 * i, ("alpha", "beta", "gamma") if b == i == 0 else [f"{n}{b}.{i}" for n in "xyz"]) for b in range(blocks) for i in range(2)]
    words = [(1, 1, n, 100.0 * k, 100.0 * k + 50, top, top + 9, t) for n, (top, line) in enumerate(lines) for k, t in enumerate(line)]
    frame = spark.createDataFrame(words, WORD).cache()
    P.geometric_tables(frame.where("word_idx < 4"), ANCHORS).collect()  # start-up isn't the page's time
    began = time.perf_counter()
    got = {(r["row_idx"], r["col_idx"]): r["text"] for r in P.geometric_tables(frame, ANCHORS).collect()}
    assert time.perf_counter() - began < 30
    want = {(b - 1, c): f"{n}{b}.0 {n}{b}.1" for b in range(1, blocks) for c, n in enumerate("yz")}
    assert got == want | {(-1, 0): "beta", (-1, 1): "gamma"}


def test_nothing_of_a_page_is_folded_by_interpreted_functions(spark):
    frame = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, 1.0, 2.0, "w")], WORD)
    for df in (P.geometric_tables(frame, ANCHORS), L.column_histogram(frame, ["page"]), L.row_histogram(frame, ["page"])):
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_without_numbers(spark):
    words = [(1, 1, 0, 0.0, 10.0, 0.0, 9.0, "Alpha"), (1, 1, 1, 50.0, 60.0, 0.0, 9.0, "beta"), (1, 1, 2, 0.0, 10.0, None, 20.0, "gone"), (1, 1, 3, None, None, 12.0, 21.0, "lost"), (1, 1, 4, 50.0, 60.0, 12.0, 21.0, None), (None, 1, 0, 0.0, 1.0, 0.0, 1.0, "no document")]
    got = P.geometric_tables(spark.createDataFrame(words, WORD), ANCHORS).collect()
    assert "gone" not in str(got) and "lost" not in str(got) and {r["doc_id"] for r in got} <= {1}


def test_lines_begin_at_the_limit_and_anew_on_pages():
    new, nan = np.array([1, 0, 0, 0, 1, 0, 0, 0], bool), np.nan
    assert S.line_begins(new, np.array([0, 2.9, 3.0, 5.9, nan, nan, 1.0, 2.0]), 3.0).tolist() == [True, False, True, False, True, True, True, False]


def test_intervals_of_groups():
    owner, bounds = np.array([0, 0, 0, 2]), np.array([0.0, 10.0, 20.0, 5.0])
    group, x = np.array([0, 0, 0, 0, 1, 2, 0]), np.array([-1.0, 0.0, 10.0, 20.0, 5.0, 5.0, np.nan])
    assert S.interval_of(group, x, owner, bounds, 3).tolist() == [-1, 0, 1, -1, -1, -1, -1]


def test_edges_are_no_negative_zero():
    runs = S.empty_runs(np.array([0]), np.array([-3.0]), np.array([-0.5]), 1)
    assert str(S.column_bounds(runs)[1].tolist()) == "[-1.0, 0.0]"
