"""Geometry against plain loops on random boxes."""

import random

import pytest
from pyspark.sql import functions as F

from gridline.operators import layout as L

BOX = "doc int, block_idx int, x1 double, y1 double, x2 double, y2 double, text string"


def boxes(rng, docs=25, most=12):
    rows = []
    for d in range(docs):
        for i in range(rng.randint(1, most)):
            x, y = rng.randint(-30, 1150), rng.randint(0, 300)
            rows.append((d, i, float(x), float(y), float(x + rng.randint(0, 260)), float(y + rng.randint(1, 40)), f"t{i}"))
    return rows


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def plain_gaps(own, width=1200, least=10):
    filled = [False] * width
    for _, _, x1, _, x2, _, _ in own:
        for x in range(int(max(0, x1)), int(min(width - 1, x2))):
            filled[x] = True
    out, start = [], None
    for x, f in enumerate([*filled, True]):
        if not f and start is None:
            start = x
        if f and start is not None:
            if x - start > least:
                out.append((start + x) // 2)
            start = None
    return out


def test_column_gaps(spark):
    rows = boxes(random.Random(1))
    got = {}
    for r in L.column_gaps(spark.createDataFrame(rows, BOX), ["doc"]).collect():
        got.setdefault(r["doc"], []).append(r["boundary"])
    assert {d: sorted(b) for d, b in got.items()} == {d: g for d, own in by_doc(rows).items() if (g := plain_gaps(own))}


def test_gap_of_ten_does_not_count(spark):
    rows = [(0, 0, 0.0, 0.0, 100.0, 5.0, "a"), (0, 1, 110.0, 0.0, 600.0, 5.0, "b"), (0, 2, 611.0, 0.0, 1199.0, 5.0, "c")]
    assert [r["boundary"] for r in L.column_gaps(spark.createDataFrame(rows, BOX), ["doc"]).collect()] == [605]


def plain_iou(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide < 0 or high < 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - wide * high
    return wide * high / union if union > 0 else 0.0


def test_cells(spark):
    rng = random.Random(2)
    rows = boxes(rng, 40)
    cells = [(d, c, *(x := float(rng.randint(0, 800)), y := float(rng.randint(0, 200)))[:2], x + rng.randint(50, 500), y + rng.randint(20, 150)) for d in range(40) for c in range(4)]
    cell_frame = spark.createDataFrame([(d, c, x1, y1, float(x2), float(y2)) for d, c, x1, y1, x2, y2 in cells], "doc int, cell_idx int, x1 double, y1 double, x2 double, y2 double")
    blocks = spark.createDataFrame(rows, BOX)
    assigned = L.blocks_in_cells(blocks, cell_frame, ["doc"])
    want, members = {}, {}
    for d, i, x1, y1, x2, y2, text in rows:
        own = [c for c in cells if c[0] == d]
        cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
        inside = [c[1] for c in own if c[2] <= cx <= c[4] and c[3] <= cy <= c[5]]
        best = max(own, key=lambda c: (plain_iou((x1, y1, x2, y2), c[2:]), -c[1]))
        if inside:
            want[d, i] = (min(inside), 0)
        elif plain_iou((x1, y1, x2, y2), best[2:]) >= 0.05:
            want[d, i] = (best[1], 1)
        if (d, i) in want:
            members.setdefault((d, want[d, i][0]), []).append((cy, want[d, i][1], i, cx, y2 - y1, text))
    assert {(r["doc"], r["block_idx"]): (r["cell_idx"], r["method"]) for r in assigned.collect()} == want
    got = {(r["doc"], r["cell_idx"]): r["text"] for r in L.cell_texts(blocks, cell_frame, assigned, ["doc"]).collect()}
    assert got == {(c[0], c[1]): plain_text(members.get((c[0], c[1]), []), c[5] - c[3]) for c in cells}


def plain_text(own, height):
    if not own:
        return ""
    own = sorted(own)
    limit = min(0.15 * height, 0.5 * sum(b[4] for b in own) / len(own), 15.0)
    lines = [[own[0]]]
    for before, b in zip(own, own[1:]):
        if b[0] - before[0] > limit:
            lines.append([])
        lines[-1].append(b)
    lines = [sorted(line, key=lambda b: b[3]) for line in lines]
    lines.sort(key=lambda line: line[0][0])
    text = ""
    for n, line in enumerate(lines):
        if n:
            text += "\n" if line[0][0] - lines[n - 1][0][0] > 1.5 * limit else " "
        text += " ".join(b[5] for b in line)
    return text


def test_reconstruct(spark):
    rows = boxes(random.Random(3), 15)
    frame = spark.createDataFrame(rows, BOX)
    got = {(r["doc"], r["row_idx"], r["col_idx"]): r["text"] for r in L.reconstruct(frame, L.column_gaps(frame, ["doc"]), ["doc"]).collect()}
    want = {}
    for d, own in by_doc(rows).items():
        bounds, columns = plain_gaps(own), {}
        for b in own:
            columns.setdefault(sum((b[2] + b[4]) / 2 > x for x in bounds), []).append(b)
        depth = max(map(len, columns.values()))
        for c in range(max(columns) + 1):
            ordered = [b[6] for b in sorted(columns.get(c, []), key=lambda b: (b[3], b[1]))]
            for r in range(depth):
                want[d, r, c] = ordered[r] if r < len(ordered) else ""
    assert got == want


def test_anchored_lines(spark):
    words = F.array(*[F.struct(F.lit(float(t)).alias("top"), F.lit(float(x)).alias("x0"), F.lit(f"w{t}").alias("text")) for x, t in enumerate([9, 0, 4, 2, 5])])
    lines = spark.range(1).select(L.lines_of(words).alias("l")).first()["l"]
    assert [(r["top"], r["text"]) for r in lines] == [(0.0, "w0 w2"), (4.0, "w4 w5"), (9.0, "w9")]


def plain_islands(segments):
    import math

    spans = [(math.floor(a), math.ceil(b)) for a, b in segments if math.ceil(b) > math.floor(a)]
    lo, hi = min(a for a, _ in spans), max(b for _, b in spans)
    empty = [x for x in range(lo, hi) if sum(a <= x < b for a, b in spans) < 2]
    runs = []
    for x in empty:
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return lo, hi, runs


@pytest.mark.parametrize("seed", [4, 5])
def test_histograms(spark, seed):
    rng = random.Random(seed)
    rows = []
    for page in range(12):
        for _ in range(rng.randint(2, 25)):
            x, y = rng.uniform(0, 120), rng.choice([0, 3, 20, 22, 90, 95, 160]) + rng.uniform(0, 4)
            rows.append((page, x, x + rng.uniform(1, 15), y, y + rng.uniform(1, 12)))
    frame = spark.createDataFrame(rows, "page int, x0 double, x1 double, top double, bottom double")
    columns = {r["page"]: r["bounds"] for r in L.column_histogram(frame, ["page"]).collect()}
    lines = {r["page"]: r["bounds"] for r in L.row_histogram(frame, ["page"]).collect()}
    for page in range(12):
        own = [r for r in rows if r[0] == page]
        lo, hi, runs = plain_islands([(r[1], r[2]) for r in own])
        assert columns[page] == sorted(float(hi - 1 if b == hi - 1 else lo if a == lo else (a + b) / 2) for a, b in runs) + [float(hi)]
        lo, hi, runs = plain_islands([(r[3], r[4]) for r in own])
        bounds, before = [], None
        for a, b in runs:
            n = b - a + 1
            if b == hi - 1:
                if before is None or n > 2 * before:
                    bounds.append((a + b) / 2)
            elif before is not None and n > 5 * before:
                bounds.append((a + b) / 2)
                before = None
            else:
                before = n
        assert lines[page] == [*bounds, float(hi)]


def test_small_functions(spark):
    row = spark.range(1).select(
        L.column_of(F.lit(10.0), F.array(F.lit(5.0), F.lit(10.0))).alias("c"),
        L.interval_of(F.lit(10.0), F.array(F.lit(5.0), F.lit(10.0), F.lit(20.0))).alias("i"),
        L.interval_of(F.lit(20.0), F.array(F.lit(5.0), F.lit(20.0))).alias("o"),
        L.header_band(F.struct(F.lit(50.0).alias("top"), F.lit(60.0).alias("bottom")), F.array(F.lit(10.0), F.lit(40.0), F.lit(55.0), F.lit(70.0))).alias("b"),
        L.page_kind(F.lit(False), F.lit(True), F.lit(False)).alias("k"),
    ).first()
    assert (row["c"], row["i"], row["o"], row["k"]) == (1, 1, None, "scan")
    assert (row["b"]["above"], row["b"]["below"]) == (40.0, 70.0)


def test_pdf_tables(spark):
    from gridline.operators import pdf as P

    lines = {0: "intro words here", 80: "№ Наименование Кол-во", 120: "a1 b1 c1", 130: "a2 b2 c2", 170: "d1 e1 f1", 180: "d2 e2 f2", 220: "g1 h1 i1", 230: "g2 h2 i2"}
    words = [(7, 1, 10 * top + k, 10.0 + 100 * k, 60.0 + 100 * k, float(top), top + 8.0, w) for top, line in lines.items() for k, w in enumerate(line.split())]
    frame = spark.createDataFrame(words, "doc_id int, page int, word_idx int, x0 double, x1 double, top double, bottom double, text string")
    got = {(r["row_idx"], r["col_idx"]): r["text"] for r in P.geometric_tables(frame).collect()}
    assert got == {(-1, 0): "Наименование", (-1, 1): "Кол-во", (0, 0): "e1 e2", (0, 1): "f1 f2", (1, 0): "h1 h2", (1, 1): "i1 i2"}


def test_page_kinds(spark):
    from gridline.operators import pdf as P

    rows = [(1, 1, True, None, False, False), (1, 2, False, " ", True, False), (1, 3, False, None, False, False), (1, 4, True, "x", True, True), (1, 5, None, "text", None, None)]
    kinds = P.page_kinds(spark.createDataFrame(rows, "doc_id int, page int, has_chars boolean, text string, has_images boolean, failed boolean"))
    assert [r["kind"] for r in kinds.orderBy("page").collect()] == ["text", "scan", "unknown", "error", "text"]
    assert tuple(P.kind_counts(kinds).first()) == (1, 2, 1, 1, 1)
