"""Ruled tables and tables of words' places, against plain loops over points."""

import random

import pyarrow as pa
import pytest

from gridline.operators import layout as L
from gridline.operators import pdf as P
from gridline.operators import ruled as R

RULE = "doc_id int, page int, x0 double, x1 double, top double, bottom double"
WORD = "doc_id int, page int, word_idx int, x0 double, x1 double, top double, bottom double, text string"


def plain_lines(edges):
    """Edges (pos, lo, hi) snapped and joined, by walking over them."""
    groups = []
    for e in sorted(edges):
        if groups and e[0] - groups[-1][-1][0] <= 3:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for g in groups:
        pos, parts = sum(e[0] for e in g) / len(g), []
        for lo, hi in sorted(e[1:] for e in g):
            if parts and lo <= parts[-1][1] + 3:
                parts[-1][1] = max(parts[-1][1], hi)
            else:
                parts.append([lo, hi])
        out += [(pos, lo, hi) for lo, hi in parts if hi - lo >= 3]
    return out


def plain_tables(rules, cross):
    v = plain_lines([(r[0], min(r[2:]), max(r[2:])) for r in rules if abs(r[0] - r[1]) < 0.5 and abs(r[2] - r[3]) >= 0.5])
    h = plain_lines([(r[2], min(r[:2]), max(r[:2])) for r in rules if abs(r[2] - r[3]) < 0.5 and abs(r[0] - r[1]) >= 0.5])
    corner = {(i, j) for i, a in enumerate(v) for j, e in enumerate(h) if a[1] <= e[0] + cross and a[2] >= e[0] - cross and e[1] - cross <= a[0] <= e[2] + cross}
    cells = {}
    for i, j in corner:
        fits = [(h[m][0], v[k][0]) for k in range(len(v)) for m in range(len(h)) if v[k][0] > v[i][0] and h[m][0] > h[j][0] and {(k, j), (i, m), (k, m)} <= corner]
        if fits:
            key = h[j][0], v[i][0]
            cells[key] = min([*([cells[key]] if key in cells else []), min(fits)])
    tables = [[(top, x0, bottom, x1)] for (top, x0), (bottom, x1) in sorted(cells.items())]
    points = lambda t: {(y, x) for c in t for y in (c[0], c[2]) for x in (c[1], c[3])}
    while True:
        pair = next(((a, b) for a in range(len(tables)) for b in range(a) if points(tables[a]) & points(tables[b])), None)
        if pair is None:
            return sorted(sorted(t) for t in tables if len(t) > 1)
        tables[pair[1]] += tables.pop(pair[0])


def plain_cells(rules):
    tables = plain_tables(rules, 3) or plain_tables(rules, 5)
    out = {}
    for n, cells in enumerate(tables):
        tops, lefts = (sorted({c[k] for c in cells}) for k in (0, 1))
        for r, top in enumerate(tops):
            for k, left in enumerate(lefts):
                out[n, r, k] = next((c for c in cells if c[:2] == (top, left)), (None,) * 4)
    return out


def some_rules(rng):
    """Lines of one or two grids: broken, shifted, with lines left out, and strays."""
    rules = []
    for _ in range(rng.randint(1, 2)):
        x, y, w, n, m = rng.randint(0, 200), rng.randint(0, 200), rng.choice([4, 11, 30]), rng.randint(1, 5), rng.randint(1, 5)
        for i in range(n + 1):
            for j in range(m):
                if rng.random() < 0.85:
                    at = x + i * w + rng.choice([0, 0, 0, 1, 2])
                    rules.append((at, at, y + j * 20 + rng.choice([0, 0, 2, 4]), y + j * 20 + 20 - rng.choice([0, 0, 1])))
        for j in range(m + 1):
            for i in range(n):
                if rng.random() < 0.85:
                    at = y + j * 20 + rng.choice([0, 0, 0, 1, 2])
                    rules.append((x + i * w + rng.choice([0, 0, 3]), x + i * w + w - rng.choice([0, 0, 1]), at, at))
    rules += [(5, 90, 7, 60), (1, 1, 1, 1), (3, 3, 5, 6)]
    rng.shuffle(rules)
    return [tuple(map(float, r)) for r in rules]


@pytest.mark.parametrize("seed", [1, 2])
def test_ruled_cells_are_those_of_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    pages = {p: some_rules(rng) for p in range(60)}
    frame = spark.createDataFrame([(0, p, *r) for p, rules in pages.items() for r in rules] + [(1, 1, None, 1.0, 2.0, 3.0)], RULE)
    got = {p: {} for p in pages}
    for r in R.ruled_cells(frame).collect():
        got[r["page"]][r["table_idx"], r["row_idx"], r["col_idx"]] = (r["top"], r["x0"], r["bottom"], r["x1"])
    for p, rules in pages.items():
        assert got[p] == plain_cells(rules), (p, rules)
    assert sum(map(bool, got.values())) > 40


def grid(x, y, columns, rows, w=50.0, h=20.0):
    right, low = x + columns * w, y + rows * h
    return [(x + i * w, x + i * w, y, low) for i in range(columns + 1)] + [(x, right, y + j * h, y + j * h) for j in range(rows + 1)]


def test_words_go_to_the_cells_that_hold_their_middles(spark):
    rules = [(1, 1, *r) for r in grid(100.0, 100.0, 2, 2)]
    words = [(1, 1, 1, 105.0, 120.0, 102.0, 110.0, "b"), (1, 1, 0, 101.0, 104.0, 102.5, 110.0, "a"), (1, 1, 2, 101.0, 120.0, 108.0, 116.0, "second"), (1, 1, 3, 140.0, 170.0, 125.0, 130.0, "wide"), (1, 1, 4, 10.0, 20.0, 100.0, 110.0, "out"), (1, 1, 5, 145.0, 155.0, 101.0, 109.0, "edge")]
    got = {(r["row_idx"], r["col_idx"]): r["text"] for r in R.ruled_tables(spark.createDataFrame(words, WORD), spark.createDataFrame(rules, RULE)).collect()}
    assert got == {(0, 0): "a b\nsecond", (0, 1): "edge", (1, 0): "", (1, 1): "wide"}


def test_cells_that_are_merged_leave_null_places(spark):
    rules = [(1, 1, *r) for r in grid(0.0, 0.0, 3, 2)]
    rules.remove((1, 1, 50.0, 50.0, 0.0, 40.0))
    rules.append((1, 1, 50.0, 50.0, 20.0, 40.0))
    got = {(r["row_idx"], r["col_idx"]): r["x1"] for r in R.ruled_cells(spark.createDataFrame(rules, RULE)).collect()}
    assert got == {(0, 0): 100.0, (0, 1): None, (0, 2): 150.0, (1, 0): 50.0, (1, 1): 100.0, (1, 2): 150.0}


def test_rectangles_are_rules(spark):
    boxes = [(1, 1, 50.0 * i, 50.0 * i + 50, 20.0 * j, 20.0 * j + 20) for i in range(3) for j in range(2)]
    got = R.ruled_cells(R.rectangle_edges(spark.createDataFrame(boxes, RULE))).collect()
    assert sorted((r["top"], r["x0"]) for r in got) == sorted((b[4], b[2]) for b in boxes)


def test_no_rules_and_no_words(spark):
    words, rules = spark.createDataFrame([], WORD), spark.createDataFrame([], RULE)
    assert R.ruled_tables(words, rules).collect() == [] == P.geometric_tables(words, images=rules, rules=rules).collect()
    assert P.document_tables(words, rules).collect() == []


def plain_bounds(spans, rows):
    lo, hi = min(int(a // 1) for a, _ in spans), max(-int(-b // 1) for _, b in spans)
    cover = [sum(int(a // 1) <= p < -int(-b // 1) for a, b in spans) for p in range(lo, hi)]
    empty, runs = [p + lo for p, n in enumerate(cover) if n < 2], []
    for p in empty:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    if not rows:
        return [float(hi - 1 if b == hi - 1 else lo if a == lo else (a + b) / 2) for a, b in runs] + [float(hi)]
    out, before = [], None
    for a, b in runs:
        n = b - a + 1
        if b == hi - 1:
            if before is None or n > 2 * before:
                out.append((a + b) / 2)
        elif before is not None and n > 5 * before:
            out.append((a + b) / 2)
            before = None
        else:
            before = n
    return [*out, float(hi)]


def plain_lines_of(words):
    lines = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"], w["n"])):
        if lines and w["top"] - lines[-1][0]["top"] < 3:
            lines[-1].append(w)
        else:
            lines.append([w])
    return [sorted(line, key=lambda w: w["x0"]) for line in lines]


def plain_document(pages, images, rules, anchors):
    """The cells of a document {page: words} by the rules of the word tables, one page after the other."""
    first = min(pages)
    lines = plain_lines_of(pages[first])
    scores = [sum(any(a in " ".join(w["text"] for w in line).lower() for a in group) for group in anchors.values()) for line in lines]
    at = scores.index(max(scores)) if max(scores) >= 2 else 0
    top, bottom = min(w["top"] for w in lines[at]), max(w["bottom"] for w in lines[at])
    above = [r[2] for r in rules.get(first, ()) if abs(r[2] - r[3]) < 0.5 and r[2] < top]
    below = [r[2] for r in rules.get(first, ()) if abs(r[2] - r[3]) < 0.5 and r[2] > bottom]
    begin = end = at
    titles = lines[at]
    if above and below:
        titles = [w for line in lines for w in line if max(above) < w["top"] < min(below)]
        inside = [i for i, line in enumerate(lines) if any(max(above) < w["top"] < min(below) for w in line)]
        begin, end = inside[0], inside[-1]

    def overlapping(words, page):
        y0, y1 = min(w["top"] for w in words), max(w["bottom"] for w in words)
        return [i for i in images.get(page, ()) if i[3] > y0 and i[2] < y1]

    shaping = [w for line in lines[begin : end + 31] for w in line]
    columns = plain_bounds([(w["x0"], w["x1"]) for w in shaping] + [i[:2] for i in overlapping(shaping, first)], False)
    out = {}
    for c in range(len(columns) - 1):
        parts = [" ".join(w["text"] for w in line if columns[c] <= (w["x0"] + w["x1"]) / 2 < columns[c + 1]) for line in plain_lines_of(titles)]
        out[first, -1, c] = " ".join(parts).strip()
    for page, words in pages.items():
        rows = plain_bounds([(w["top"], w["bottom"]) for w in words] + [i[2:] for i in overlapping(words, page)], True)
        read = [w for line in plain_lines_of(words) for w in line]
        for r in range(len(rows) - 1):
            for c in range(len(columns) - 1):
                out[page, r, c] = " ".join(w["text"] for w in read if rows[r] <= w["top"] < rows[r + 1] and columns[c] <= w["x0"] < columns[c + 1])
    return out


def long_document(rng):
    """Pages of up to 60 lines, with titles over several lines, rules around them on some, and images."""
    pages, images, rules = {}, {}, {}
    for page in range(1, rng.randint(2, 4)):
        words, y = [], 20.0
        for line in range(rng.randint(35, 60)):
            for k in range(4):
                if rng.random() < 0.8:
                    x = 10.0 + 80 * k + rng.randint(0, 20)
                    text = "alpha beta gamma".split()[k % 3] if line in (3, 4) and page == 1 else rng.choice(["x1", "y2", "z3"])
                    words.append({"top": y + rng.choice([0, 0, 1.5]), "bottom": y + 9.0, "x0": x, "x1": x + rng.randint(5, 40), "text": text, "n": len(words)})
            y += rng.choice([11.0, *[12.0] * 30, 90.0])
        pages[page] = words
        images[page] = [(300.0, 340.0, -30.0, 25.0), (400.0, 410.0, y + 100, y + 120)][: rng.randint(0, 2)]
        rules[page] = [(0.0, 300.0, t, t + 0.2) for t in (40.0, 44.0, 90.0, 300.0)] if rng.random() < 0.6 else []
    return pages, images, rules


def test_long_pages_are_read_whole(spark):
    rng, anchors = random.Random(4), {"a": ["alpha"], "b": ["beta"], "g": ["gamma"]}
    documents = {d: long_document(rng) for d in range(25)}
    words = [(d, p, w["n"], w["x0"], w["x1"], w["top"], w["bottom"], w["text"]) for d, (pages, _, _) in documents.items() for p, own in pages.items() for w in own]
    images, rules = ([(d, p, *map(float, b)) for d, parts in documents.items() for p, own in parts[k].items() for b in own] for k in (1, 2))
    frames = spark.createDataFrame(words, WORD).repartition(5), spark.createDataFrame(images, RULE), spark.createDataFrame(rules, RULE)
    got = {d: {} for d in documents}
    for r in P.geometric_tables(frames[0], anchors, frames[1], frames[2]).collect():
        got[r["doc_id"]][r["page"], r["row_idx"], r["col_idx"]] = r["text"]
    for d, parts in documents.items():
        assert got[d] == plain_document(*parts, anchors), d


def test_documents_without_ruled_tables_only_are_read_by_places(spark):
    anchors = {"a": ["alpha"], "b": ["beta"], "g": ["gamma"]}
    ruled = [(1, 2, *r) for r in grid(0.0, 0.0, 3, 2)] + [(3, 1, *r) for r in grid(0.0, 0.0, 3, 2)]
    words = [(d, p, k, 10.0 + 50 * k, 30.0 + 50 * k, 5.0 + 20 * j, 15.0 + 20 * j, t) for d, p in ((1, 1), (1, 2), (2, 1), (3, 1)) for j, line in enumerate(("Alpha, beta. gamma" if d != 3 else "x y z", "1 2; 3")) for k, t in enumerate(line.split())]
    got = P.document_tables(spark.createDataFrame(words, WORD), spark.createDataFrame(ruled, RULE), anchors=anchors).collect()
    assert {(r["doc_id"], r["page"], r["ruled"]) for r in got} == {(1, 2, True), (2, 1, False)}
    assert {r["text"] for r in got if r["doc_id"] == 1} == {"Alpha", "beta", "gamma", "1", "2", "3"}


def test_points_meet_boxes_once(spark):
    rng = random.Random(3)
    boxes = [(p, i, x, x + rng.randint(0, 200), y, y + rng.randint(1, 300)) for p in range(3) for i in range(40) for x, y in [(rng.randint(-50, 300) / 2, rng.randint(-50, 300) / 2)]]
    points = [(p, i, rng.randint(-60, 400) / 2, rng.randint(-60, 400) / 2) for p in range(3) for i in range(200)]
    frame = spark.createDataFrame([(*b[:2], *map(float, b[2:])) for b in boxes], "page int, box int, x0 double, x1 double, top double, bottom double")
    got = L.points_in_boxes(spark.createDataFrame(points, "page int, point int, x double, y double"), frame, ["page"], ["box"], tile=37.0).select("page", "point", "box").collect()
    want = [(p, i, b) for p, i, x, y in points for q, b, x0, x1, t, u in boxes if p == q and x0 <= x < x1 and t <= y < u]
    assert sorted(map(tuple, got)) == sorted(want)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_read_once(spark):
    words = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, 1.0, 2.0, "w")], WORD)
    assert plan(R.ruled_tables(words, spark.createDataFrame([(1, 1, *r) for r in grid(0.0, 0.0, 3, 2)], RULE))).count("MapInArrow") == 1


def test_documents_of_ruled_tables_are_found_once(spark):
    words = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, 1.0, 2.0, "w")], WORD)
    rules = spark.createDataFrame([(1, 1, *r) for r in grid(0.0, 0.0, 3, 2)], RULE)
    assert plan(P.document_tables(words, rules)).count("MapInArrow") == 1


def test_pages_over_several_batches_stay_whole(monkeypatch):
    monkeypatch.setattr(R, "ROWS", 4)
    numbers = [1] * 3 + [2] * 9 + [3, 3, 4, 5, 5, 5]
    batches = [pa.record_batch({"doc_id": numbers[i : i + 2], "page": [0] * len(numbers[i : i + 2])}) for i in range(0, len(numbers), 2)]
    got = [(rows.column("doc_id").to_pylist(), begins.sum()) for rows, begins in R._whole_pages(iter(batches))]
    assert sum((n for n, _ in got), []) == numbers and len(got) > 1
    assert all(len(set(n)) == count for n, count in got) and sum(count for _, count in got) == 5


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def some_pages(spark):
    rng = random.Random(7)
    pages = {p: (some_rules(rng), [{"n": i, "x0": x / 2, "x1": x / 2 + 6, "top": y / 2, "bottom": y / 2 + 5, "text": f"w{i}"} for i in range(80) for x, y in [(rng.randint(0, 600), rng.randint(0, 500))]]) for p in range(30)}
    rules = spark.createDataFrame([(0, p, *r) for p, (own, _) in pages.items() for r in own], RULE)
    words = spark.createDataFrame([(0, p, w["n"], w["x0"], w["x1"], w["top"], w["bottom"], w["text"]) for p, (_, own) in pages.items() for w in own] + [(0, 0, 99, None, 3.0, 1.0, 2.0, "nowhere")], WORD)
    return pages, rules, words


def test_words_and_rules_are_dealt_once_and_cells_never(spark):
    pages, rules, words = some_pages(spark)
    df = R.ruled_tables(words.repartition("doc_id"), rules.repartition("doc_id", "page"))
    assert exchanges(df) == 3  # two of them are the test's own
    got = {p: {} for p in pages}
    for r in df.collect():
        got[r["page"]][r["table_idx"], r["row_idx"], r["col_idx"]] = r["text"]
    for p, (own, held) in pages.items():
        inside = lambda c: [w for w in held if c[1] <= (w["x0"] + w["x1"]) / 2 < c[3] and c[0] <= (w["top"] + w["bottom"]) / 2 < c[2]]  # noqa: B023, E731
        text = lambda c: None if c[0] is None else "\n".join(" ".join(w["text"] for w in line) for line in plain_lines_of(inside(c)))  # noqa: B023, E731
        assert got[p] == {k: text(c) for k, c in plain_cells(own).items()}, p
    assert any(t for own in got.values() for t in own.values())


def test_tables_are_chosen_without_a_shuffle(spark):
    pages, rules, words = some_pages(spark)
    df = P.document_tables(words, rules, anchors={"a": ["w1"], "b": ["w2"], "c": ["w"]})
    assert "Window" not in plan(df)
    hit = lambda t: sum(a in (t or "") for a in ("w1", "w2", "w"))
    hits, every = {}, R.ruled_tables(words, rules).collect()
    for r in every:
        hits[r["page"], r["table_idx"]] = hits.get((r["page"], r["table_idx"]), 0) + (hit(r["text"]) if r["row_idx"] == 0 else 0)
    got = {(r["page"], r["table_idx"]) for r in df.collect()}
    assert got == {t for t, n in hits.items() if n >= P.SELECTED} and got and got != set(hits)
