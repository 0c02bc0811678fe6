"""Fuzzy look-ups against plain loops over all terms."""

import random

import pytest
from pyspark.sql import functions as F

from gridline.functions import fuzzy as Z
from gridline.operators import nearest as N
from gridline.operators import ocrtext as O


def plain_ratio(a, b):
    """By bits of whole integers, checked against the table of lengths below."""
    if not a and not b:
        return 100.0
    masks = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
    v = ones = (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & ones
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def table_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def plain_nearest(words, terms, least):
    out = {}
    for w in {w for w in words if w}:
        best = max(((plain_ratio(w, t), -i, m) for i, (t, m) in enumerate(terms)), default=None)
        if best and best[0] >= least:
            out[w] = (best[2], best[0])
    return out


def some(rng, n, letters="абвгреолт"):
    return "".join(rng.choice(letters) for _ in range(n))


def disturbed(rng, word, letters="абвгреолт"):
    for _ in range(rng.randint(1, 3)):
        at = rng.randint(0, len(word))
        word = word[:at] + rng.choice(["", rng.choice(letters)]) + word[at + rng.randint(0, 1) :]
    return word


def test_ratio(spark):
    rng = random.Random(1)
    rows = [(some(rng, rng.randint(0, 9)), some(rng, rng.randint(0, 9), "аб\U0001f600е")) for _ in range(300)]
    rows += [(some(rng, 80), some(rng, 70)), (some(rng, 62), some(rng, 62)), (some(rng, 63), some(rng, 5)), (some(rng, 5), some(rng, 63)), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", Z.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == table_ratio(r["a"], r["b"]) == plain_ratio(r["a"], r["b"]) for r in got) and len(got) == len(rows)
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(Z.ratio(F.col("a"), F.col("b")).alias("r")).first()["r"] is None


def test_short_lists(spark):
    rng = random.Random(2)
    terms = [(some(rng, rng.randint(1, 9)), f"m{i}") for i in range(40)]
    words = [some(rng, rng.randint(1, 9)) for _ in range(200)] + [None]
    got = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", Z.best_of(F.col("w"), terms, 60.0).alias("b")).collect()}
    want = plain_nearest(words, terms, 60.0)
    assert {w: (b["match"], b["score"]) for w, b in got.items() if b is not None} == want and want


@pytest.mark.parametrize("least", [60.0, 70.0, 75.0, 88.0])
def test_index_is_a_plain_scan(spark, least):
    rng = random.Random(int(least))
    terms = [some(rng, rng.randint(1, 11)) for _ in range(600)]
    words = [disturbed(rng, rng.choice(terms)) for _ in range(60)] + [some(rng, rng.randint(1, 12)) for _ in range(60)] + [None, "", "x" * 70, "а"]
    frame = spark.createDataFrame([(t, f"m{i}", i) for i, t in enumerate(terms)], "term string, match string, ord long")
    got = {r["word"]: (r["match"], r["score"]) for r in N.nearest(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), frame, least).collect()}
    assert got == plain_nearest(words, [(t, f"m{i}") for i, t in enumerate(terms)], least) and got


def test_two_hundred_thousand_terms(spark):
    rng = random.Random(7)
    letters = "абвгдежзийклмнопрстуфхцчшщыьэюя"
    terms = list(dict.fromkeys(some(rng, rng.randint(5, 12), letters) for _ in range(200_000)))
    words = [disturbed(rng, rng.choice(terms), letters) for _ in range(9)]
    frame = spark.createDataFrame([(t, t, i) for i, t in enumerate(terms)], "term string, match string, ord long")
    got = {r["word"]: (r["match"], r["score"]) for r in N.nearest(spark.createDataFrame([(w,) for w in words], "word string"), frame, 70.0).collect()}
    assert got == plain_nearest(words, [(t, t) for t in terms], 70.0) and len(got) > 6


def test_repair_with_a_lexicon_relation_is_that_with_a_list(spark, monkeypatch):
    rng = random.Random(3)
    lexicon = list(dict.fromkeys([some(rng, rng.randint(4, 8)) for _ in range(60)] + ["головка", "патрон"]))
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(lexicon)], "word string, ord long")
    texts = ["  ", None, "Sandvlk 5шт"] + [" ".join(disturbed(rng, rng.choice(lexicon)).replace("р", rng.choice("рrp")) for _ in range(4)) for _ in range(30)]
    cells = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    listed = {r["id"]: r["text"] for r in O.repaired(cells, ["id"], frame).collect()}
    monkeypatch.setattr(O, "TERM_ROWS", 5)
    related = O.repaired(cells, ["id"], frame)
    assert {r["id"]: r["text"] for r in related.collect()} == listed
    assert "Python" not in related._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in O.repaired(cells, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_are_repaired_once(spark):
    """As many texts go through the passes as are distinct, dealt to several tasks."""
    cells = spark.createDataFrame([(i, "Pe3eц") for i in range(50)] + [(50, "державkа"), (51, " "), (52, None)], "k int, text string")
    done = O.repaired(cells, ["k"])
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_text" in plan and "RepartitionByExpression [_text" in plan
    got = {r["k"]: r["text"] for r in done.collect()}
    assert got == {i: "Резец" for i in range(50)} | {50: "державка", 51: " ", 52: None}


def test_types_are_told_of_exploded_tokens(spark):
    found = O.tokens(spark.createDataFrame([(1, "a 5 HSK-63 b c, 1.5"), (2, ""), (3, None)], "k int, text string"), ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate" in line] and not any("regexp_count" in line for line in plan.splitlines() if "lambda" in line)
    assert [(r["token"], r["kind"], r["near_number"]) for r in found.orderBy("k", "pos").collect() if r["kind"] in ("word", "numeric")][:2] == [("a", "word", True), ("5", "numeric", False)]
