"""Variant groups of words against a comparison of all pairs."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridline.llm import spelling
from tests.llm.fixtures import documents

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(i) for i in range(0xC0, 0x100)}


def plain_counts(docs, every=199):
    total = Counter()
    for doc, text in docs:
        runs, run = [], ""
        for c in (text or "") + " ":
            if c in LETTERS:
                run += c.lower() if c.isascii() else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return total


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_groups(words, times=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and distance(v, w) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def alike(rng, count, length, letters="ab"):
    """Words that are near one another by the hundred."""
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(length - 1, length + 1))) for _ in range(count)}
    return {w: rng.choice([1, 5, 5, 25, 125, 700]) for w in sorted(words)}


@pytest.mark.parametrize(("most", "shard"), [(256, 1 << 17), (3, 16), (1, 5)])
def test_groups_are_those_of_all_pairs(spark, most, shard):
    rng = random.Random(most)
    words = alike(rng, 350, 7) | alike(rng, 80, 3, "aé\U0001f600") | {"gegeben": 5, "gegebn": 1, "gegebenn": 1, "xy": 2, "ay": 10, "straße": 30, "strasse": 6}
    words = {w: n for w, n in words.items() if len(w) > 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("root", F.lit("x")).repartition(3)
    assert got(spelling.spelling_groups(df, most=most, shard=shard)) == plain_groups(words)


def test_long_lists_are_split_until_short(spark):
    words = ["interna" + a + b + c for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    held, asked = spelling._lists(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 20)
    sizes = held.groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes <= 20 or held.where("length - start - end > 1").groupBy("key").count().agg(F.max("count")).first()[0] <= 20
    assert asked.count() < 40 * len(words)


def test_query_on_awkward_texts(spark, tmp_path):
    rng = random.Random(8)
    base = ["sentence", "language", "Äpfelchen", "übergang", "straßen", "ELEPHANT", "corpora", "×÷letter"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(60)), "en", "a", 1) for i in range(60)]
    docs += [(i, "senteence languge\nelephannt-elephannt ÄPFELCHEN äpfelchen", None, None, None) for i in range(100, 106)]
    docs += [(None, "sentence " * 9 + "é", "x", "y", 2), (5, None, None, None, None), (6, "", "a", "b", 0), (7, "corpora " * 30_000, "a", "b", 0), docs[0], docs[0]]
    folder = documents(spark, tmp_path, docs)
    words = {w: n for w, n in plain_counts([d[:2] for d in docs]).items() if len(w) >= 6 and n >= 5}
    assert got(spelling.op13_spelling(spark, folder)) == plain_groups(words)
    assert any(form for _, form, *_ in plain_groups(words))


def test_losses_of_code_points(spark):
    docs = [(i, f"aBcdéf{chr(97 + i % 26)} xÿz") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = spelling.word_counts(df, least_chars=1, least_count=1, every=3)
    assert {r["word"]: r["n"] for r in found.collect()} == {w: n for w, n in plain_counts(docs, 3).items() if w}


def test_nothing_gives_nothing(spark, tmp_path):
    assert spelling.op13_spelling(spark, documents(spark, tmp_path, [])).collect() == []
    none = spark.createDataFrame([(None, 5), ("a", 5), ("abcdef", None)], "word string, n long")
    assert spelling.spelling_groups(none).collect() == []


def test_one_apart():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spelling.one_apart(a, b) == (distance(a, b) == 1)
