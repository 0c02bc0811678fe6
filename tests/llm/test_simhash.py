import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridline.llm import similar, simhash
from gridline.llm.graph import components


def plain_fingerprint(text, words=3):
    split = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not split:
        return 0
    shingles = [b" ".join(split[i : i + words]) for i in range(max(1, len(split) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "A b c", "x " * 300, "é\x1fa b c d É", "w\x0bv\x0cu t"])
def test_fingerprint(text):
    got = simhash.fingerprint(simhash.shingles((text or "").encode())) & (1 << 64) - 1
    assert got == plain_fingerprint(text)


@pytest.mark.parametrize("size", [3, 40, 300, 3000])
def test_near_lists(size):
    rng = random.Random(size)
    places = rng.sample(range(64), 16)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << places[i] for i in range(16) if m >> i & 1) for m in rng.sample(range(1 << 16), size)}
    values = np.sort(np.array(list(values), np.uint64))
    a, b = simhash.near(values)
    linked = [(int(x), int(y)) for x in values for y in values[np.bitwise_count(values ^ x) <= 2] if x != y]
    want = plain_components([int(v) for v in values], linked)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: r for x, r in want.items() if x != r}


def test_links_are_whole(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(rng.choice([1, 3, 90])):
            v = base
            for _ in range(rng.choice([1, 2, 3])):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(prints)).collect()}
    array = np.array(values, np.uint64)
    linked = [(signed(x), signed(int(y))) for x in values for y in array[np.bitwise_count(array ^ np.uint64(x)) <= 2] if int(y) != x]
    want = plain_components([signed(v) for v in values], linked)
    assert {v: roots.get(v, v) for v in want} == want


def test_components_of_a_path(spark):
    nodes = list(range(200))
    random.Random(1).shuffle(nodes)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:])] + [(900, 901), (901, 900), (77, 77), (500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 900: 900, 901: 900}


def test_nulls_ties_and_copies(spark):
    rows = [(5, "same text here now"), (2, "SAME text\nhere now"), (9, None), (7, ""), (None, "lonely words in here"), (None, None), (2, "SAME text\nhere now")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("5", "2"), ("2", "2"), ("2", "2"), ("9", "7"), ("7", "7"), ("None", "7"), ("None", "None")])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def cloud(rng, size, copies, edits):
    """Copies of a text that isn't among them, each with its own edits."""
    base, out = [f"w{rng.randrange(5000)}" for _ in range(size)], []
    for i in range(copies):
        words = list(base)
        for at in rng.sample(range(size), rng.choice(edits)):
            words[at] = f"e{i}x{at}"
        out.append(" ".join(words))
    return out


def plain_similar(texts, least=0.8):
    """The first text that each text reaches by pairs of that similarity, all pairs compared as sets."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least]
    return plain_components(range(len(texts)), linked)


def test_reached_counts_shared_hashes_exactly():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(30))], np.uint64)) for _ in range(60)] + [np.empty(0, np.uint64)] * 2
    sets += [np.arange(100, 108, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64)]  # exactly 0.8
    sets += [np.arange(200, 228, dtype=np.uint64), np.arange(200, 235, dtype=np.uint64)]  # exactly 0.8
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a) and len(b) and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8]
    want = plain_components(range(len(sets)), linked)
    assert similar.reached(sets, 0.8).tolist() == [want[i] for i in range(len(sets))]
    assert (63, 62) in linked or (len(sets) - 1, len(sets) - 2) in linked


@pytest.mark.parametrize("block", [512, 24])
def test_families_without_their_base_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", block)
    rng = random.Random(31)
    texts = [t for n, size, edits in ((120, 200, [3]), (20, 200, [1, 2, 3]), (40, 60, [0, 1]), (70, 150, [1, 2, 4])) for t in cloud(rng, size, n, edits)]
    texts += ["short one", "short  ONE", "one", "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_similar([t.lower() for t in texts])
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(texts) - 60


@pytest.mark.parametrize("by_list", [False, True])
def test_places_of_large_groups_are_bounded_and_whole(spark, monkeypatch, by_list):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 50)
    if by_list:  # a long chain of small lists is one cluster, and its lists are cheaper than its blocks
        postings = [(k, x) for k in range(400) for x in (k, k + 1)]
    else:  # one common list of 900, and lists inside it
        postings = [(0, x) for x in range(900)] + [(1 + x // 300, x) for x in range(900)]
    met = spark.createDataFrame([(k, n, 10) for k, n in postings], "key long, node long, n long")
    several = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), F.sum("n").alias("weight"))
    met = met.join(several, "key")
    clusters = components(met.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    places = {r["node"]: set(r["places"]) for r in similar.meetings(met, clusters).collect()}
    by_key = {}
    for k, n in postings:
        by_key.setdefault(k, []).append(n)
    assert all(places[a] & places[b] for nodes in by_key.values() for a in nodes[::7] for b in nodes)
    held = Counter(p for own in places.values() for p in own)
    assert max(held.values()) <= (2 if by_list else 180) and sum(held.values()) <= 900 * 18


@pytest.mark.parametrize("m", [1500, 3000, 6000])
def test_copies_of_a_family_grow_with_it(spark, m):
    met = spark.range(m).selectExpr("0L AS key", "id AS node", "400L AS n", f"{m}L AS size", "0L AS hub", f"{m}L * 400 AS weight")
    clusters = spark.range(m).selectExpr("id AS node", "0L AS root")
    placed = similar.first_places(met, clusters)
    held = Counter(p for r in placed.collect() for p in r["places"])
    assert sum(held.values()) <= 1.25 * m and max(held.values()) <= 1.4 * similar.BLOCK_TEXTS
    assert similar.meetings(met, clusters, clusters).collect() == []  # one component: nothing is left to meet
    some = clusters.selectExpr("node", "CASE WHEN node < 40 THEN node ELSE 40 END AS root")
    again = {r["node"]: set(r["places"]) for r in similar.meetings(met, clusters, some).collect()}
    assert all(again[x] & again[y] for x in range(0, 40, 7) for y in range(m)) and sum(map(len, again.values())) <= m + 40 * (m // 512 + 1)


def test_simhash_query_against_all_pairs(spark, tmp_path):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    while len(rows) < 2000:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 30])):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n "]).join(edited)))
    rows += [(3000, None), (3001, ""), (7, rows[9][1])] + [(4000 + i, "one hot text that stands very often") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    prints = {t: plain_fingerprint(t) for _, t in rows}
    distinct = sorted(set(prints.values()))
    array = np.array(distinct, np.uint64)
    root = plain_components(distinct, [(x, int(y)) for x in distinct for y in array[np.bitwise_count(array ^ np.uint64(x)) <= 2] if int(y) != x])
    first = {}
    for i, t in rows:
        first[root[prints[t]]] = min(i, first.get(root[prints[t]], i))
    want = Counter((i, f"{prints[t]:016x}", first[root[prints[t]]]) for i, t in rows)
    assert Counter(tuple(r) for r in simhash.op2_simhash(spark, str(tmp_path)).collect()) == want
    assert len(first) < len(distinct)
