"""Sharding, mixing, packing, chats and quality against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridline.llm import chat, common, mixing, packing, quality, sharding
from tests.llm.fixtures import DOCS, documents, plain_words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("none"), [])


def test_shards(spark, folder):
    rows = sharding.op4_sharding(spark, folder).collect()
    assert len(rows) == len(DOCS)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in DOCS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"key"}
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1


def test_shards_follow_weights(spark):
    ids = spark.range(40_000)
    weights = {0: 1.0, 1: 3.0, 2: 0.0, 3: 4.0}
    counts = {r["shard"]: r["count"] for r in sharding.assign(ids, "id", weights).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3}
    assert abs(counts[0] - 5000) < 400 and abs(counts[1] - 15000) < 600
    grown = sharding.assign(sharding.assign(ids, "id", weights), "id", weights | {4: 2.0}, "grown")
    assert grown.where("shard <> grown AND grown <> 4").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), {0: 0.0})


def test_shards_are_written(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sharding.write(docs, "doc_id", dict.fromkeys(range(3), 1.0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(DOCS)


def plain_targets(sizes, weights, share, cap):
    """Clamp at the cap, share the excess out by weight, until none is above."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * level >= cap * sizes[s]}
        if not above:
            return out | {s: weights[s] * level for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_mix(spark, tmp_path):
    rows = [(i, "w " * (i % 37), "en", ["s1", "s2", "s3", None, "hot"][i % 5 if i % 3 else 4], 0) for i in range(600)]
    where = documents(spark, tmp_path, rows)
    got = mixing.op6_mixing(spark, where).collect()
    again = mixing.op6_mixing(spark, where).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == 600
    source = {i: s for i, _, _, s, _ in rows}
    sizes = defaultdict(int)
    for i, t, *_ in rows:
        sizes[source[i]] += len(plain_words(t))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want = plain_targets(sizes, weights, 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 19 for s in sizes)


def test_mix_awkward(spark, folder, empty):
    assert len(mixing.op6_mixing(spark, folder).collect()) == len(DOCS)
    assert mixing.op6_mixing(spark, empty).collect() == []


def test_repeat(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, epochs long")
    assert sorted(r["doc_id"] for r in mixing.repeat(rows).collect()) == [2, 3, 3]


def test_boundaries_are_optimal():
    import random

    rng = random.Random(3)
    for _ in range(200):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 8)))
        counts, k = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 5)
        cost = lambda ends: sum(min(e for e in ends if e >= n) * c for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost([*some, lengths[-1]]) for r in range(k) for some in combinations(lengths[:-1], min(r, len(lengths) - 1)))
        found = packing.boundaries(lengths, counts, k)
        assert len(found) <= k and cost(found) == best


def test_packing(spark, folder, empty):
    rows = packing.op5_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in rows) == Counter((i, len(plain_words(t))) for i, t, *_ in DOCS)
    batches = defaultdict(list)
    for r in rows:
        assert r["n_words"] + r["padding"] == r["bucket_len"] and r["padding"] >= 0
        batches[r["bucket"], r["batch"]].append(r)
    for own in batches.values():
        assert sorted(r["place"] for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["bucket_len"] <= packing.BUDGET
    assert packing.op5_packing(spark, empty).collect() == []


def test_packing_refuses_clashing_names(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2)], "doc_id long, batch long"), F.lit(1), keep=("doc_id", "batch"))


def test_ranks_of_hot_and_equal_rows(spark):
    rows = [("a", 1, 5)] * 700 + [("a", None, 5)] * 300 + [("b", i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = common.gapless_rank(df, "g", ["k"], ["k", "v"], "at", 2).collect()
    assert Counter((r["g"], r["k"], r["v"]) for r in got) == Counter(rows)
    for g, n in (("a", 1000), ("b", 200)):
        assert sorted(r["at"] for r in got if r["g"] == g) == list(range(n))
    assert common.gapless_rank(df.limit(0), "g", ["k"], ["k", "v"], "at", 2).collect() == []


def test_texts_without_words_keep_the_cap(spark):
    rows = [(i, "" if i % 2 else "w w", "s") for i in range(40)] + [(i, "x " * 300, "big") for i in range(40, 44)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, common.word_count(F.col("text"))).collect()
    assert max(r["epochs"] for r in mixed) <= 2 and {r["epochs"] for r in mixed if r["source"] == "s" and r["size"]} == {2}


def test_cells_hold_lengths(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 511, 512, 513, 1023, 1024, 1025, 99_999, 10**12]], "n long")
    for r in df.select("n", packing.cell(F.col("n")).alias("c")).collect():
        assert r["n"] <= r["c"] <= r["n"] * (1 + 1 / 256) + 1


TURNS = [
    (1, 0, "system", "be <|kind|>"), (1, 1, "user", "a\\<|b"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (1, 3, "user", None), (1, 4, "assistant", "\\<\\|é\U0001f600<"),
    (2, 0, "assistant", "first"), (2, 1, "us<er\n%3C", "odd"), (3, 5, None, ""), (3, 5, None, ""), (None, 0, "user", "nobody"), (4, None, "user", "q"), (4, 1, "assistant", "a"),
]


def test_chats(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("state", F.lit("x"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r["conv_id"]: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    by = defaultdict(list)
    for c, n, role, text in [*TURNS, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        by[c].append((-1 if n is None else n, role or "", text or ""))
    assert set(rows) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert rows[c]["n_turns"] == len(own)
        assert rows[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert rows[c]["loss_chars"] == len(loss) and rows[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert [rows[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert rows[1]["complete"] and not rows[2]["complete"]


def test_no_chats(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in chat.op8_chat(spark, str(tmp_path)).collect()] == [-1]


def plain_measures(text):
    words, text = plain_words(text), text or ""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {p for i, w in enumerate(windows) if counts[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if plain_words(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, folder, empty):
    texts = {(r[0], r[1]): plain_measures(r[1]) for r in DOCS}
    rows = quality.op10_quality(spark, folder).collect()
    want = Counter((i, *texts[i, t]) for i, t, *_ in DOCS)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.op10_quality(spark, empty).collect() == []


def test_repeated_words(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measures(df).collect()}
    assert got == {i: plain_measures(t)[4] for i, t in enumerate(texts)}


def test_cells_of_ratios(spark):
    values = [0, 1, 1023, 1024, 1025, 2047, 2048, 99_999, 10**9 + 7, 10**15]
    cells = [r["c"] for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.cell(F.col("v")).alias("c")).orderBy("v").collect()]
    assert cells[:4] == [0, 1, 1023, 1024] and all(c <= v <= c * (1 + 1 / 512) for v, c in zip(values, cells, strict=True)) and len(set(cells)) == len(values) - 1


def test_long_words_have_fences_too(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("あいうえおかきくけこ") for _ in range(n))
    usual = [" ".join(word(rng.randint(150, 250)) for _ in range(60)) for _ in range(300)]
    odd = [" ".join(word(rng.randint(900, 1100)) for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "ja", "s") for i, t in enumerate(usual + odd)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(quality.measures(df)).collect()}
    assert sum(kept[i] for i in range(300)) >= 297 and not any(kept[i] for i in range(300, 320))


def test_verdicts_do_not_depend_on_tasks(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ccc#", "dddd"]) for _ in range(rng.randint(40, 90))), rng.choice(["en", None]), rng.choice(["s", "t", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = [{tuple(r) for r in quality.judge(quality.measures(df.repartition(n))).collect()} for n in (1, 7)]
    assert judged[0] == judged[1]


def test_clean_documents_stay(spark):
    import random

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(600)]
    junk = [" ".join(f"{rng.choice(vocabulary)}###$$" for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(quality.measures(df)).collect()}
    assert sum(kept[i] for i in range(600)) >= 594
    assert not any(kept[i] for i in range(600, 660))
