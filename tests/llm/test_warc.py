"""Web archives: round trips, byte ranges, and what the standard's other readers see."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gridline.llm import warc

LONG = "<p>übung</p>" * 60_000
ROWS = [
    (1, "http://a/1", "x" * 100),
    (2, "http://a/2", "x" * 100),
    (7, "http://a/1", "x" * 100),
    (3, "http://b/ 1\r\nX-Other: 2", "x" * 99),
    (4, "http://b/2", "x" * 99),
    (5, None, LONG),
    (6, "http://c", None),
    (8, "http://c", ""),
    (9, "http://d", "head\r\n\r\nbody\r\n\r\n" * 20 + "日本\U0001f600"),
    (None, "http://e", LONG),
    (None, "http://f", "y" * 200),
    (2, "http://a/2", "x" * 100),
]


def pages(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", F.lit("x").alias("payload"), F.lit(1).alias("offset"), F.lit("y").alias("a.b"), F.create_map(F.lit("k"), F.lit(1)).alias("_first")).repartition(3)


def plain(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == i else refers
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    return warc.write_archives(pages(spark), folder, archive_bytes=1500), folder


def test_query_is_that_of_a_plain_loop(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op11_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plain(ROWS)


def test_no_pages_give_no_rows(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc(spark, str(tmp_path)).collect() == []


def test_index_says_where_records_lie(written):
    index, folder = written
    rows = sorted(index.collect(), key=lambda r: (r["archive"], r["offset"]))
    assert len(rows) == len(ROWS) and len({r["archive"] for r in rows}) > 3
    for r in rows:
        with open(f"{folder}/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            data = gzip.decompress(f.read(r["length"]))
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert data.endswith(b"\r\n\r\n")
        length = int(data.split(b"msgtype=response\r\nContent-Length: ")[1].split(b"\r\n")[0])
        assert len(data.split(b"\r\n\r\n", 1)[1]) == length + 4


def test_archives_are_whole_and_end_to_end(written):
    index, folder = written
    for name in {r["archive"] for r in index.select("archive").collect()}:
        rows = index.where(F.col("archive") == name).orderBy("offset").collect()
        size = os.path.getsize(f"{folder}/{name}")
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:], strict=False))
        assert rows[-1]["offset"] + rows[-1]["length"] == size
        with gzip.open(f"{folder}/{name}") as f:
            whole = f.read()
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"WARC-Record-ID") == len(rows) + 1


def test_payloads_come_back(spark, written):
    index, folder = written
    read = warc.read_records(index, folder).collect()
    assert len(read) == len(ROWS) and all((r["payload"] is None) == (r["record_type"] == "revisit") for r in read)
    assert {r["url"] for r in read} >= {"http://b/%201%0D%0AX-Other:%202", None}
    chosen = index.where("page_id IN (2, 5, 9, 6)")
    got = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.payloads(index, chosen, folder).collect()}
    assert got == {(i, html or "") for i, _, html in ROWS if i in (2, 5, 9, 6)}


def test_few_places_and_none(written):
    index, folder = written
    assert warc.read_records(index.limit(0), folder).collect() == []
    twice = index.where("page_id = 9")
    assert len(warc.read_records(twice.unionByName(twice), folder).collect()) == 2


def test_damage_is_seen(spark, tmp_path):
    folder = str(tmp_path)
    index = warc.write_archives(pages(spark, [(1, "u", "z" * 500)]), folder)
    row = index.first()
    digest = hashlib.sha256(b"z" * 500).hexdigest()
    forged = warc.record("1", "u", b"q" * 500, digest, None, "2000-01-01T00:00:00Z")
    with open(f"{folder}/{row['archive']}", "wb") as f:
        f.write(gzip.compress(forged))
    at = spark.createDataFrame([(row["archive"], 0, os.path.getsize(f"{folder}/{row['archive']}"))], "archive string, offset long, length long")
    with pytest.raises(Exception, match="isn't that of the digest"):
        warc.read_records(at, folder).collect()


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 10), ("a", 110, 200), ("b", 0, 5), ("b", 0, 5)]
    assert list(warc.ranges(iter(rows), most=40, gap=5)) == [("a", [(0, 10), (10, 10), (25, 5)]), ("a", [(100, 10)]), ("a", [(110, 200)]), ("b", [(0, 5), (0, 5)])]
    assert list(warc.ranges(iter([]))) == []


def test_a_frequent_digest_is_joined_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: df)
    rows = [(i, "u", "s" * 300) for i in range(400)] + [(i, "u", f"{i}" * 120) for i in range(400, 600)]
    index = warc.write_archives(pages(spark, rows), str(tmp_path))
    assert index.where("refers_to = 0 AND record_type = 'revisit'").count() == 399
    assert index.where("record_type = 'response'").count() == 201
