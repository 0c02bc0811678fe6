"""Web archives (WARC), written with an index and read back by byte ranges.

A record is a gzip member of its own, so that it can be read without what
stands before it. The index has a row for each record: archive, offset, length,
URL and digest. A reader selects rows of the index, sorts them by place, joins
neighbours into few ranges and reads each range once.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridline.llm.common import BATCH_BYTES, bounded, cut, remove, shared_folder, small, table

#: Payloads from here on are written once only.
LEAST_BYTES = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Bytes of one read, and of the gaps between records that it may run over.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of archives that a task reads.
TASK_BYTES = 64 << 20

# Names that the WARC 1.1 standard gives.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "url string, payload_bytes long, payload_digest string, record_type string, archive string, offset long, length long"
RECORD = "archive string, offset long, record_type string, url string, payload_bytes long, payload_digest string, payload binary"


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a folder and its path there, for the driver and workers alike."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def line_safe(value: str) -> str:
    """value with blanks and control characters as %XX, so that it stays on its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def headed(first: str, fields: list[tuple[str, object]]) -> bytes:
    """A first line, the fields that have a value, and a blank line."""
    lines = [first, *[f"{name}: {value}" for name, value in fields if value is not None]]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """The bytes of a response, or of a revisit (refers_to), whose block has the response's head but no payload."""
    http = headed("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page) if page is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else line_safe(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers_to is None else SAME_PAYLOAD),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("Page-Id", page),
        ("Refers-To-Page", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return headed(VERSION, fields) + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """The fields of a record, the bytes of its payload and, of a response, the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    if not head.startswith(b"WARC/") or len(rest) < int(fields["content-length"]):
        raise ValueError("these bytes are no whole WARC record")
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, int(fields_of(http)["content-length"]), payload if fields["warc-type"] == "response" else None


def marked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null: a response) of every page.

    Of pages with equal payloads of at least least bytes those of the smallest
    page_id are responses. Digests that stand twice or more are counted before
    they meet the payloads: as a broadcast where they're few, else as a join by
    digest, which adaptive execution splits where one digest is frequent.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    long_ones = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
    several = long_ones.agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first")).where("_n > 1").select("payload_digest", "_first")
    told = rows.join(small(cut(several)), "payload_digest", "left")
    return told.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the index.

    folder must be one that all executors and the driver reach (a path or URI
    that pyarrow opens: local, hdfs, s3, gs); archives lie in it, the index in
    its subfolder index, as Parquet: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, archive, offset, length. A task
    writes archives of names of its own, and only those that the committed
    index names count, so that lost and repeated tasks leave no record twice.
    Null html is an empty payload, a null url is left out of its record, a null
    page_id never is what others refer to; rows with one page_id and payload
    are all responses. Other columns are ignored; no rows give an empty index.
    date is the WARC-Date, the current time by default.
    """
    spark = pages.sparkSession
    bounded(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    place, top = store(folder)
    place.create_dir(top, recursive=True)
    rows = marked(pages)
    key = rows.schema["page_id"].dataType
    schema = StructType().add("page_id", key).add("refers_to", key)
    schema = StructType([*schema, *StructType.fromDDL(INDEX)])

    def write(batches: Iterator[pa.RecordBatch]):
        disk, top = store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places = []
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "refers_to")]
                for page, url, digest, refers, payload in zip(*columns, batch.column("payload"), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = disk.open_output_stream(f"{top}/{name}", compression=None)
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Length", 0)]
                        at = out.write(gzip.compress(headed(VERSION, info) + b"\r\n\r\n", mtime=0))
                    page, refers = (None if x is None else str(x) for x in (page, refers))
                    data = gzip.compress(record(page, url, payload.as_py(), digest, refers, date), mtime=0)
                    out.write(data)
                    places.append((name, at, len(data)))
                    at += len(data)
                names, offsets, lengths = zip(*places, strict=True) if places else ((),) * 3
                kind = ["response" if x is None else "revisit" for x in columns[3]]
                same = [batch.column(c) for c in ("page_id", "refers_to", "url", "payload_bytes", "payload_digest")]
                own = [pa.array(kind, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, *own], names=schema.names)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return spark.read.schema(schema).parquet(f"{folder}/index")


def ranges(rows: Iterator[tuple[str, int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """archive and the (offset, length) of the records of each read.

    rows are sorted by archive and offset; records share a read if gaps between
    them are small and all of it is no longer than most (or one record).
    """
    archive, held, end = None, [], 0
    for name, offset, length in rows:
        if held and (name != archive or offset - end > gap or offset + length - held[0][0] > most):
            yield archive, held
            held = []
        end = offset + length if not held else max(end, offset + length)
        archive = name
        held.append((offset, length))
    if held:
        yield archive, held


def read_records(chosen: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the places of chosen(archive, offset, length), some rows of an index.

    Returns archive, offset, record_type, page_id and refers_to (strings), url,
    payload_bytes, payload_digest and payload: null for revisits, which have
    none, and for all if payloads is off. The digest of a response is taken
    from the bytes that were read and must be that of its header, else the
    record is damaged and the task fails; that of a revisit is its header's.
    Places are dealt by stretches of an archive, however many of its records
    are chosen, and sorted; a task holds a read of 8 MB or one record. A place
    that stands twice is returned twice, no places give an empty result.
    """
    spark = chosen.sparkSession
    bounded(spark)
    total = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    dealt = chosen.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    schema = StructType([*StructType.fromDDL("page_id string, refers_to string"), *StructType.fromDDL(RECORD)])

    def read(batches: Iterator[pa.RecordBatch]):
        disk, top = store(folder)
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True))
        held, size, opened, file = [], 0, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if f.name == "payload" else pa.int64() if f.name in ("offset", "payload_bytes") else pa.string()) for x, f in zip(columns, schema, strict=True)], names=schema.names)

        for archive, places in ranges(rows):
            if archive != opened:
                if file is not None:
                    file.close()
                opened, file = archive, disk.open_input_file(f"{top}/{archive}")
            start = places[0][0]
            data = file.read_at(max(o + n for o, n in places) - start, start)
            for offset, length in places:
                fields, count, payload = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if payload is not None and (len(payload) != count or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{archive}, offset {offset}: the payload isn't that of the digest")
                held.append((fields.get("page-id"), fields.get("refers-to-page"), archive, offset, fields["warc-type"], fields.get("warc-target-uri"), count, digest, payload if payloads else None))
                size += len(payload or b"") + 500
                if size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        if file is not None:
            file.close()
        if held:
            yield batch()

    return dealt.mapInArrow(read, schema)


def payloads(index: DataFrame, chosen: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload of rows chosen from an index; a revisit gets the payload of the response with its digest.

    A payload that several chosen rows share is read once.
    """
    wanted = chosen.select("page_id", "url", "payload_digest", "record_type", "archive", "offset", "length")
    own = wanted.where("record_type = 'response'")
    others = wanted.where("record_type = 'revisit'")
    of_digest = index.where("record_type = 'response'").join(others.select("payload_digest").distinct(), "payload_digest", "left_semi")
    of_digest = of_digest.groupBy("payload_digest").agg(F.min(F.struct("archive", "offset", "length")).alias("_at"))
    found = others.select("page_id", "url", "payload_digest").join(of_digest, "payload_digest").select("page_id", "url", "_at.*")
    placed = own.select("page_id", "url", "archive", "offset", "length").unionByName(found)
    read = read_records(placed.select("archive", "offset", "length").distinct(), folder).select("archive", "offset", "payload")
    return placed.join(read, ["archive", "offset"]).select("page_id", "url", "payload")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back whole; the result is kept, the archives are deleted.

    Nulls, ties and repeated rows are as write_archives says; no pages give no rows.
    """
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder)
    read = read_records(index, folder, payloads=False)
    key = index.schema["page_id"].dataType
    found = cut(read.select(F.col("page_id").cast(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key)))
    remove(spark, folder)
    return found


OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
