"""Command line: python -m gridline tables FOLDER OUT | query NAME TABLES OUT | queries."""

from __future__ import annotations

import argparse
import logging

log = logging.getLogger("gridline")


def main(args: list[str] | None = None) -> int:
    """Exit code 0, or 1 if a file failed."""
    parser = argparse.ArgumentParser(prog="gridline", description="Tables of files as records, and queries over tables.")
    parser.add_argument("--quiet", action="store_true", help="only warnings")
    commands = parser.add_subparsers(dest="command", required=True)
    tables = commands.add_parser("tables", help="read all files of a folder and write their tables as JSON records")
    tables.add_argument("folder")
    tables.add_argument("out")
    query = commands.add_parser("query", help="run a query over the tables of a folder and write it as Parquet")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("out")
    commands.add_parser("queries", help="list the queries")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.WARNING if given.quiet else logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")

    from gridline.plans import catalog
    from gridline.session import local_session, ship

    if given.command == "queries":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if given.command == "query" and given.name not in catalog.queries():
        parser.error(f"no query {given.name}")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    if given.command == "query":
        catalog.queries()[given.name](spark, given.folder).write.mode("overwrite").parquet(given.out)
        log.info("%s: %d rows in %s", given.name, spark.read.parquet(given.out).count(), given.out)
        return 0
    return _tables(spark, given.folder, given.out)


def _tables(spark, folder: str, out: str) -> int:
    from gridline import pipeline
    from gridline.session import cut
    from gridline.sources import files, sinks

    rows = cut(files.scan(spark, folder))  # decoded once, for the tables and the counts
    sinks.write_records(pipeline.clean_tables(rows), out, pipeline.KEYS)
    failed = 0
    for r in files.statuses(rows).collect():
        log.log(logging.WARNING if r["status"] in ("failed", "unsupported") else logging.INFO, "%s: %d files", r["status"], r["files"])
        failed += r["files"] if r["status"] == "failed" else 0
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
