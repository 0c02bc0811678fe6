"""Text files: encoding, kind, and rows of cells."""

from __future__ import annotations

import io
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridline.functions.text import strip
from gridline.operators.layout import let
from gridline.operators.ruled import runs
from gridline.sources.registry import Table, register

KINDS = {"csv": ";", "semicolon": ";", "tsv": "\t", "pipe": "|"}


def text_kind(text: Column) -> Column:
    """plain, csv, tsv, semicolon, pipe or table, from the first five lines. Null is plain."""
    lines = F.split(strip(F.coalesce(text, F.lit(""))), "\n")
    head = F.slice(lines, 1, 5)
    k = F.size(head)
    joined = F.array_join(head, "\n")
    count = lambda c: F.length(joined) - F.length(F.replace(joined, F.lit(c), F.lit("")))
    wide = F.size(F.filter(head, lambda x: x.rlike(r"\s{2,}")))
    kinds = F.when(count(",") > k, "csv").when(count("\t") > k, "tsv").when(count(";") > k, "semicolon").when(count("|") > k, "pipe")
    return F.when(F.size(lines) < 2, "plain").otherwise(kinds.when(wide > 0.6 * k, "table").otherwise("plain"))


def whitespace_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, row_idx, cells: lines cut at two or more spaces, filled with empty cells to the widest."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.filter(F.split(x, r"\s{2,}"), lambda c: c != ""))
    wide = df.select(*keys, cells.alias("_t")).withColumn("_w", F.coalesce(F.array_max(F.transform("_t", F.size)), F.lit(0)))
    filled = F.transform("_t", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("_w") - F.size(r))))
    return wide.select(*keys, F.posexplode(filled).alias("row_idx", "cells"))


def fields(text: Column, separator: str) -> Column:
    """array<array<string>>: rows of fields, by a quote automaton as one pattern.

    A field that begins with a quote goes to the next single one, over
    separators and line breaks; a doubled quote in it is one, what stands
    behind it up to the separator belongs to the field, and without an end it
    goes to the end of the text. A quote inside another field is a sign like
    others. Line ends are \\n, \\r\\n or \\r; blank lines are left out. Null has no
    rows.
    """
    sep = "\\Q" + separator + "\\E"
    plain = f"(?:(?!{sep})[^\\n])*+"
    quoted = '"([^"]*+(?:""[^"]*+)*+)"?(' + plain + ")"
    lines = F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n"))
    found = F.regexp_extract_all(lines, F.lit(f"(?:{sep}|\\n)(?:{quoted}|{plain})"), 0)

    def value(part: Column) -> Column:
        body = F.substring(part, F.when(part.startswith("\n"), 2).otherwise(1 + len(separator)), F.length(part))
        inner = F.concat(F.replace(F.regexp_extract(body, "(?s)^" + quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(body, "(?s)^" + quoted, 2))
        return F.struct(part.startswith("\n").alias("begins"), (body != "").alias("filled"), F.when(body.startswith('"'), inner).otherwise(body).alias("value"))

    rows = let(F.transform(found, value), lambda held: runs(held, lambda a, b: b["begins"]))
    whole = F.filter(rows, lambda r: (F.size(r) > 1) | F.get(r, F.lit(0))["filled"])
    return F.transform(whole, lambda r: F.transform(r, lambda f: f["value"]))


def delimited(df: DataFrame, keys: list[str], separator: str = ";", text: str = "text") -> DataFrame:
    """keys, row_idx, cells: fields() of a text; the first line fixes the width, longer lines are skipped, shorter ones filled with null."""
    parsed = df.select(*keys, fields(F.col(text), separator).alias("_r")).withColumn("_w", F.size(F.get("_r", F.lit(0))))
    fit = F.filter("_r", lambda r: F.size(r) <= F.col("_w"))
    filled = F.transform(fit, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), F.col("_w") - F.size(r))))
    return parsed.select(*keys, F.posexplode(filled).alias("row_idx", "cells"))


#: Fixed value. Lines of a catalogue page that name a reference code or a range of diameters.
CATALOGUE_LINE = r"(?i:REF\.?\s*CODE)|Ø\s*\d+(\.\d+)?\s*~\s*\d+(\.\d+)?"


def catalogue_lines(df: DataFrame, keys: list[str], text: str = "text", pattern: str = CATALOGUE_LINE) -> DataFrame:
    """keys, line_idx, line (stripped) of the lines that the pattern finds. Null texts have none."""
    found = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_idx", "line")).where(F.col("line").rlike(pattern))
    return found.withColumn("line", strip(F.col("line")))


def plain_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return df.select(*keys, F.posexplode(F.transform(lines, lambda x: F.array(x))).alias("row_idx", "cells"))


#: Byte order marks, and the single-byte encodings that Russian texts come in.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
_COMMON = frozenset("оеаинтсрвлкмдпуяыьгз")


def sniffed(data: bytes) -> tuple[str | None, float]:
    """An encoding and how sure it is: a mark, else valid UTF-8, else the Cyrillic page that reads most like Russian.

    A page's share is that of common small letters among its letters beyond
    ASCII, and 0 if a third of the signs beyond ASCII are no letters. The wrong
    pages turn small letters into capitals or signs.
    """
    for mark, name in MARKS.items():
        if data.startswith(mark):
            return name, 1.0
    try:
        data.decode("utf-8")
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    best: tuple[str | None, float] = (None, 0.0)
    for name in CYRILLIC:
        beyond = [c for c in data.decode(name, errors="replace") if ord(c) > 127]
        letters = [c for c in beyond if "а" <= c.lower() <= "я" or c.lower() == "ё"]
        # capitals at the head of words are usual, so a share of 0.6 is as good as sure
        share = min(1.0, sum(c in _COMMON for c in letters) / max(1, len(letters)) / 0.6) if 3 * len(letters) >= 2 * len(beyond) else 0.0
        if share > best[1]:
            best = name, share
    return best


def decode(data: bytes, detect: Callable[[bytes], tuple[str | None, float]] | None = sniffed, least: float = 0.7) -> str:
    """Text with \\n line ends; the detected encoding counts from a confidence of 0.7, else UTF-8."""
    encoding = "utf-8"
    if detect is not None:
        try:
            name, sure = detect(data)
            encoding = name if name and sure >= least else encoding
            "".encode(encoding)
        except Exception:  # noqa: BLE001 - whatever a detector does, UTF-8 is the answer
            encoding = "utf-8"
    return re.sub("\r\n?", "\n", data.decode(encoding, errors="replace"))


def kind_of(text: str) -> str:
    lines = text.strip().split("\n")
    if len(lines) < 2:
        return "plain"
    head = lines[:5]
    for kind, mark in (("csv", ","), ("tsv", "\t"), ("semicolon", ";"), ("pipe", "|")):
        if sum(x.count(mark) for x in head) > len(head):
            return kind
    return "table" if sum(bool(re.search(r"\s{2,}", x)) for x in head) > 0.6 * len(head) else "plain"


@register(".txt", ".csv")
def read_text(name: str, data: bytes) -> list[Table]:
    import csv

    text = decode(data)
    if not text.strip():
        return []
    kind = kind_of(text)
    if kind in KINDS:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=KINDS[kind]) if r]  # as fields() has it
        width = len(rows[0])
        return [(kind, [[c or None for c in r] + [None] * (width - len(r)) for r in rows if len(r) <= width])]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if kind == "table":
        rows = [[c for c in re.split(r"\s{2,}", x) if c] for x in lines]
        width = max(map(len, rows))
        return [(kind, [r + [""] * (width - len(r)) for r in rows])]
    return [(kind, [[x] for x in lines])]


def with_ordinals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """row_idx from 0 without gaps, in the old order."""
    return rows.withColumn("row_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx")) - 1)
