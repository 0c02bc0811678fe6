"""Workbooks and word-processor files, read from their zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from gridline.sources.registry import Table, register

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    number = 0
    for c in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def _text(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _whole(value: str) -> str:
    return value[:-2] if re.fullmatch(r"-?\d+\.0", value) else value


@register(".xlsx", ".xlsm")
def read_workbook(name: str, data: bytes) -> list[Table]:
    """All sheets in order, as text; empty sheets are left out."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(si, MAIN + "t") for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(MAIN + "si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    tables = []
    for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
        path = targets[sheet.get(REL + "id")].lstrip("/")
        rows: list[list[str | None]] = []
        for row in ET.fromstring(book.read(path if path.startswith("xl/") else f"xl/{path}")).iter(MAIN + "row"):
            at = int(row.get("r", len(rows) + 1)) - 1
            while len(rows) <= at:
                rows.append([])
            for cell in row.iter(MAIN + "c"):
                place = _column(cell.get("r")) if cell.get("r") else len(rows[at])
                value, kind = cell.find(MAIN + "v"), cell.get("t")
                if kind == "inlineStr":
                    found = _text(cell, MAIN + "t")
                elif value is None or value.text is None:
                    continue
                else:
                    found = shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else _whole(value.text)
                rows[at].extend([None] * (place + 1 - len(rows[at])))
                rows[at][place] = found
        width = max(map(len, rows), default=0)
        if width:
            tables.append((sheet.get("name"), [r + [None] * (width - len(r)) for r in rows]))
    return tables


def _paragraph(node: ET.Element) -> str:
    """A paragraph's text with its tabs and line breaks."""
    marks = {WORD + "tab": "\t", WORD + "br": "\n", WORD + "cr": "\n", WORD + "noBreakHyphen": "-"}
    return "".join(marks.get(x.tag) or (x.text or "" if x.tag == WORD + "t" else "") for x in node.iter())


def _merged_rows(table: ET.Element) -> list[list[str | None]]:
    """The rows of a table with merged cells written out: a cell stands in every column and row that it covers."""
    rows: list[list[str | None]] = []
    above: dict[int, tuple[str, int]] = {}
    for row in table.findall(WORD + "tr"):
        before = row.find(f"{WORD}trPr/{WORD}gridBefore")
        at, here, cells = int(before.get(WORD + "val", "0")) if before is not None else 0, {}, []
        for cell in row.findall(WORD + "tc"):
            span, merged = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
            own = int(span.get(WORD + "val", "1")) if span is not None else 1
            text = "\n".join(map(_paragraph, cell.findall(WORD + "p"))).strip().replace("\n", " ")
            if merged is not None and merged.get(WORD + "val", "continue") == "continue":
                text = above.get(at, (text, own))[0]
            here[at] = text, own
            cells += [text or None] * own
            at += own
        above = here
        rows.append(cells)
    return rows


@register(".docx")
def read_document(name: str, data: bytes) -> list[Table]:
    """All tables of the body in order; a cell is its stripped paragraphs, line breaks as spaces.

    Merged cells stand in all columns and rows that they cover; a table inside
    a cell belongs to neither that cell nor the list.
    """
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(WORD + "body")
    tables = []
    for number, table in enumerate([] if body is None else body.findall(WORD + "tbl")):
        rows = [r for r in _merged_rows(table) if any(r)]
        width = max(map(len, rows), default=0)
        if width:
            tables.append((f"table_{number + 1}", [r + [None] * (width - len(r)) for r in rows]))
    return tables


def images(data: bytes) -> list[tuple[str, bytes]]:
    """Name and bytes of every picture inside a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, z.read(n)) for n in z.namelist() if n.startswith("word/media/") and not n.endswith("/")]


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def workbook(sheets: dict[str, list[list[str | None]]], widths: dict[str, list[int]] | None = None) -> bytes:
    """A workbook of text cells, sheets in order, with column widths if given."""
    out = io.BytesIO()
    name = lambda i: "".join(chr(65 + d) for d in ([i // 26 - 1] if i >= 26 else []) + [i % 26])
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        entries = "".join(f'<sheet name="{_escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{entries}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (sheet, rows) in enumerate(sheets.items(), 1):
            cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate((widths or {}).get(sheet, []), 1))
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{name(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{_escape(str(v))}</t></is></c>' for k, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{MAIN[1:-1]}">' + (f"<cols>{cols}</cols>" if cols else "") + f"<sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()
