import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridline.operators.tables import records
from gridline.sources import files, json_rows, office, registry, sinks
from gridline.sources import text as S
from gridline.streaming import inbox

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(tables):
    cell = lambda t: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in t.split("\n")) + "</w:tc>"
    body = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/image1.png", b"png")
    return out.getvalue()


def test_text_kinds(spark):
    kinds = {"a,b,c\n1,2,3": "csv", "a\tb\tc\n1\t2\t3": "tsv", "a;b;c\n1;2;3": "semicolon", "a|b|c\n1|2|3": "pipe", "a   b\nc   d": "table", "some words\nmore": "plain", "single,line;": "plain", "": "plain"}
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, text string")
    assert [r["k"] for r in df.orderBy("i").select(S.text_kind(F.col("text")).alias("k")).collect()] == list(kinds.values())
    assert [S.kind_of(t) for t in kinds] == list(kinds.values())


def test_ragged_lines(spark):
    df = spark.createDataFrame([(1, "a;b\n1;2;3\n4\n5;6")], "doc int, text string")
    got = [r["cells"] for r in S.delimited(df, ["doc"]).orderBy("row_idx").collect()]
    assert got == [["a", "b"], ["4", None], ["5", "6"]]
    assert S.read_text("x.csv", "a;b;c\r\n1;2;3;4\r\n4\n5;6;7".encode())[0][1] == [["a", "b", "c"], ["4", None, None], ["5", "6", "7"]]


def test_decoding():
    assert S.decode("é\r\nx\ry".encode()) == "é\nx\ny"
    assert S.decode("привет".encode("cp1251"), lambda b: ("cp1251", 0.9)) == "привет"
    assert S.decode(b"abc", lambda b: ("nonsense", 0.9)) == "abc"
    assert S.decode("é".encode(), lambda b: ("latin-1", 0.3)) == "é"
    assert "�" in S.decode(b"\xff\x90\xfa", None)


@pytest.mark.parametrize("name", ["cp1251", "koi8-r", "cp866", "utf-8", "utf-8-sig", "utf-16"])
def test_encodings_are_told(name):
    text = "Наименование;Кол-во;Ед. изм.\nДержавка токарная;5;шт.\nПластина твердосплавная;10;шт.\n"
    assert S.read_text("x.csv", text.encode(name)) == S.read_text("x.csv", text.encode())
    assert S.read_text("x.csv", text.encode(name))[0][1][1] == ["Державка токарная", "5", "шт."]


def merged(cells):
    """A row of cells: (text, columns, merged from above)."""
    def one(text, span=1, merge=None):
        inner = f'<w:gridSpan w:val="{span}"/>' + (f'<w:vMerge w:val="{merge}"/>' if merge == "restart" else "<w:vMerge/>" if merge else "")
        return f"<w:tc><w:tcPr>{inner}</w:tcPr>{text if text.startswith('<w:') else f'<w:p><w:r><w:t>{text}</w:t></w:r></w:p>'}</w:tc>"

    return "<w:tr>" + "".join(one(*c) for c in cells) + "</w:tr>"


def test_merged_and_nested_cells():
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = "<w:tbl>" + merged([("head", 2), ("qty",)]) + merged([("a", 1, "restart"), ("b",), ("1",)]) + merged([("", 1, "continue"), ("c", 2)]) + merged([("", 1, "go"), (f"<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>{inner}",), ("",)]) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}<w:tbl>{merged([("second", 3, "restart")])}{merged([("", 3, "more")])}</w:tbl></w:body></w:document>')
    tables = office.read_document("x.docx", out.getvalue())
    assert tables == [
        ("table_1", [["head", "head", "qty"], ["a", "b", "1"], ["a", "c", "c"], ["a", "x\ty", None]]),
        ("table_2", [["second"] * 3, ["second"] * 3]),
    ]


def test_catalogue_lines(spark):
    df = spark.createDataFrame([(1, " Ref code A1 \nØ 5 ~ 7.5\nø 5 ~ 7\nnothing"), (2, None)], "page int, text string")
    assert [tuple(r) for r in S.catalogue_lines(df, ["page"]).orderBy("line_idx").collect()] == [(1, 0, "Ref code A1"), (1, 1, "Ø 5 ~ 7.5")]


def test_registry():
    @registry.register(" .ABC ", "")
    def first(name, data):
        return []

    @registry.register(".abc")
    def second(name, data):
        return []

    assert registry.reader("x/y.Abc") is second and registry.reader("none") is None


def test_files(spark, tmp_path):
    book = office.workbook({"One": [["a", "b"], ["1", None], [None, "x & <y>"]], "Empty": [], "Two": [["z"]]})
    content = {"b.xlsx": book, "t.txt": b"plain text", "e.txt": b"  \n", "d.docx": docx([[["h", "two\nlines"], ["", ""]], [["q"]]]), "bad.xlsx": b"no zip", "old.doc": b"x"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = files.scan(spark, str(tmp_path))
    assert {r["status"]: r["files"] for r in files.statuses(rows).collect()} == {"ok": 3, "empty": 1, "failed": 1, "unsupported": 1}
    ok = rows.where("status = 'ok'").collect()
    found = {(r["path"].rsplit("/", 1)[1], r["table_name"], r["row_idx"]): r["cells"] for r in ok}
    assert found["b.xlsx", "One", 2] == [None, "x & <y>"] and found["b.xlsx", "Two", 0] == ["z"]
    assert found["d.docx", "table_1", 0] == ["h", "two lines"] and found["d.docx", "table_2", 0] == ["q"]
    assert office.images(content["d.docx"]) == [("word/media/image1.png", b"png")]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": NaN, "y": "1"}, {"y": "2"}]')
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "h.csv").write_text("Наименование,Количество\n")
    assert json_rows.read_json(spark, str(tmp_path / "a.json"), "x double, y string").count() == 2
    assert json_rows.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert json_rows.csv_columns(spark, str(tmp_path / "h.csv")) == ["Наименование", "Количество"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", 0, ["x", None])], "doc string, row_idx int, cells array<string>")
    sinks.write_records(records(df, ["doc"], F.array(F.lit("a"), F.lit("b"))), str(tmp_path / "r"), ["doc"])
    assert spark.read.json(str(tmp_path / "r")).select("rec.a").first()["a"] == "x"
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sheet = office.read_workbook("x", sinks.to_workbook({"S": df.select("doc", "row_idx")}))
    assert sheet == [("S", [["doc", "row_idx"], ["d", "0"]])]
    with pytest.raises(ValueError):
        sinks.to_workbook({"S": spark.range(5)}, most=3)


def test_export_with_dimensions(spark, tmp_path):
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "simplified.csv").write_text("Наименование,Количество\n")
    (tmp_path / "model" / "extended.csv").write_text("a,b\n1,x\n")
    (tmp_path / "in.json").write_text('[{"k": "v", "n": "1"}, {"k": "w", "n": null}]')
    book = office.read_workbook("x", sinks.export_records(spark, str(tmp_path / "in.json"), str(tmp_path / "model")))
    assert book == [("INPUT", [["k", "n"], ["v", "1"], ["w", None]]), ("EXTENDED", [["a", "b"], ["1", "x"]]), ("SIMPLIFIED", [["Наименование", "Количество"]])]


def test_command_line(spark, tmp_path, capsys):
    from gridline.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("№;Наименование;Кол-во\n1;Сверло;5\n")
    assert main(["queries"]) == 0 and "header_row_locate" in capsys.readouterr().out
    assert main(["tables", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"no zip")
    assert main(["--quiet", "tables", str(tmp_path / "in"), str(tmp_path / "out")]) == 1
    assert main(["query", "quotas", "/root/testdata/sf0.001", str(tmp_path / "q")]) == 0
    with pytest.raises(SystemExit):
        main(["query", "none", "a", "b"])


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "a.txt").write_text("one\ntwo")
    run = lambda: inbox.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in" / "b.txt").write_text("three")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("separator", [";", "|", "\t", ","])
def test_quoted_fields_are_those_of_a_csv_reader(spark, separator):
    import csv
    import io
    import random

    rng = random.Random(separator)
    texts = ["".join(rng.choice(['"', '"', separator, separator, "\n", "a", "b c", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += [f'"x\ny"{separator}2{separator}3', f'a{separator}"b""c" d{separator}\r\n\r\n""\r1', '"never closed\n1', "", None, '"' + 'q""' * 800 + '"', f"{separator}\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").select("doc", S.fields(F.col("text"), separator).alias("rows"))
    got = {r["doc"]: r["rows"] for r in df.collect()}
    for i, text in enumerate(texts):
        lines = None if text is None else text.replace("\r\n", "\n").replace("\r", "\n")
        want = None if text is None else [r for r in csv.reader(io.StringIO(lines, newline=""), delimiter=separator) if r]
        assert got[i] == want or (not got[i] and not want), (text, got[i], want)
    if separator != ",":  # text that is separated by commas is read with semicolons
        assert S.read_text("x.csv", f'"x\ny"{separator}2{separator}3\n4{separator}5{separator}6\n'.encode())[0][1] == [["x\ny", "2", "3"], ["4", "5", "6"]]


def test_files_are_decoded_once(spark, tmp_path, monkeypatch):
    from gridline import pipeline

    log = str(tmp_path / "log")

    def read(name, data):
        with open(log, "a") as f:
            f.write(name + "\n")
        return [("t", [["№", "Наименование", "Кол-во"], ["1", "Сверло", "5"]])]

    monkeypatch.setattr(files, "readers", lambda: {".once": read})
    rows = spark.createDataFrame([(f"/x/{i}.once", b"") for i in range(5)], "path string, content binary")
    mapped, status = pipeline.process(rows, lambda prompts: ['{"rows": []}' for _ in prompts])
    mapped.collect()
    assert {(r["status"], r["files"]) for r in files.statuses(status).collect()} == {("ok", 5)}
    with open(log) as f:
        assert sorted(f.read().split()) == [f"{i}.once" for i in range(5)]
