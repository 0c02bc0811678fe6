import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridline.functions import extract as E
from gridline.model import EXTENDED, SIMPLIFIED
from gridline.operators import evaluate as V
from gridline.operators import images as I
from gridline.operators import knowledge as K
from gridline.operators import mapping as M
from gridline.operators import ocrtext as O
from gridline.operators import tables as T
from gridline.operators import training as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_extraction(spark):
    goods = F.lit("Запись 1: Товары работы услуги: Патрон Цанговый Sandvik ER32-80 HSK-A63 ø 40 x 10 \nКол.: 7")
    assert one(spark, E.denotation(goods))["evidence"] == ["Найдено обозначение: ER32 R32 A63 HSK-A63 ER32-80"]
    assert one(spark, E.maker(goods))["evidence"] == ["Найден возможный производитель: Sandvik (в описании товара)"]
    assert one(spark, E.parameters(goods))["evidence"] == ["Размеры: ø40 x 10", "HSK: A63", "ER: 32"]
    upper = one(spark, E.parameters(F.lit("LОБЩ = 80 мм Ø 12,5 ММ")))
    assert upper["evidence"] == ["Диаметр: ø12,5 мм", "Lобщ: 80", "размер_хвостовика: 80, 5"] and upper["confidence"] == 0.8
    assert one(spark, E.parameters(F.lit("нет")))["evidence"] == ["Параметры не найдены"]
    assert one(spark, E.tool_name(F.lit("твердая Фреза концевая 12 мм длинная")))["evidence"] == ["Найдено наименование: твердая Фреза концевая 12 (тип: Фреза)"]
    assert one(spark, E.tool_name(F.lit("Наименование: Болт | x")))["confidence"] == 0.7
    assert one(spark, E.maker(F.lit("Производитель:  | x")))["confidence"] == 0.2
    assert one(spark, E.technical_task(F.lit("(текст) Код заказа: 123")))["evidence"] == ["Код заказа: 123", "текст"]
    assert one(spark, E.maker_by_code(F.lit("cnmg120408"))) == "Sandvik"
    assert one(spark, E.maker_by_code(F.lit("zzz"))) == E.UNKNOWN
    assert one(spark, E.type_by_words(F.lit("HSK only"))) == E.UNKNOWN
    steps = one(spark, E.reasoning(F.lit("Наименование: Сверло | Количество: 5")))
    assert [s["step_number"] for s in steps] == [1, 2, 3, 4, 5, 7, 7]
    summary = one(spark, E.reasoning_summary(E.reasoning(F.lit("x"))))
    assert summary["steps"] == 7 and summary["low"] == 5


def test_accuracy(spark):
    score = lambda p, e: one(spark, V.field_score(F.lit(p), F.lit(e)))
    assert [score(" A b", "a B "), score("abc", "ab"), score("", "x"), score("", ""), score("q", "z"), score(None, "")] == [1.0, 0.5, 0.5, 1.0, 0.0, 1.0]
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    assert one(spark, V.accuracy(m("a", "x"), m("a", "x", "b", "y"))) == 0.75
    assert one(spark, V.accuracy(m().cast("map<string,string>"), m("a", "x"))) == 0.0


def test_quotas(spark):
    def quota(capacities, most=50):
        files = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(capacities)], "file string, capacity long")
        return [r["quota"] for r in R.quotas(files, most).orderBy("file").collect()]

    assert quota([10, 10]) == [10, 10] and quota([100, 100, 100]) == [17, 17, 16] and quota([5, 100]) == [5, 25]
    assert quota([0, 100]) == [0, 25]


def test_records_and_labels(spark):
    rows = spark.createDataFrame([("f", 0, "a", None), ("f", 1, "b", "c")], "file string, row_idx int, n string, m string")
    joined = R.aligned({"x": rows, "y": rows.where("row_idx = 1")}, ["file"])
    assert joined.count() == 1
    out = R.records(joined, R.sheet_prompt(F.col("x"), ["n", "m"], F.lit(3)), {"simplified": R.filled(F.col("y"), ["n"]), "extended": R.filled(F.col("y"), ["n", "m"])}, {"simplified": "s", "extended": "e"}, ["row_idx"])
    got = out.collect()
    assert [r["mode"] for r in got] == ["simplified", "extended"] and got[0]["user"] == "Запись 3:\n  n: b\n  m: c"
    assert json.loads(got[1]["assistant"]) == {"rows": [{"n": "b", "m": "c"}]}
    labels = R.masked_labels(F.array(*[F.lit(i).cast("long") for i in range(4)]), F.lit(2))
    assert one(spark, labels) == [-100, -100, 2, 3]
    assert R.sample(rows, "row_idx", 5, "s").count() == 2


def test_knowledge(spark):
    entities, relations = K.entities(spark), K.relations(spark)
    assert (entities.count(), relations.count()) == (38, 26)
    near = [r["neighbour"] for r in K.neighbours(relations).where("name = 'Державка'").orderBy("ord").collect()]
    assert near == ["Sandvik", "DAndrea", "JieHe", "режущий_инструмент"]
    assert K.add_relations(relations, relations).count() == 26
    changed = K.upsert(entities, entities.where("name = 'мм'").withColumn("type", F.lit("новый")))
    assert changed.count() == 38 and changed.where("name = 'мм'").first()["type"] == "новый"
    card = K.cards(entities, relations).where("name = 'Винт'").first()
    assert card["relations"] == [] and card["attributes"]["категория"] == "крепежный_элемент"


def test_mapping(spark):
    rows = spark.createDataFrame([("d", i, [str(i)]) for i in range(7)], "doc string, row_idx int, cells array<string>")
    records = T.records(rows, ["doc"], F.array(F.lit("n")))

    def model(prompts):
        out = []
        for p in prompts:
            if "n: 5" in p:
                out.append("no JSON")
            else:
                out.append('```json\n{"rows": [{"Наименование": "x", "extra": 1}]}\n```')
        return out

    got = M.map_records(records, ["doc"], model).orderBy("chunk_idx").collect()
    assert [(r["chunk_idx"], r["Наименование"], r["Количество"], r["error"]) for r in got] == [(0, "x", "", None), (1, "", "", "not the JSON asked for")]

    def broken(prompts):
        raise RuntimeError("no model")

    assert {r["error"] for r in M.map_records(records, ["doc"], broken, extended=False).collect()} == {"no model"}
    assert list(M.json_schema(SIMPLIFIED)["$defs"]["TableRow"]["properties"]) == SIMPLIFIED and len(EXTENDED) == 6


def test_ocr_repair(spark):
    from gridline.functions import fuzzy as Z

    ratios = [one(spark, Z.ratio(F.lit(a), F.lit(b))) for a, b in (("abcd", "abxd"), ("", ""), ("a", ""))]
    assert ratios == [75.0, 100.0, 0.0]
    cells = spark.createDataFrame([(1, "Pe3eц"), (2, "Плаcтина 5шт"), (3, "Sandvlk"), (4, None), (5, "  "), (6, "CCМТ120404"), (7, "державкa")], "id int, text string")
    got = {r["id"]: r["text"] for r in O.repaired(cells, ["id"]).collect()}
    assert got == {1: "Резец", 2: "Пластина 5 шт.", 3: "Sandvik", 4: None, 5: "  ", 6: "CCMT120404", 7: "державка"}
    more = spark.createDataFrame([(1, "D`Andrea"), (2, "паrрон"), (3, "- “lscar” 2 ШТ, rоловка"), (4, "(Sandvlk)")], "id int, text string")
    assert {r["id"]: r["text"] for r in O.repaired(more, ["id"]).collect()} == {1: "D'Andrea", 2: "патрон", 3: '" Iscar " 2 шт., головка', 4: "( Sandvik )"}


def test_large_dictionaries_are_indexed(spark, monkeypatch):
    words = spark.createDataFrame([("держаква",), ("x",), (None,), ("сверло",)], "word string")
    terms = spark.createDataFrame([(w, w, i) for i, w in enumerate(["державка", "сверла", "свёрла", "фреза"])], "term string, match string, ord long")
    want = {r["word"]: (r["match"], r["score"]) for r in O.nearest(words, terms, 60.0).collect()}
    monkeypatch.setattr(O, "TERM_ROWS", 1)
    assert {r["word"]: (r["match"], r["score"]) for r in O.nearest(words, terms, 60.0).collect()} == want
    assert set(want) == {"держаква", "сверло"}
    readings = one(spark, O.ambiguous(F.lit("rpaф")))
    assert readings == ["граф", "траф"]


def test_images(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert (I.invert(I.invert(image)) == image).all()
    assert I.resize(image).shape == (736 + 100, round(60 * 736 / 40) + 100, 3)
    assert I.resize(np.zeros((800, 900), np.uint8)).shape == (900, 1000)
    half = np.full((20, 20), 40, np.uint8)
    half[:, 10:] = 200
    assert 40 <= I.otsu(half) < 200 and set(np.unique(I.binarize(half))) == {0, 255}
    assert I.contrast(half).shape == half.shape and I.lighting(image).shape == (40, 60) and I.sharpen(image).shape == image.shape
    assert (I.sharpen(np.full((9, 9), 77, np.uint8)) == 77).all()
    rows = [("a.png", 40, 60, 3, bytearray(image.tobytes())), ("b.png", 9, 9, 1, bytearray(b"short"))]
    frame = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")
    few = I.Stages(on={"invert": False, "binarize": False, "distortion": False, "denoise": False})
    out = {r["path"]: r for r in I.prepare_all(frame, few).collect()}
    assert out["a.png"]["channels"] == 1 and out["a.png"]["error"] is None and out["b.png"]["error"]
    seen = I.stage_images(frame, few).collect()
    assert [r["name"] for r in seen] == [f"a_{s}" for s in few.active()] and bytes(seen[-1]["data"]) == bytes(out["a.png"]["data"])
    with pytest.raises(ValueError, match="distortion"):
        I.prepare(image, I.Stages(on={"invert": False}))  # asked for, and not plugged in
    angles = F.array(*[F.lit(float(a)) for a in (1, 2, 4, 80)])
    assert one(spark, I.skew(angles)) == 2.0 and one(spark, I.largest(angles, 2)) == [80.0]
    assert one(spark, I.scale_of(F.lit(368), F.lit(1000))) == 2.0


def test_pages_are_straightened():
    page = np.full((160, 220), 255, np.uint8)
    for top in range(20, 140, 20):
        page[top : top + 5, 30:190] = 0
    assert I.slope(page) == 0.0 and (I.deskew(page) == page).all()
    for angle in (-7.0, 3.0):
        assert abs(I.slope(I.rotate(page, angle)) + angle) <= 0.5
    assert (I.rotate(page, 0.0) == page).all()
    quad = np.array([[20, 10], [180, 30], [200, 150], [10, 120]], float)
    matrix = I.homography(np.array([[0, 0], [9, 0], [9, 9], [0, 9]], float), quad)
    for (x, y), want in zip([(0, 0), (9, 0), (9, 9), (0, 9)], quad, strict=True):
        u, v, w = matrix @ np.array([x, y, 1.0])
        assert np.allclose([u / w, v / w], want)
    dark = np.full((180, 240), 10, np.uint8)
    inside = I.warp(page, np.linalg.inv(I.homography(np.array([[0, 0], [219, 0], [219, 159], [0, 159]], float), quad)), 180, 240)
    mask = I.warp(np.full((160, 220), 255, np.uint8), np.eye(3), 180, 240) > 0
    flat = I.straighten(np.where(mask, inside, dark), quad)
    assert flat.ndim == 2 and abs(I.corner_angles(quad) - 90).max() > 10 and (I.straighten(page, np.array([[0, 0], [9, 0], [9, 9], [0, 9]], float)) is page)


def test_noise_goes_and_edges_stay():
    rng = np.random.default_rng(2)
    clean = np.full((40, 50), 60, np.uint8)
    clean[:, 25:] = 200
    noisy = np.clip(clean + rng.normal(0, 4, clean.shape), 0, 255).astype(np.uint8)
    out = I.denoise(noisy).astype(float)
    assert np.abs(out - clean).mean() < 0.5 * np.abs(noisy.astype(float) - clean).mean()
    assert out[:, 24].max() < 100 < 160 < out[:, 25].min()


def test_unique_names(spark):
    names = spark.createDataFrame([("Отчёт", ".TXT", i) for i in range(1200)], "stem string, suffix string, n int")
    taken = spark.createDataFrame([(f"otchet_{n}",) for n in ("002.txt", "900.pdf", "004.txt", "005.txt", "1000.txt", "7.txt", "0008.txt", "000.txt")], "name string")
    got = [r["name"] for r in T.unique_names(names, taken, "n").orderBy("n").collect()]
    free = [n for n in range(1, 1300) if n not in (2, 4, 5, 1000)][:1200]
    assert got == [f"otchet_{n:03d}.txt" for n in free]
    assert [r["name"] for r in T.unique_names(names.limit(2), taken.limit(0), "n").orderBy("n").collect()] == ["otchet_001.txt", "otchet_002.txt"]


def test_cases(spark):
    row = V.cases_of_columns(spark.createDataFrame([("in", "n", None)], "input string, simplified_name string, extended_unit string")).first()
    assert row["expected"]["simplified"]["name"] == "n" and row["expected"]["extended"]["unit"] == "шт." and row["expected"]["extended"]["denotation"] == ""


def test_retries(spark, tmp_path):
    def limited(prompts):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        raise RuntimeError("rate_limit_exceeded")

    assert M.ask(spark.createDataFrame([("p",)], "prompt string").coalesce(1), limited).first()["error"] == "rate_limit_exceeded"
    assert (tmp_path / "calls").read_text() == "x"


def test_results_with_tables(spark):
    from gridline.operators import layout as L

    rows = [
        (1, ["table"], [(0.0, 0.0, 100.0, 10.0, "a"), (300.0, 0.0, 400.0, 10.0, "b"), (0.0, 20.0, 90.0, 30.0, "c")], None),
        (2, ["text"], [(0.0, 0.0, 100.0, 10.0, "a")], None),
        (3, ["table"], [(5.0, 5.0, 95.0, 15.0, "x"), (5.0, 25.0, 95.0, 35.0, "y")], [(0.0, 0.0, 100.0, 100.0), (200.0, 0.0, 300.0, 100.0)]),
    ]
    box = "x1:double,y1:double,x2:double,y2:double"
    results = spark.createDataFrame(rows, f"doc int, labels array<string>, blocks array<struct<{box},text:string>>, cell_boxes array<struct<{box}>>")
    got = {(r["doc"], r["row_idx"], r["col_idx"]): r["text"] for r in L.tables_of_results(results, ["doc"]).collect()}
    assert got == {(1, 0, 0): "a", (1, 1, 0): "c", (1, 0, 1): "b", (1, 1, 1): "", (3, 0, 0): "x\ny", (3, 1, 0): ""}


def test_graph_files(spark, tmp_path):
    K.save(K.entities(spark), K.relations(spark), str(tmp_path))
    entities, relations = K.load(spark, str(tmp_path))
    assert entities.count() == 38 and K.add_relations(relations, K.relations(spark)).count() == 26


def test_end_to_end(spark, tmp_path):
    from gridline import pipeline
    from gridline.sources.office import workbook

    book = workbook({"S": [["Заявка", None, None], ["№", "Наименование", "Кол-во"], ["1", "Сверло ", "5"], [None, None, None], ["2", "Фреза;", "7"]]})
    files = spark.createDataFrame([("a/b.xlsx", bytearray(book)), ("c.txt", bytearray(b"one line")), ("d.zzz", bytearray(b"x"))], "path string, content binary")

    def model(prompts):
        return [json.dumps({"rows": [{"Наименование": line.split(": ")[1].strip()} for line in p.split("\n") if line.startswith("  Наименование: ")]}) for p in prompts]

    mapped, status = pipeline.process(files, model)
    assert [r["Наименование"] for r in mapped.where("path = 'a/b.xlsx'").orderBy("pos").collect()] == ["Сверло", "Фреза"]
    assert {r["path"]: r["status"] for r in status.collect()} == {"a/b.xlsx": "ok", "c.txt": "ok", "d.zzz": "unsupported"}
    records = {(r["path"], r["row_idx"]): [tuple(e) for e in r["rec"]] for r in pipeline.clean_tables(pipeline.read_files(files)).collect()}
    assert records["a/b.xlsx", 1] == [("№", "2"), ("Наименование", "Фреза "), ("Кол-во", "7")] and records["c.txt", 0] == [("Заголовок 1", "one line")]


def test_brands(spark):
    cells = spark.createDataFrame([(1, "резец Sandvlk, D`Andrea и ISCAR"), (2, None), (3, ""), (4, "no brand Here"), (5, "(Seco) xSeco 5Seco Seco5 Seco-5"), (6, "Walter")], "id int, text string")
    got = {r["id"]: r["text"] for r in O.canonical_brands(cells, ["id"]).collect()}
    assert got == {1: "резец Sandvik, D'Andrea и Iscar", 2: None, 3: "", 4: "no brand Here", 5: "( Seco ) xSeco 5Seco Seco5 Seco 5", 6: "Walter"}


def test_scored(spark):
    expected = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "x"}), (3, {"a": "x"})], "id int, expected map<string,string>")
    predicted = spark.createDataFrame([(1, {"a": "X "}, None), (2, {"a": "x"}, "broken")], "id int, predicted map<string,string>, error string")
    assert {r["id"]: r["accuracy"] for r in V.scored(predicted, expected, ["id"]).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_headers_are_resolved(spark):
    rows = [("a", 0, ["name", "qty"]), ("a", 1, ["x", "NA", "3"]), ("b", 0, ["1", ""]), ("c", 0, ["only"])]
    frame = spark.createDataFrame(rows, "doc string, row_idx int, cells array<string>")
    headed = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "doc string, is_header boolean")
    got = {(r["doc"], r["row_idx"]): [tuple(e) for e in r["rec"]] for r in T.resolved(frame, ["doc"], headed).collect()}
    assert got == {("a", 0): [("name", "x"), ("qty", None), ("Unnamed: 2", "3")], ("b", 0): [("Заголовок 1", "1"), ("Заголовок 2", None)]}


def test_numbers_are_no_header(spark):
    cells = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("a", "name", [1.0, 0.0]), ("b", "name", [1.0, 0.0]), ("b", "qty", [1.0, 0.0])], "doc string, text string, embedding array<double>")
    anchors = F.array(F.array(F.lit(1.0), F.lit(0.0)))
    got = {r["doc"]: r["is_header"] for r in T.semantic_header(cells, anchors, ["doc"]).collect()}
    assert got == {"a": False, "b": True}


def test_reasoned_prompts(spark):
    from gridline.functions import extract as E
    from gridline.operators import reasoned as R

    schema = json.loads(R.schema_text("extended"))
    assert list(schema["$defs"]["TableRowExtended"]["properties"]) == EXTENDED and schema["required"] == ["rows"]
    text = one(spark, R.system_prompt(F.lit("Цанга ER32 {keys}"), "simplified"))
    assert text.startswith("Режим работы: simplified. ") and "ER→ER(\\d+), цанга→Цанга" in text and "{" in R.schema_text("simplified") and "{knowledge}" not in text
    assert "РЕЛЕВАНТНЫЕ" not in one(spark, R.knowledge(F.lit("ничего")))
    texts = spark.createDataFrame([("Наименование: Фреза X12 | Производитель: Y | Кол.: 3",), ("",), (None,)], "text string")
    plain = texts.select(E.reasoning(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in E.with_reasoning(texts, "text", "s").select("s").collect()] == [r["s"] for r in plain]
    logs = spark.createDataFrame([(1, ("7", "Державка Sandvik A0123 ø 20 x 30", "5", None))], "id int, input struct<`Unnamed: 0`: string, `Товары работы услуги`: string, `Количество`: string, `Unnamed: 4`: string>")
    made = R.log_examples(logs, ["id"], ["Unnamed: 0", "Товары работы услуги", "Количество", "Unnamed: 4"]).collect()
    assert [r["mode"] for r in made] == ["simplified", "extended"] and "Запись 7:\n  Товары работы услуги: Державка" in made[0]["user"] and "  Unnamed: 4: \n" in made[0]["user"]
    row = json.loads(made[1]["assistant"])["rows"][0]
    assert (row["Обозначение"], row["Наименование"], row["Производитель"], row["Единица измерения"], row["Техническое задание"]) == ("A0123", "Державка Sandvik", "Державка", "шт.", "Размеры: ø20 x 30")


def test_descriptions_of_one_split_are_read_by_several_tasks(spark, tmp_path):
    from gridline.plans import extract_queries as Q

    part = spark.range(40).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert Q.reasoning(spark, str(tmp_path)).rdd.getNumPartitions() > 1
