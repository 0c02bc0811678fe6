"""Queries on prompts with a knowledge base, and on training examples with reasoning."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions import extract as E
from gridline.operators import reasoned as R
from gridline.operators import tables as T
from gridline.plans.register import register, table
from gridline.plans.text_queries import _DESCRIBED, _described


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_HITS = ", ".join(
    [f"CASE WHEN contains(lower(text), {_quoted(name.lower())}) THEN {_quoted(f'{name}→{pattern}')} END" for name, pattern in R.KNOWN_PATTERNS.items()]
    + ["CASE " + " ".join(f"WHEN contains(lower(text), {_quoted(w.lower())}) THEN {_quoted(f'{w}→{kind}')}" for w in words) + " END" for kind, words in E.TYPE_WORDS.items()]
)
_ALWAYS = "ПРОИЗВОДИТЕЛИ: DAndrea, JieHe, KELITE, ZeTOOL\nТИПЫ ИНСТРУМЕНТОВ: Винт, Державка, Пластина, Сверло, Фреза, Цанга\nПРАВИЛА ОПРЕДЕЛЕНИЯ ПРОИЗВОДИТЕЛЕЙ:\n- SDJCR/CNMG → Sandvik"


@register(
    "knowledge_context",
    f"""WITH {_DESCRIBED}, h AS (SELECT p_partkey, list_filter([{_HITS}], lambda x: x IS NOT NULL)[1:10] AS found FROM d)
    SELECT p_partkey, {_quoted(_ALWAYS)} AS head, CAST(11 + {sum(len(n) <= 10 for n in R.KNOWN_PATTERNS)} - 1 + CASE WHEN len(found) > 0 THEN 1 ELSE 0 END AS INTEGER) AS lines,
      CASE WHEN len(found) > 0 THEN 'РЕЛЕВАНТНЫЕ СУЩНОСТИ В ТЕКСТЕ: ' || array_to_string(found, ', ') ELSE '- CNMG → CNMG(\\d{{6}})' END AS last_line FROM h""",
)
def knowledge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge base's words on every part: how they begin, how many lines they have, and the last one."""
    lines = F.split("k", "\n")
    said = _described(spark, sf_dir).select("p_partkey", R.knowledge(F.col("text")).alias("k"))
    return said.select("p_partkey", F.substring("k", 1, len(_ALWAYS)).alias("head"), F.size(lines).alias("lines"), F.element_at(lines, -1).alias("last_line"))


def _reasoner(prompts: list[str]) -> list[str]:
    """A stand-in for a model that repeats its prompt: a row for each record of the user's text, with the mode it was told."""
    out = []
    for p in prompts:
        said = p.rpartition("Проанализируй данные:\n")[2]
        rows = [{"Наименование": line.strip(), "Обозначение": p.partition(".")[0]} for line in said.split("\n") if line.startswith("  role")]
        out.append("system and user, then Assistant\n" + json.dumps({"rows": rows}, ensure_ascii=False))
    return out


@register(
    "reasoned_records",
    "SELECT conv_id, CAST(turn // 5 AS INTEGER) AS chunk_idx, CAST(turn % 5 AS INTEGER) AS pos, 'role: ' || role AS name, 'Режим работы: extended' AS code FROM conversations",
)
def reasoned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("row_idx"), F.array("role").alias("cells"))
    mapped = R.map_reasoned(T.records(turns, ["conv_id"], F.array(F.lit("role"))), ["conv_id"], _reasoner)
    return mapped.select("conv_id", "chunk_idx", "pos", F.col("Наименование").alias("name"), F.col("Обозначение").alias("code"))


_NARRATIVE = """'1. Анализирую структуру входных данных. Вижу структурированную запись с несколькими полями, разделенными переносом строки.' || chr(10) || '2. Определяю наименование инструмента: ' || name || chr(10)
  || CASE WHEN mode = 'extended' THEN '3. Извлекаю обозначение инструмента: ' || CASE WHEN trim(code) <> '' THEN code ELSE 'Обозначение не найдено' END || chr(10)
       || '4. Определяю производителя: ' || CASE WHEN trim(maker) <> '' THEN maker ELSE 'Производитель не указан явно' END || chr(10) ELSE '' END
  || '5. Извлекаю количество: ' || quantity || chr(10) || '6. Извлекаю единицу измерения: ' || CASE WHEN unit <> '' THEN unit ELSE 'Единица измерения не найдена' END || chr(10)
  || '7. Извлекаю техническое задание: Техническое задание не найдено' || chr(10) || '8. Валидирую результат разбора. Все необходимые поля заполнены корректно.'"""


@register(
    "reasoned_examples",
    f"""WITH p AS (
      SELECT 'sheet ' || p_partkey % 3 AS file, p_partkey AS row_idx, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END AS code, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS maker,
        CAST(p_size AS VARCHAR) AS quantity, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'компл.' END AS unit FROM part
    ), m AS (
      SELECT p.*, mode FROM p, (VALUES ('simplified'), ('extended')) v(mode)
      WHERE row_idx IN (SELECT row_idx FROM p QUALIFY row_number() OVER (PARTITION BY file ORDER BY md5('examples' || row_idx), row_idx) <= CASE file WHEN 'sheet 2' THEN 16 ELSE 17 END)
    )
    SELECT file, row_idx, mode, 'Проанализируй данные:' || chr(10) || 'Запись 1:' || chr(10) || '  name: ' || name || chr(10) || '  code: ' || CASE WHEN trim(code) = '' THEN '' ELSE code END || chr(10) || chr(10)
        || 'Сначала объясни шаги разбора (chain-of-thought), затем выведи структурированный ответ в JSON.' || chr(10) || chr(10) || 'Рассуждения:' || chr(10) || {_NARRATIVE} || chr(10) || chr(10) || 'Структурированный ответ:' AS user,
      '{{"rows":[{{' || CASE WHEN mode = 'extended' THEN '"Обозначение":"' || code || '",' ELSE '' END || '"Наименование":"' || name || '",' || CASE WHEN mode = 'extended' THEN '"Производитель":"' || maker || '",' ELSE '' END
        || '"Единица измерения":"' || CASE WHEN unit = '' THEN 'шт.' ELSE unit END || '","Количество":"' || quantity || '","Техническое задание":""}}]}}' AS assistant FROM m""",
)
def reasoned_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two examples for each of 50 rows of three sheets: a sampling operator's own limit."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    code, maker, unit = F.when(key % 5 == 0, " ").otherwise(F.col("p_brand")), F.when(key % 4 == 0, "").otherwise(F.col("p_type")), F.when(key % 2 == 0, "").otherwise("компл.")
    named = {"Обозначение": code, "Наименование": F.col("p_name"), "Производитель": maker, "Единица измерения": unit, "Количество": F.col("p_size").cast("string"), "Техническое задание": F.lit(None).cast("string")}
    row = lambda mode: F.struct(*[named[c].alias(c) for c in R.MODES[mode]]).alias(mode)
    sheets = p.select(F.concat(F.lit("sheet "), (key % 3).cast("string")).alias("file"), key.alias("row_idx"), F.struct(F.col("p_name").alias("name"), code.alias("code")).alias("input"), row("simplified"), row("extended"))
    none = sheets.select("file", "row_idx", "input").limit(0)
    return R.dataset(sheets, ["name", "code"], none, ["name", "code"]).select("file", "row_idx", "mode", "user", "assistant")


@register(
    "catalogue_examples",
    f"""WITH {_DESCRIBED}, m AS (SELECT p_partkey, p_brand, text, mode FROM d, (VALUES ('simplified'), ('extended')) v(mode))
    SELECT p_partkey, mode, 'Запись 1:' || chr(10) || '  Наименование: ' || text || chr(10) || '  Производитель: ' || p_brand || chr(10) || '  Код детали: ' || p_partkey AS input,
      'Код: ' || p_partkey AS spec, CASE WHEN mode = 'extended' THEN p_brand END AS maker FROM m""",
)
def catalogue_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _described(spark, sf_dir).select("p_partkey", F.struct(F.col("text").alias("Наименование"), F.col("p_brand").alias("Производитель"), F.col("p_partkey").cast("string").alias("Код детали")).alias("input"))
    made = R.catalogue_examples(rows, ["p_partkey"], ["Наименование", "Производитель", "Код детали"])
    answer = F.from_json("assistant", "rows array<struct<`Производитель`: string, `Техническое задание`: string>>")["rows"][0]
    text = F.regexp_extract("user", r"(?s)^[^\n]*\n(.*?)\n\nСначала", 1)
    return made.select("p_partkey", "mode", text.alias("input"), answer["Техническое задание"].alias("spec"), answer["Производитель"].alias("maker"))
