"""Queries on tool descriptions of many forms; the SQL works each of them out from the text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions import extract as E
from gridline.plans.register import register, table
from gridline.session import spread

#: Descriptions, dealt to the parts; names in braces are columns of a part.
FORMS = [
    "Наименование и обозначение: Сверло {name} {code} 5 шт",
    "Наименование: Фреза {name} | Производитель: {brand} | Количество: 5",
    "Цанга ER{size} ø 40 мм Фирма: {type}",
    "Товары работы услуги: Патрон Sandvik {code} HSK-A63 Ø 12,5 x 30 \nКол.: 7",
    "{name} LОБЩ = 80 мм (с покрытием) Код заказа: {key} Срок поставки: 5 дней К оплате",
    "Бренд: {upper} угол 90°",
    "Товары работы услуги: просто {name} мм \nКол.: 7",
    "Наименование: {name} | Производитель:  | Количество: {size}",
    "Фирма: !!! Винт {size} мм",
    "Бренд: -- пластина {code} (  {type} ) Код заказа: ?",
    "державка {code} CNMG120408 Lобщ.= {size},5 мм Lраб = 20 мм ø {size} x 7 ø 12,5 мм",
    "Наименование: {type} {code} Винт | Единица: {size} шт",
    "",
    "Товары работы услуги: Цанговый Патрон Kennametal-{size} 123456789012 BT40 45°",
    "Наименование и обозначение: 12 {name} | Производитель: {brand}",
    "один два три ФРЕЗА четыре {code}  пять шесть",
    "Производитель: {type}",
]
_FIELDS = {
    "name": ("p_name", "p_name"),
    "brand": ("p_brand", "p_brand"),
    "type": ("p_type", "p_type"),
    "size": ("CAST(p_size AS STRING)", "CAST(p_size AS VARCHAR)"),
    "key": ("CAST(p_partkey AS STRING)", "CAST(p_partkey AS VARCHAR)"),
    "upper": ("upper(p_name)", "upper(p_name)"),
    "code": ("concat(upper(substring(p_name, 1, 3)), lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'))", "(upper(p_name[1:3]) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'))"),
}


def _parts(form: str) -> list[str]:
    return [p for p in re.split(r"(\{\w+\})", form) if p]


def _quoted(text: str) -> str:
    return "('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _column(form: str) -> Column:
    return F.concat(F.lit(""), *[F.expr(_FIELDS[p[1:-1]][0]) if p[0] == "{" else F.lit(p) for p in _parts(form)])


def _sql(form: str) -> str:
    return " || ".join(["''", *[_FIELDS[p[1:-1]][1] if p[0] == "{" else _quoted(p) for p in _parts(form)]])


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % len(FORMS)
    text = reduce(lambda c, i: c.when(kind == i, _column(FORMS[i])), range(1, len(FORMS)), F.when(kind == 0, _column(FORMS[0])))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_brand", F.expr(_FIELDS["size"][0]).alias("size"), F.expr(_FIELDS["code"][0]).alias("code"), text.alias("text"))


def _all(text: str, patterns: list[str]) -> str:
    return " || ".join(f"regexp_extract_all({text}, '{p}')" for p in patterns)


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _type(text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{t.lower()}') THEN '{t}'" for t in E.TOOL_TYPES) + " END"


def _before_code(words: str) -> str:
    at = f"list_min(list_filter(range(1, len({words}) + 1), lambda i: regexp_matches({words}[i], '^[A-Z]+\\d+') OR regexp_full_match({words}[i], '\\d+')))"
    return f"array_to_string(CASE WHEN {at} IS NULL THEN {words} ELSE {words}[1:{at} - 1] END, ' ')"


def _distinct(values: str) -> str:
    """The values joined, each at its first place."""
    return f"array_to_string(list_filter({values}, lambda x, i: list_position({values}, x) = i), ' ')"


_STOP = ", ".join(f"'{w}'" for w in E.MAKER_STOP_WORDS)
_POSSIBLE = f"lambda w: regexp_matches(w, '^\\p{{Lu}}') AND length(w) > 2 AND NOT regexp_matches(w, '^[A-Z]+\\d+') AND w NOT IN ({_STOP})"
_SIZE = "(?i)" + E.SIZES
_VALUES = ", ".join(
    f"CASE WHEN len(regexp_extract_all(area, '(?i){p}', 1)) > 0 THEN "
    + (f"'Диаметр: ø' || array_to_string(regexp_extract_all(area, '(?i){p}', 1), ', ') || ' мм'" if n == "диаметр" else f"'{n}: ' || array_to_string(regexp_extract_all(area, '(?i){p}', 1), ', ')")
    + " END"
    for n, p in E.PARAMETERS.items()
)
_VARIED = f"""
v AS (SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) AS size, {_FIELDS["code"][1]} AS code, CASE p_partkey % {len(FORMS)} {" ".join(f"WHEN {i} THEN {_sql(f)}" for i, f in enumerate(FORMS))} END AS text FROM part),
a AS (
  SELECT *, {_words("text")} AS words, CASE WHEN contains(text, '{E.GOODS}') THEN {_strip(f"string_split(string_split(text, '{E.GOODS}')[2], chr(10))[1]")} ELSE text END AS area,
    {_strip("string_split(text, 'Наименование и обозначение:')[2]")} AS known, coalesce({_strip("string_split(string_split(text, 'Наименование:')[2], '|')[1]")}, text) AS named,
    {_strip("string_split(string_split(text, 'Производитель:')[2], '|')[1]")} AS own, regexp_extract(text, 'Фирма:\\s*([A-Za-z0-9-]+)', 1) AS firm, regexp_extract(text, 'Бренд:\\s*([A-Za-z0-9]+)', 1) AS brand
  FROM v
),
b AS (
  SELECT *, {_words("known")} AS known_words, {_type("named")} AS typed, {_type("text")} AS kind, list_filter({_words("area")}, {_POSSIBLE})[1] AS guess, contains(text, '{E.GOODS}') AS is_goods,
    {_all("area", E.GOODS_CODES)} AS goods_codes, {_all("text", E.FREE_CODES)} AS free_codes, regexp_extract_all(area, '{_SIZE}', 1)[1] AS s1, regexp_extract_all(area, '{_SIZE}', 2)[1] AS s2
  FROM a
),
c AS (
  SELECT *, list_min(list_filter(range(1, len(words) + 1), lambda i: contains(lower(words[i]), lower(kind)))) AS place,
    CASE WHEN is_goods THEN nullif({_distinct("goods_codes")}, '') ELSE list_filter(free_codes, lambda x: length(x) = list_max(list_transform(free_codes, lambda y: length(y))))[1] END AS code_found,
    list_filter(['Размеры: ø' || s1 || ' x ' || s2, {_VALUES}], lambda x: x IS NOT NULL) AS params,
    list_filter(['Код заказа: ' || nullif(regexp_extract(text, 'Код заказа:\\s*(\\d+)', 1), ''), 'Диаметр: ø' || nullif(regexp_extract(text, 'ø\\s*(\\d+(?:,\\d+)?)\\s*мм', 1), '') || ' мм',
      {_strip("nullif(regexp_extract(text, '\\(([^)]+)\\)', 1), '')")}, 'Срок поставки: ' || {_strip("nullif(regexp_extract(text, 'Срок поставки:\\s*([^К]+)', 1), '')")}], lambda x: x IS NOT NULL) AS task
  FROM b
),
s AS (
  SELECT *, CASE WHEN len(words) > 2 THEN 0.9 ELSE 0.6 END AS c1,
    CASE WHEN contains(text, 'Наименование и обозначение:') THEN 'Найдено наименование: ' || {_before_code("known_words")}
      WHEN contains(text, 'Наименование:') THEN 'Найдено наименование: ' || named || CASE WHEN typed IS NULL THEN ' (тип не определен)' ELSE ' (тип: ' || typed || ')' END
      WHEN kind IS NOT NULL THEN 'Найдено наименование: ' || CASE WHEN place IS NULL THEN text ELSE array_to_string(words[greatest(place - 2, 1):place + 2], ' ') END || ' (тип: ' || kind || ')'
      ELSE 'Наименование не определено явно' END AS e2,
    CASE WHEN contains(text, 'Наименование и обозначение:') THEN 0.9 WHEN contains(text, 'Наименование:') THEN CASE WHEN typed IS NULL THEN 0.7 ELSE 0.9 END WHEN kind IS NOT NULL THEN 0.8 ELSE 0.3 END AS c2,
    CASE WHEN code_found IS NOT NULL THEN 'Найдено обозначение: ' || code_found WHEN is_goods THEN 'Обозначение не найдено в описании товара' ELSE 'Обозначение не найдено' END AS e3,
    CASE WHEN code_found IS NULL THEN 0.2 ELSE 0.9 END AS c3,
    CASE WHEN contains(text, 'Производитель:') THEN CASE WHEN own <> '' THEN 'Найден производитель: ' || own ELSE 'Поле ''Производитель'' пустое' END
      WHEN contains(text, 'Фирма:') THEN CASE WHEN firm <> '' THEN 'Найден производитель: ' || firm || ' (из поля Фирма)' ELSE 'Поле ''Фирма'' не содержит производителя' END
      WHEN contains(text, 'Бренд:') THEN CASE WHEN brand <> '' THEN 'Найден производитель: ' || brand || ' (из поля Бренд)' ELSE 'Поле ''Бренд'' не содержит производителя' END
      WHEN is_goods AND guess IS NOT NULL THEN 'Найден возможный производитель: ' || guess || ' (в описании товара)' WHEN is_goods THEN 'Производитель не найден в описании товара'
      ELSE 'Производитель не указан явно' END AS e4,
    CASE WHEN contains(text, 'Производитель:') THEN CASE WHEN own <> '' THEN 0.95 ELSE 0.2 END WHEN contains(text, 'Фирма:') THEN CASE WHEN firm <> '' THEN 0.95 ELSE 0.2 END
      WHEN contains(text, 'Бренд:') THEN CASE WHEN brand <> '' THEN 0.95 ELSE 0.2 END WHEN is_goods AND guess IS NOT NULL THEN 0.7 ELSE 0.9 END AS c4,
    CASE WHEN len(params) > 0 THEN array_to_string(params, '|') WHEN regexp_matches(area, '\\d') THEN 'Найдены числа, но без явных единиц измерения (мм, °, и т.д.)' ELSE 'Параметры не найдены' END AS e5,
    CASE WHEN len(params) > 0 THEN 0.8 ELSE 0.4 END AS c5,
    CASE WHEN len(task) > 0 THEN array_to_string(task, '|') ELSE 'Техническое задание не найдено' END AS e6, CASE WHEN len(task) > 0 THEN 0.9 ELSE 0.3 END AS c6
  FROM c
)"""


@register("tool_name", f"WITH {_VARIED} SELECT p_partkey, e2 AS evidence, CAST(c2 AS DOUBLE) AS confidence FROM s")
def tool_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _varied(spark, sf_dir).withColumn("s", E.tool_name(F.col("text")))
    return found.select("p_partkey", F.col("s.evidence")[0].alias("evidence"), F.col("s.confidence").alias("confidence"))


@register("code_found", f"WITH {_VARIED} SELECT p_partkey, e3 AS evidence, CAST(c3 AS DOUBLE) AS confidence FROM s")
def code_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _varied(spark, sf_dir).withColumn("s", E.denotation(F.col("text")))
    return found.select("p_partkey", F.col("s.evidence")[0].alias("evidence"), F.col("s.confidence").alias("confidence"))


@register("maker_found", f"WITH {_VARIED} SELECT p_partkey, e4 AS evidence, CAST(c4 AS DOUBLE) AS confidence FROM s")
def maker_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _varied(spark, sf_dir).withColumn("s", E.maker(F.col("text")))
    return found.select("p_partkey", F.col("s.evidence")[0].alias("evidence"), F.col("s.confidence").alias("confidence"))


@register("regex_params", f"WITH {_VARIED} SELECT p_partkey, e5 AS evidence FROM s")
def regex_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("p_partkey", F.array_join(E.parameters(F.col("text"))["evidence"], "|").alias("evidence"))


@register("tech_task", f"WITH {_VARIED} SELECT p_partkey, e6 AS evidence FROM s")
def tech_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("p_partkey", F.array_join(E.technical_task(F.col("text"))["evidence"], "|").alias("evidence"))


@register(
    "reasoning",
    f"""WITH {_VARIED}, k AS (SELECT *, contains(text, 'Количество:') OR contains(text, 'Кол.:') OR regexp_matches(text, '\\d+\\s*шт') AS amount, contains(text, 'Единица:') OR contains(text, 'Единица измерения:') OR regexp_matches(text, '\\d+\\s*шт') AS unit,
      contains(lower(e3), 'обозначение') AND contains(lower(e3), 'найдено') AS code_said, contains(lower(e2), 'наименование') AND contains(lower(e2), 'найдено') AS name_said, contains(lower(e4), 'производитель') AND contains(lower(e4), 'найден') AS maker_said FROM s)
    SELECT p_partkey, 7 AS steps, CAST(round((c1 + c2 + c3 + c4 + c5 + c6) / 6, 6) AS DOUBLE) AS confidence,
      CASE WHEN amount AND NOT unit THEN '✓ Количество найдено, единица измерения установлена как ''шт.'' по умолчанию' WHEN amount THEN '✓ Количество и единица измерения найдены' ELSE '⚠ Количество не найдено' END || '|'
      || CASE WHEN code_said AND name_said AND amount AND maker_said THEN '✓ Извлечена вся основная информация (наименование, обозначение, производитель, количество, единица)'
           WHEN code_said AND name_said AND amount THEN '✓ Извлечена основная информация (наименование, обозначение, количество, единица) - производитель не указан'
           WHEN code_said AND name_said THEN '✓ Извлечена основная информация (наименование, обозначение)' ELSE '✗ Не вся основная информация извлечена' END || '|'
      || CASE WHEN c2 > 0.7 AND c3 > 0.7 THEN '✓ Наименование и обозначение согласованы' ELSE '⚠ Низкая уверенность в наименовании или обозначении' END AS checks FROM k""",
)
def reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of every description: how many, the mean confidence, and what the last one says."""
    found = E.with_reasoning(_varied(spark, sf_dir), "text", "s")
    last = F.element_at("s", -1)
    return found.select("p_partkey", F.size("s").alias("steps"), F.round(last["confidence"], 6).alias("confidence"), F.array_join(last["evidence"], "|").alias("checks"))


@register(
    "catalogue_rows",
    f"""WITH {_VARIED}, r AS (SELECT *, {_all("text", E.CODES)} AS l FROM a), q AS (SELECT *, {_distinct("l")} AS codes FROM r)
    SELECT p_partkey, codes, CASE WHEN codes <> '' THEN {_before_code("words")} ELSE text END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'шт.' ELSE 'компл.' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Код: ' || code END AS spec FROM q""",
)
def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    row = E.catalogue_row(F.col("text"), F.col("p_brand"), F.col("size"), F.when(key % 2 == 1, "компл.").otherwise(""), F.when(key % 3 != 0, F.col("code")))
    r = _varied(spark, sf_dir).select("p_partkey", row.alias("r"))
    return r.select("p_partkey", F.col("r")["Обозначение"].alias("codes"), F.col("r")["Наименование"].alias("name"), F.col("r")["Единица измерения"].alias("unit"), F.col("r")["Техническое задание"].alias("spec"))


@register(
    "log_rows",
    f"""WITH {_VARIED}, r AS (SELECT *, {_all("text", E.LOG_CODES)} AS l FROM a), q AS (SELECT *, {_distinct("l")} AS codes FROM r), n AS (SELECT *, CASE WHEN codes <> '' THEN {_before_code("words")} ELSE text END AS name FROM q)
    SELECT p_partkey, codes, name, coalesce(list_filter({_words("name")}, {_POSSIBLE})[1], '') AS maker, CASE WHEN p_partkey % 2 = 0 THEN 'шт.' ELSE size END AS unit,
      coalesce('Размеры: ø' || nullif(regexp_extract(text, '{E.SIZES}', 1), '') || ' x ' || nullif(regexp_extract(text, '{E.SIZES}', 2), ''), 'Диаметр: ø' || nullif(regexp_extract(text, '{E.PARAMETERS["диаметр"]}', 1), '') || ' мм', '') AS spec FROM n""",
)
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = E.log_row(F.col("text"), F.col("size"), F.when(F.col("p_partkey") % 2 == 1, F.col("size")).otherwise("  "))
    r = _varied(spark, sf_dir).select("p_partkey", row.alias("r"))
    return r.select("p_partkey", F.col("r")["Обозначение"].alias("codes"), F.col("r")["Наименование"].alias("name"), F.col("r")["Производитель"].alias("maker"), F.col("r")["Единица измерения"].alias("unit"), F.col("r")["Техническое задание"].alias("spec"))
