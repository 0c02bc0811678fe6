"""Prompts with a knowledge base, and training examples with reasoning."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridline.functions import extract as E
from gridline.functions import text as X
from gridline.model import EXTENDED, SIMPLIFIED
from gridline.operators import training
from gridline.operators.mapping import map_records

MODES = {"simplified": SIMPLIFIED, "extended": EXTENDED}

# Fixed values. What the knowledge base says: makers of the catalogues, rules and parameter patterns.
CATALOGUE_MAKERS = ["DAndrea", "JieHe", "KELITE", "ZeTOOL"]
MAKER_LINES = ["SDJCR/CNMG → Sandvik", "YG/DH → YG-1", "KGM → KELITE", "DCMT → ZCC", "ER → EROGLU", "HSK/BT → DAndrea", "A0/A1 → JieHe"]
KNOWN_PATTERNS = {
    "Lобщ": r"Lобщ\.?\s*=\s*(\d+(?:,\d+)?)\s*мм",
    "Lраб": r"Lраб\s*=\s*(\d+(?:,\d+)?)\s*мм",
    "диаметр": r"Ø\s*(\d+(?:,\d+)?)\s*мм",
    "угол": r"(\d+)\s*°",
    "количество": r"Кол\.?\s*:\s*(\d+)",
    "HSK": r"HSK-([A-Z]\d+)",
    "BT": r"BT(\d+)",
    "ER": r"ER(\d+)",
    "CNMG": r"CNMG(\d{6})",
    "размер_хвостовика": r"(\d+)\s*мм",
}

# Fixed values. Wording that models were trained with.
ASK_SYSTEM = """Режим работы: {mode}. Ты — ассистент по структурированной обработке промышленных инструментов.

БАЗА ЗНАНИЙ:
{knowledge}

КРИТИЧЕСКИ ВАЖНО:
- Отвечай ТОЛЬКО JSON структурой
- НЕ ВКЛЮЧАЙ никаких рассуждений, объяснений или промежуточных шагов
- НЕ ПИШИ текст перед или после JSON
- НЕ ИСПОЛЬЗУЙ Markdown блоки ```json
- НЕ ДОБАВЛЯЙ комментарии или пояснения

Правила анализа:
1. Используй информацию из базы знаний для точного определения производителей и типов инструментов
2. Выдели обозначение, наименование, производителя и параметры
3. Применяй правила определения производителя по обозначению из базы знаний
4. Представь результат в JSON формате

Правила вывода:
- Используй ровно эти ключи: {keys}
- Структура ответа должна полностью соответствовать JSON Schema
- Не добавляй новых ключей или уровней вложенности
- Если данных нет для ключа — вставляй пустую строку
- Не используй Markdown, блоки ```json или пояснительный текст
- Вывод — только корректный JSON, без заголовков и комментариев
- НЕ ВКЛЮЧАЙ рассуждения, объяснения или промежуточные шаги в ответ
- Отвечай ТОЛЬКО JSON структурой

<output-format>
{schema}
</output-format>"""
ASK_USER = "Проанализируй данные:\n{input}"
TEACH_SYSTEM = """Ты — ассистент по структурированной обработке промышленных инструментов.

Правила анализа:
1. Сначала объясни шаги разбора (chain-of-thought)
2. Используй знания о производителях и типах инструментов
3. Выдели обозначение, наименование, производителя и параметры
4. Представь результат в JSON формате

Правила вывода:
- Используй ровно эти ключи: {keys}
- Структура ответа должна полностью соответствовать JSON Schema
- Не добавляй новых ключей или уровней вложенности
- Если данных нет для ключа — вставляй пустую строку
- Не используй Markdown, блоки ```json или пояснительный текст
- Вывод — только корректный JSON, без заголовков и комментариев

<output-format>
{schema}
</output-format>

Входные данные:"""
TEACH_USER = """Проанализируй данные:
{input}

Сначала объясни шаги разбора (chain-of-thought), затем выведи структурированный ответ в JSON.

Рассуждения:
{reasoning}

Структурированный ответ:"""
CONTEXT = {"makers": "ПРОИЗВОДИТЕЛИ: ", "types": "ТИПЫ ИНСТРУМЕНТОВ: ", "rules": "ПРАВИЛА ОПРЕДЕЛЕНИЯ ПРОИЗВОДИТЕЛЕЙ:\n", "found": "РЕЛЕВАНТНЫЕ СУЩНОСТИ В ТЕКСТЕ: "}
SHORT_PATTERN = 10


def schema_text(mode: str) -> str:
    """The JSON schema of a mode's answer as prompts show it."""
    name = f"TableRow{mode.capitalize()}"
    fields = {c: {"default": "", "description": f"Field for {c}", "title": c, "type": "string"} for c in MODES[mode]}
    row = {"additionalProperties": False, "properties": fields, "title": name, "type": "object"}
    rows = {"description": "List of table rows", "items": {"$ref": f"#/$defs/{name}"}, "title": "Rows", "type": "array"}
    whole = {"$defs": {name: row}, "additionalProperties": False, "properties": {"rows": rows}, "required": ["rows"], "title": "TableStructuredOutput", "type": "object"}
    return json.dumps(whole, ensure_ascii=False, indent=2)


def entities(text: Column, patterns: dict[str, str] = KNOWN_PATTERNS, words: dict[str, list[str]] = E.TYPE_WORDS, most: int = 10) -> Column:
    """`name→pattern` of each known parameter and `word→type` of each type named in the text, in any case; ten at most."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(name.lower())), f"{name}→{pattern}") for name, pattern in patterns.items()]
    hits += [F.coalesce(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(f"{w}→{kind}")) for w in keys]) for kind, keys in words.items()]
    return F.slice(F.filter(F.array(*hits), lambda h: h.isNotNull()), 1, most)


def knowledge(text: Column) -> Column:
    """What the knowledge base has to say about a text: makers, types, rules, and entities if there are any."""
    rules = [f"- {x}" for x in MAKER_LINES] + [f"- {name} → {pattern}" for name, pattern in KNOWN_PATTERNS.items() if len(name) <= SHORT_PATTERN]
    always = [CONTEXT["makers"] + ", ".join(sorted(CATALOGUE_MAKERS)), CONTEXT["types"] + ", ".join(sorted(E.TYPE_WORDS)), CONTEXT["rules"] + "\n".join(rules)]
    found = entities(text)
    return F.concat_ws("\n", F.lit("\n".join(always)), F.when(F.size(found) > 0, F.concat(F.lit(CONTEXT["found"]), F.array_join(found, ", "))))


def system_prompt(text: Column, mode: str) -> Column:
    return X.filled_template(ASK_SYSTEM, mode=F.lit(mode), knowledge=knowledge(text), keys=F.lit(", ".join(MODES[mode])), schema=F.lit(schema_text(mode)))


def user_prompt(text: Column) -> Column:
    return X.filled_template(ASK_USER, input=text)


def map_reasoned(records: DataFrame, keys: list[str], model: Callable[[list[str]], list[str | None]], extended: bool = True, size: int = 5) -> DataFrame:
    """map_records with the knowledge base in every prompt: system text, an empty line, user text.

    What a model repeats of the prompt before the word assistant is cut off.
    """
    mode = "extended" if extended else "simplified"
    wrap = lambda text: F.concat_ws("\n\n", system_prompt(text, mode), user_prompt(text))
    return map_records(records, keys, model, extended, size, wrap, X.after_assistant)


def record_text(row: Column, columns: list[str], number: Column | None = None) -> Column:
    """`Запись n:` and a line `  column: value` for each column; blank values leave the space."""
    lines = []
    for c in columns:
        value = row[c].cast("string")
        lines.append(F.concat(F.lit(f"  {c}: "), F.when(F.coalesce(X.strip(value), F.lit("")) != "", value).otherwise("")))
    head = F.concat(F.lit("Запись "), F.coalesce(number.cast("string"), F.lit("1")) if number is not None else F.lit("1"), F.lit(":"))
    return F.concat_ws("\n", head, *lines)


def target_row(row: Column, mode: str) -> Column:
    """A mode's answer from a target row: strings, null as empty, the unit `шт.` where it is."""
    value = lambda c: F.coalesce(row[c].cast("string"), F.lit(""))
    unit = "Единица измерения"
    return F.struct(*[(F.coalesce(F.nullif(value(c), F.lit("")), F.lit("шт.")) if c == unit else value(c)).alias(c) for c in MODES[mode]])


def simplified_of(row: Column) -> Column:
    """The simplified columns of an extended row."""
    return F.struct(*[row[c].alias(c) for c in SIMPLIFIED])


def examples(rows: DataFrame, keep: list[str], text: Column, answers: dict[str, Column], reasonings: dict[str, Column]) -> DataFrame:
    """keep, mode, system, user, assistant (JSON): two examples for each row, in the order of answers."""
    made = []
    for n, (mode, answer) in enumerate(answers.items()):
        system = TEACH_SYSTEM.replace("{keys}", ", ".join(MODES[mode])).replace("{schema}", schema_text(mode))
        user = X.filled_template(TEACH_USER, reasoning=reasonings[mode], input=text)
        made.append(F.struct(F.lit(n).alias("n"), F.lit(mode).alias("mode"), F.lit(system).alias("system"), user.alias("user"), F.to_json(F.struct(F.array(answer).alias("rows"))).alias("assistant")))
    return rows.select(*keep, F.explode(F.array(*made)).alias("_m")).select(*keep, "_m.mode", "_m.system", "_m.user", "_m.assistant")


def sheet_examples(rows: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Examples of aligned sheets: structs input (columns), simplified and extended."""
    answers = {mode: target_row(F.col(mode), mode) for mode in MODES}
    said = {mode: E.narrative(F.col(mode), mode == "extended") for mode in MODES}
    return examples(rows, keep, record_text(F.col("input"), columns), answers, said)


def catalogue_examples(rows: DataFrame, keep: list[str], columns: list[str], name: str = "Наименование", maker: str = "Производитель", quantity: str = "Количество", unit: str = "Единица измерения", code: str = "Код детали") -> DataFrame:
    """Examples of catalogue rows: struct input with columns; the target is read out of the name."""
    value = lambda c: F.col("input")[c].cast("string") if c in columns else F.lit(None).cast("string")
    whole = E.catalogue_row(value(name), value(maker), value(quantity), value(unit), value(code))
    targeted = rows.withColumn("_target", whole)
    answers = {"simplified": simplified_of(F.col("_target")), "extended": F.col("_target")}
    said = {mode: E.narrative(F.col("_target"), mode == "extended") for mode in MODES}
    return examples(targeted, keep, record_text(F.col("input"), columns), answers, said)


def log_examples(rows: DataFrame, keep: list[str], columns: list[str], name: str = "Товары работы услуги", quantity: str = "Количество", unit: str = "Unnamed: 4", number: str = "Unnamed: 0") -> DataFrame:
    """Examples of purchase logs: the record bears its own number, and the reasoning is that of the rules on its text."""
    value = lambda c: F.col("input")[c].cast("string") if c in columns else F.lit(None).cast("string")
    text = record_text(F.col("input"), [c for c in columns if c != number], value(number))
    read = rows.withColumn("_text", text).withColumn("_target", E.log_row(F.coalesce(value(name), F.lit("")), value(quantity), value(unit)))
    read = E.with_reasoning(read, "_text", "_steps7").withColumn("_said", E.reasoning_text(F.col("_steps7")))
    answers = {"simplified": simplified_of(F.col("_target")), "extended": F.col("_target")}
    return examples(read, keep, F.col("_text"), answers, dict.fromkeys(MODES, F.col("_said")))


def dataset(sheets: DataFrame, sheet_columns: list[str], catalogue: DataFrame, catalogue_columns: list[str], most: int = 50, seed: str = "examples") -> DataFrame:
    """file, row_idx, mode, system, user, assistant: examples of all files within one quota of rows.

    sheets(file, row_idx, input, simplified, extended) and catalogue(file,
    row_idx, input). The quota is dealt over all files of both kinds, and each
    file gives so many rows in a seeded order.
    """
    both = sheets.select("file", "row_idx").unionByName(catalogue.select("file", "row_idx"))
    quota = training.quotas(both.groupBy("file").agg(F.count(F.lit(1)).alias("capacity")), most)
    drawn = lambda df: training.sample_by_quota(df, quota.select("file", "quota"), "file", "row_idx", seed)
    keep = ["file", "row_idx"]
    return sheet_examples(drawn(sheets), keep, sheet_columns).unionByName(catalogue_examples(drawn(catalogue), keep, catalogue_columns))


def mode_counts(made: DataFrame) -> DataFrame:
    """mode, examples."""
    return made.groupBy("mode").agg(F.count(F.lit(1)).alias("examples"))
