"""Extraction of names, codes, makers and parameters from tool descriptions.

All are column expressions of one text. Patterns are parameters with the
Russian catalogue's values as defaults. The sentences that steps answer with
are fixed values like the lists below: models were trained on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridline.functions import text as X

# Fixed values. Field labels, tool types, codes, rules and parameter patterns.
GOODS = "Товары работы услуги:"
TOOL_TYPES = ["Державка", "Пластина", "Сверло", "Фреза", "Цанга", "Винт", "Патрон"]
CODES = [
    r"[A-Z]{2,}\d+[A-Z]*\d*[A-Z]*", r"[A-Z]\d+[A-Z]*\d*[A-Z]*", r"[A-Z]{2,}\d+", r"[A-Z]+\d+[A-Z]*\d*", r"HSK-[A-Z]\d+",
    r"BT\d+", r"ER\d+", r"CNMG\d{6}", r"A\d{6}", r"[A-Z]+\d+-\d+",
]
NUMBER_CODE = r"\d{9,12}"
GOODS_CODES = [*CODES, r"[A-Z]+\d+[A-Z]*\d*[A-Z]*", r"[A-Z]{1,3}\d+", NUMBER_CODE]
FREE_CODES = [*CODES, NUMBER_CODE]
LOG_CODES = [*CODES, r"[A-Z]+\d+[A-Z]*\d*[A-Z]*", r"[A-Z]{1,3}\d+"]
MAKER_STOP_WORDS = ["Цанговый", "Патрон", "мм"]
PARAMETERS = {
    "диаметр": r"ø\s*(\d+(?:,\d+)?)\s*мм",
    "Lобщ": r"Lобщ\.?\s*=\s*(\d+(?:,\d+)?)\s*мм",
    "Lраб": r"Lраб\s*=\s*(\d+(?:,\d+)?)\s*мм",
    "угол": r"(\d+)\s*°",
    "количество": r"Кол\.?\s*:\s*(\d+)",
    "HSK": r"HSK-([A-Z]\d+)",
    "BT": r"BT(\d+)",
    "ER": r"ER(\d+)",
    "CNMG": r"CNMG(\d{6})",
    "размер_хвостовика": r"(\d+)\s*мм",
}
SIZES = r"ø\s*(\d+(?:,\d+)?)\s*x\s*(\d+(?:,\d+)?)"
MAKER_RULES = [
    (("SDJCR", "CNMG"), "Sandvik"), (("YG", "DH", "DJ"), "YG-1"), (("KGM",), "KELITE"), (("DCMT",), "ZCC"),
    (("ER",), "EROGLU"), (("HSK", "BT"), "DAndrea"), (("A0", "A1"), "JieHe"),
]
TYPE_WORDS = {
    "Державка": ["державка", "holder", "HSK", "BT"],
    "Пластина": ["пластина", "insert", "CNMG", "DCMT"],
    "Сверло": ["сверло", "drill", "центровочное"],
    "Фреза": ["фреза", "mill", "концевая", "end mill"],
    "Цанга": ["цанга", "collet", "ER", "зажимная"],
    "Винт": ["винт", "screw", "болт"],
}
CONTEXT_WORDS = ["инструмент", "пластина", "державка", "сверло", "фреза"]
UNKNOWN = "Неизвестно"


def field(text: Column, label: str, end: str = "|") -> Column:
    """What follows the first label, up to the next label or end; null without the label."""
    part = F.get(F.split(text, "\\Q" + label + "\\E"), F.lit(1))
    return X.strip(F.get(F.split(part, "\\Q" + end + "\\E"), F.lit(0)))


def goods(text: Column) -> Column:
    """The goods line of a text, or the text."""
    return F.coalesce(field(text, GOODS, "\n"), text)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def found(text: Column, patterns: list[str], group: int = 0) -> Column:
    """All matches, pattern after pattern."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), group) for p in patterns])


def codes(text: Column, patterns: list[str] = CODES) -> Column:
    """Distinct codes in order of discovery, joined by spaces; empty if none."""
    return F.array_join(F.array_distinct(found(text, patterns)), " ")


def longest_code(text: Column, patterns: list[str] = FREE_CODES) -> Column:
    """The longest code, of several the first; null if none."""
    every = found(text, patterns)
    longest = F.array_max(F.transform(every, F.length))
    return F.get(F.filter(every, lambda c: F.length(c) == longest), F.lit(0))


def words_before_code(words: Column) -> Column:
    """Words up to the first code or number, joined."""
    stop = F.array_position(F.transform(words, lambda w: w.rlike(r"^[A-Z]+\d+") | w.rlike(r"^\p{Nd}+$")), F.lit(True))
    return F.array_join(F.when(stop > 0, F.slice(words, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(words), " ")


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def step(number: int, description: Column, confidence: Column, evidence: Column) -> Column:
    return F.struct(F.lit(number).alias("step_number"), description.alias("description"), confidence.cast("double").alias("confidence"), evidence.alias("evidence"))


def structure(text: Column) -> Column:
    """Step 1: words and kinds of characters."""
    words = F.size(split_words(text))
    yes = lambda p: F.when(text.rlike(p), "да").otherwise("нет")
    evidence = F.array(
        F.concat(F.lit("Строка содержит "), words.cast("string"), F.lit(" слов")),
        F.concat(F.lit("Есть числа: "), yes(r"\d")),
        F.concat(F.lit("Есть буквы: "), yes("[A-Za-z]")),
        F.concat(F.lit("Есть символы: "), yes(r"[^\p{L}\p{N}_\s]")),
    )
    return step(1, F.concat(F.lit("Анализирую структуру строки: '"), F.substring(text, 1, 50), F.lit("...'")), F.when(words > 2, 0.9).otherwise(0.6), evidence)


def tool_type(text: Column, types: list[str] = TOOL_TYPES) -> Column:
    """The first of the types whose name is inside the text, in any case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), t) for t in types])


def tool_name(text: Column, types: list[str] = TOOL_TYPES) -> Column:
    """Step 2: the tool's name from its field, or the words around a known type."""
    full, plain = "Наименование и обозначение:", "Наименование:"
    known = X.strip(F.get(F.split(text, "\\Q" + full + "\\E"), F.lit(1)))
    by_code = words_before_code(split_words(known))
    named = F.coalesce(field(text, plain), text)
    kind, words = tool_type(text, types), split_words(text)
    at = F.array_position(F.transform(words, lambda w: F.contains(F.lower(w), F.lower(kind))), F.lit(True)).cast("int")
    start = F.greatest(at - 2, F.lit(1))
    near = F.when(at > 0, F.array_join(F.slice(words, start, at + 2 - start + 1), " ")).otherwise(text)
    said = lambda name, kind: F.concat(F.lit("Найдено наименование: "), name, F.when(kind.isNotNull(), F.concat(F.lit(" (тип: "), kind, F.lit(")"))).otherwise(" (тип не определен)"))
    typed = tool_type(named, types)
    evidence = (
        F.when(F.contains(text, F.lit(full)), F.concat(F.lit("Найдено наименование: "), by_code))
        .when(F.contains(text, F.lit(plain)), said(named, typed))
        .when(kind.isNotNull(), said(near, kind))
        .otherwise("Наименование не определено явно")
    )
    confidence = (
        F.when(F.contains(text, F.lit(full)), 0.9)
        .when(F.contains(text, F.lit(plain)), F.when(typed.isNotNull(), 0.9).otherwise(0.7))
        .when(kind.isNotNull(), 0.8)
        .otherwise(0.3)
    )
    return step(2, F.lit("Определяю наименование инструмента"), confidence, F.array(evidence))


def denotation(text: Column) -> Column:
    """Step 3: all codes of a goods line, else the longest code of the text."""
    is_goods = F.contains(text, F.lit(GOODS))
    all_codes, longest = F.nullif(codes(goods(text), GOODS_CODES), F.lit("")), longest_code(text)
    value = F.when(is_goods, all_codes).otherwise(longest)
    missing = F.when(is_goods, "Обозначение не найдено в описании товара").otherwise("Обозначение не найдено")
    evidence = F.when(value.isNull(), missing).otherwise(F.concat(F.lit("Найдено обозначение: "), value))
    return step(3, F.lit("Извлекаю обозначение инструмента"), F.when(value.isNull(), 0.2).otherwise(0.9), F.array(evidence))


def maker(text: Column) -> Column:
    """Step 4: the maker from its field, or a capitalised word of a goods line."""
    own, firm, brand = field(text, "Производитель:"), F.regexp_extract(text, r"Фирма:\s*([A-Za-z0-9-]+)", 1), F.regexp_extract(text, r"Бренд:\s*([A-Za-z0-9]+)", 1)

    def possible(w: Column) -> Column:
        return w.rlike(r"^\p{Lu}") & (F.length(w) > 2) & ~w.rlike(r"^[A-Z]+\d+") & ~w.isin(*MAKER_STOP_WORDS)

    guess = F.get(F.filter(split_words(goods(text)), possible), F.lit(0))
    has = lambda label: F.contains(text, F.lit(label))
    said = lambda value, more="": F.concat(F.lit("Найден производитель: "), value, F.lit(more))
    evidence = (
        F.when(has("Производитель:"), F.when(own != "", said(own)).otherwise("Поле 'Производитель' пустое"))
        .when(has("Фирма:"), F.when(firm != "", said(firm, " (из поля Фирма)")).otherwise("Поле 'Фирма' не содержит производителя"))
        .when(has("Бренд:"), F.when(brand != "", said(brand, " (из поля Бренд)")).otherwise("Поле 'Бренд' не содержит производителя"))
        .when(has(GOODS) & guess.isNotNull(), F.concat(F.lit("Найден возможный производитель: "), guess, F.lit(" (в описании товара)")))
        .when(has(GOODS), "Производитель не найден в описании товара")
        .otherwise("Производитель не указан явно")
    )
    sure = lambda value: F.when(value != "", 0.95).otherwise(0.2)
    confidence = (
        F.when(has("Производитель:"), sure(own)).when(has("Фирма:"), sure(firm)).when(has("Бренд:"), sure(brand)).when(has(GOODS) & guess.isNotNull(), 0.7).otherwise(0.9)
    )
    return step(4, F.lit("Определяю производителя"), confidence, F.array(evidence))


def parameters(text: Column) -> Column:
    """Step 5: parameters with units, each with all its values."""
    area = goods(text)
    both = lambda n: F.get(F.regexp_extract_all(area, F.lit("(?iu)" + SIZES), n), F.lit(0))
    out = [F.concat(F.lit("Размеры: ø"), both(1), F.lit(" x "), both(2))]
    for name, pattern in PARAMETERS.items():
        values = F.regexp_extract_all(area, F.lit("(?iu)" + pattern), 1)
        joined = F.array_join(values, ", ")
        said = F.concat(F.lit("Диаметр: ø"), joined, F.lit(" мм")) if name == "диаметр" else F.concat(F.lit(f"{name}: "), joined)
        out.append(F.when(F.size(values) > 0, said))
    found_ = F.filter(F.array(*out), lambda e: e.isNotNull())
    none = F.when(area.rlike(r"\d"), "Найдены числа, но без явных единиц измерения (мм, °, и т.д.)").otherwise("Параметры не найдены")
    return step(5, F.lit("Извлекаю технические параметры с единицами измерения"), F.when(F.size(found_) > 0, 0.8).otherwise(0.4), F.when(F.size(found_) > 0, found_).otherwise(F.array(none)))


def technical_task(text: Column) -> Column:
    """Order code, diameter, bracketed words and delivery time."""
    one = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    parts = F.array(
        F.concat(F.lit("Код заказа: "), one(r"Код заказа:\s*(\d+)")),
        F.concat(F.lit("Диаметр: ø"), one(r"ø\s*(\d+(?:,\d+)?)\s*мм"), F.lit(" мм")),
        X.strip(one(r"\(([^)]+)\)")),
        F.concat(F.lit("Срок поставки: "), X.strip(one(r"Срок поставки:\s*([^К]+)"))),
    )
    kept = F.filter(parts, lambda p: p.isNotNull())
    return step(7, F.lit("Извлекаю техническое задание"), F.when(F.size(kept) > 0, 0.9).otherwise(0.3), F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("Техническое задание не найдено"))))


def checks(text: Column, steps: Column) -> Column:
    """The last step: presence of parts, agreement of name and code, mean confidence."""
    at = lambda n: F.get(steps, F.lit(n - 1))  # noqa: E731  steps 1 to 5 stand at their place
    says = lambda n, a, b: F.contains(F.lower(at(n)["evidence"][0]), F.lit(a)) & F.contains(F.lower(at(n)["evidence"][0]), F.lit(b))
    pieces = text.rlike(r"\d+\s*шт")
    amount, unit = has_any(text, ["Количество:", "Кол.:"]) | pieces, has_any(text, ["Единица:", "Единица измерения:"]) | pieces
    code, name, made = says(3, "обозначение", "найдено"), says(2, "наименование", "найдено"), says(4, "производитель", "найден")
    first = F.when(amount & ~unit, "✓ Количество найдено, единица измерения установлена как 'шт.' по умолчанию").when(amount, "✓ Количество и единица измерения найдены").otherwise("⚠ Количество не найдено")
    second = (
        F.when(code & name & amount & made, "✓ Извлечена вся основная информация (наименование, обозначение, производитель, количество, единица)")
        .when(code & name & amount, "✓ Извлечена основная информация (наименование, обозначение, количество, единица) - производитель не указан")
        .when(code & name, "✓ Извлечена основная информация (наименование, обозначение)")
        .otherwise("✗ Не вся основная информация извлечена")
    )
    third = F.when((at(2)["confidence"] > 0.7) & (at(3)["confidence"] > 0.7), "✓ Наименование и обозначение согласованы").otherwise("⚠ Низкая уверенность в наименовании или обозначении")
    mean = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size(steps)
    return step(7, F.lit("Валидирую результат разбора"), mean, F.array(first, second, third))


def first_steps(text: Column) -> Column:
    """The six steps that look at the text alone, numbered 1, 2, 3, 4, 5, 7."""
    return F.array(structure(text), tool_name(text), denotation(text), maker(text), parameters(text), technical_task(text))


def reasoning(text: Column) -> Column:
    """All seven steps, numbered 1, 2, 3, 4, 5, 7, 7."""
    # bound as a variable, so that the checks don't work the steps out again
    return F.get(F.transform(F.array(first_steps(text)), lambda s: F.concat(s, F.array(checks(text, s)))), F.lit(0))


def with_reasoning(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with all seven steps as column out. Faster than reasoning(): the steps are a projection of their own, in generated code."""
    held = df.withColumn("_steps", first_steps(F.col(text)))
    return held.withColumn(out, F.concat("_steps", F.array(checks(F.col(text), F.col("_steps"))))).drop("_steps")


def reasoning_text(steps: Column) -> Column:
    """A line `n. description (evidence, ...)` for each step."""
    line = lambda s: F.concat(s["step_number"].cast("string"), F.lit(". "), s["description"], F.when(F.size(s["evidence"]) > 0, F.concat(F.lit(" ("), F.array_join(s["evidence"], ", "), F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(steps, line), "\n")


def reasoning_summary(steps: Column) -> Column:
    """struct<steps, mean, high, low>: count, mean confidence, those over 0.7 and under 0.5."""
    return F.struct(
        F.size(steps).alias("steps"),
        (F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.greatest(F.size(steps), F.lit(1))).alias("mean"),
        F.size(F.filter(steps, lambda s: s["confidence"] > 0.7)).alias("high"),
        F.size(F.filter(steps, lambda s: s["confidence"] < 0.5)).alias("low"),
    )


def type_confidence(text: Column, kind: Column) -> Column:
    low = F.lower(text)
    bonus = F.when(low.startswith(F.lower(kind)), 0.3).otherwise(0.0) + F.when(F.length(kind) > 5, 0.1).otherwise(0.0) + F.when(has_any(low, CONTEXT_WORDS), 0.1).otherwise(0.0)
    return F.least(F.lit(0.5) + bonus, F.lit(1.0))


def maker_by_code(code: Column, rules: list[tuple[tuple[str, ...], str]] = MAKER_RULES, default: str = UNKNOWN) -> Column:
    """The maker of the first rule with a part inside the code."""
    up = F.upper(code)
    return F.coalesce(*[F.when(has_any(up, list(parts)), name) for parts, name in rules], F.lit(default))


def type_by_words(description: Column, words: dict[str, list[str]] = TYPE_WORDS, default: str = UNKNOWN) -> Column:
    """The first type with a keyword in the lower-cased text; capital keywords never match."""
    low = F.lower(description)
    return F.coalesce(*[F.when(has_any(low, keys), name) for name, keys in words.items()], F.lit(default))


def relevant_entities(text: Column, names: list[str], words: dict[str, list[str]] = TYPE_WORDS, most: int = 10) -> Column:
    """Names and, for each type, its first keyword that is inside the lower-cased text; ten at most."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(n.lower())), n) for n in names]
    hits += [F.coalesce(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(f"{w}→{kind}")) for w in keys]) for kind, keys in words.items()]
    return F.slice(F.filter(F.array(*hits), lambda h: h.isNotNull()), 1, most)


def catalogue_row(name: Column, maker_: Column, quantity: Column, unit: Column, code: Column) -> Column:
    """A catalogue row as an extended target row."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    code_found = codes(name, CODES)
    own = F.when(code_found != "", words_before_code(split_words(name))).otherwise(name)
    return F.struct(
        code_found.alias("Обозначение"),
        own.alias("Наименование"),
        blank(maker_).alias("Производитель"),
        F.coalesce(F.nullif(blank(unit), F.lit("")), F.lit("шт.")).alias("Единица измерения"),
        blank(quantity).alias("Количество"),
        F.when(blank(code) != "", F.concat(F.lit("Код: "), code)).otherwise("").alias("Техническое задание"),
    )


def narrative(row: Column, extended: bool) -> Column:
    """Numbered sentences about a target row; the short form omits code and maker."""
    filled = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & (c != "nan")
    say = lambda head, c, none: F.concat(F.lit(head), F.when(filled(c), c).otherwise(none))
    lines = [
        F.lit("1. Анализирую структуру входных данных. Вижу структурированную запись с несколькими полями, разделенными переносом строки."),
        F.concat(F.lit("2. Определяю наименование инструмента: "), F.coalesce(row["Наименование"], F.lit(""))),
    ]
    if extended:
        lines.append(say("3. Извлекаю обозначение инструмента: ", row["Обозначение"], "Обозначение не найдено"))
        lines.append(say("4. Определяю производителя: ", row["Производитель"], "Производитель не указан явно"))
    lines += [
        say("5. Извлекаю количество: ", row["Количество"], "Количество не найдено"),
        say("6. Извлекаю единицу измерения: ", row["Единица измерения"], "Единица измерения не найдена"),
        say("7. Извлекаю техническое задание: ", row["Техническое задание"], "Техническое задание не найдено"),
        F.lit("8. Валидирую результат разбора. Все необходимые поля заполнены корректно."),
    ]
    return F.concat_ws("\n", *lines)


def log_row(name: Column, quantity: Column, unit: Column) -> Column:
    """A row of a purchase log as an extended target row: codes, words before them, a capitalised word as maker."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    code_found = codes(name, LOG_CODES)
    own = F.when(code_found != "", words_before_code(split_words(name))).otherwise(name)
    maker_ = F.filter(split_words(own), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 2) & ~w.rlike(r"^[A-Z]+\d+") & ~w.isin(*MAKER_STOP_WORDS))
    one = lambda p, g=1: F.nullif(F.regexp_extract(name, p, g), F.lit(""))
    size = F.concat(F.lit("Размеры: ø"), one(SIZES), F.lit(" x "), one(SIZES, 2))
    across = F.concat(F.lit("Диаметр: ø"), one(PARAMETERS["диаметр"]), F.lit(" мм"))
    return F.struct(
        code_found.alias("Обозначение"),
        own.alias("Наименование"),
        blank(F.get(maker_, F.lit(0))).alias("Производитель"),
        F.when(F.trim(blank(unit)) == "", "шт.").otherwise(unit).alias("Единица измерения"),
        blank(quantity).alias("Количество"),
        F.coalesce(size, across, F.lit("")).alias("Техническое задание"),
    )
