"""Text functions as column expressions. Null stays null unless said otherwise.

Patterns that must treat letters of all scripts alike carry (?U) or \\p classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridline.model import BRANDS, FIELD_NAMES, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN, TECHNICAL_PATTERNS, TRANSLITERATION


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expression replacements, one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, ё as е, single spaces."""
    return one_space(F.translate(F.lower(text), "ё", "е"))


def pdf_cell(text: Column) -> Column:
    """Only letters, digits, underscores and single spaces; null becomes empty."""
    return one_space(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s]", ""))


def field_name(name: Column) -> Column:
    """A known field's English name, else lower case without punctuation, joined by underscores."""
    known = F.create_map(*[F.lit(x) for kv in FIELD_NAMES.items() for x in kv])
    other = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", "_")
    return F.coalesce(F.try_element_at(known, name), other)


def transliterate(text: Column) -> Column:
    """Russian letters in Latin spelling; letters of one Latin letter at once."""
    pairs = [*TRANSLITERATION.items(), *((r.upper(), x.capitalize()) for r, x in TRANSLITERATION.items())]
    single = [(r, x) for r, x in pairs if len(x) == 1]
    dropped = [r for r, x in pairs if not x]
    text = F.translate(text, "".join(r for r, _ in single) + "".join(dropped), "".join(x for _, x in single))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [(r, x) for r, x in pairs if len(x) > 1], text)


def safe_stem(stem: Column) -> Column:
    """A file name's stem in a-z, 0-9, dot, underscore and hyphen; `file` if nothing is left."""
    clean = replace_all(F.trim(transliterate(stem)), [("[^A-Za-z0-9._-]+", "_"), ("_+", "_"), ("^[._-]+|[._-]+$", "")])
    return F.coalesce(F.nullif(F.lower(clean), F.lit("")), F.lit("file"))


def numbered_name(stem: Column, index: Column, suffix: Column) -> Column:
    return F.concat(safe_stem(stem), F.lit("_"), F.format_string("%03d", index.cast("long")), F.lower(suffix))


def signature(name: Column, content: Column) -> Column:
    """name:size:md5 of an upload."""
    return F.concat_ws(":", name, F.octet_length(content).cast("string"), F.md5(content))


def icon(path: Column, icons: dict[str, str], default: str = "📎") -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in icons.items() for x in kv]), suffix), F.lit(default))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with two digits, halves to the even one."""
    unit = lambda n, name: F.format_string(f"%.2f {name}", F.bround(size / F.lit(1024.0**n), 2))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1, "KB")).when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def is_number(cell: Column) -> Column:
    """Only digits, once points, commas and minus signs are gone."""
    return F.translate(cell, ".,-", "").rlike(r"^\p{Nd}+$")


def units(text: Column) -> Column:
    """`5шт` and `5 ШТ` as `5 шт.`."""
    return replace_all(text, [(r"(\d+)([Шш][Тт]\.?)", "$1 $2"), (r"(\d+)\s+[Шш][Тт]\.?", "$1 шт.")])


def ocr_signs(text: Column) -> Column:
    """Plain quotes, dashes and special signs; no list mark. Null is empty."""
    text = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—ⅲⅢⅰ", "''\"\"--шШi")
    return F.regexp_replace(F.replace(text, F.lit("ⅱ"), F.lit("ii")), r"^\s*[-–—]\s*", "")


def ocr_words(text: Column) -> Column:
    """Units in one spelling, and digits read as letters repaired."""
    return replace_all(units(text), [(r"(?U)\b1([а-яА-ЯёЁ]{2,})", "Т$1"), (r"(?U)\b3([а-яА-ЯёЁ]{2,})", "З$1")])


def ocr_clean(text: Column) -> Column:
    """The first pass but for brands: signs, list mark, units and digits."""
    return ocr_words(ocr_signs(text))


def ocr_finish(text: Column) -> Column:
    """The last pass: list mark, spaces before punctuation, units, single spaces."""
    text = replace_all(text, [(r"^\s*[-–—]\s*", ""), (r"\s+([.,;!?])", "$1")])
    return one_space(units(text))


def tokens(text: Column) -> Column:
    """Words, spaces and single signs, in order; joined they're the text again."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|\s+|[^\p{L}\p{M}\p{N}_\s]"), 0)


def is_numeric(token: Column) -> Column:
    """Whether a token's type is numeric; no other type that's told before has these signs alone."""
    return token.rlike(r"^[\d.,]+$")


def token_type(token: Column) -> Column:
    """whitespace, word, technical, numeric or special."""
    digit, letters = token.rlike(r"\d"), F.regexp_count(token, F.lit("[A-Za-zА-Яа-я]"))
    upper = F.regexp_count(token, F.lit("[A-ZА-Я]"))
    technical = token.rlike("^(?:" + "|".join(f"(?:{p})" for p in TECHNICAL_PATTERNS) + ")$")
    return (
        F.when(token == "", "special")
        .when(token.rlike(r"^\s+$"), "whitespace")
        .when(digit & token.rlike("[a-z]"), "word")
        .when(technical, "technical")
        .when(digit & token.rlike("[A-ZА-Я]") & (F.length(token) >= 3) & (letters > 0) & (upper >= 0.7 * letters), "technical")
        .when(is_numeric(token), "numeric")
        .when(token.rlike(r"[\p{IsCyrillic}\p{IsLatin}]"), "word")
        .otherwise("special")
    )


def to_latin(word: Column) -> Column:
    """Cyrillic look-alikes as Latin letters."""
    return F.translate(word, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN)


def to_cyrillic(word: Column) -> Column:
    """Latin look-alikes as Cyrillic letters; then 3 and 6 are read as letters beside Cyrillic ones."""
    changed = F.translate(word, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)
    return F.when(changed.rlike("[А-Яа-я]"), F.translate(changed, "36", "Зб")).otherwise(changed)


def like_case(word: Column, original: Column) -> Column:
    """word in capitals, capitalised or in lower case, as original is."""
    shout = (F.upper(original) == original) & (F.lower(original) != original)
    first = F.substring(original, 1, 1)
    named = (F.upper(first) == first) & (F.lower(first) != first)
    head, tail = F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30))
    return F.when(shout, F.upper(word)).when(named, F.concat(head, tail)).otherwise(F.lower(word))


def brand_key(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "['’`ʹ]", ""))


def brand_variants(brands: list[str] = BRANDS) -> list[tuple[str, str]]:
    """(spelling, brand): as is, without apostrophes, with a space instead, in look-alikes."""
    looks = str.maketrans(LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)
    found: dict[str, str] = {}
    for brand in brands:
        for spelling in (brand, brand.replace("'", ""), brand.replace("'", " "), brand.translate(looks)):
            found[spelling.lower()] = brand
    return list(found.items())


def unfenced(text: Column) -> Column:
    """The inside of a leading code fence, else the text itself."""
    return F.when(text.startswith("```"), F.regexp_extract(text, r"(?s)^`{3}[^\n]*\n(.*?)(?:\n`{3}|$)", 1)).otherwise(text)


def after_assistant(text: Column) -> Column:
    """What follows the first `assistant` in any case; the text where there is none."""
    at = F.instr(F.lower(text), "assistant")
    return F.when(at > 0, F.trim(F.substring(text, at + 9, 1 << 30))).otherwise(text)


def markdown_rows(text: Column) -> Column:
    """array<array<string>> of a Markdown table: the first row is the header, the ruler is left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    kept = F.filter(lines, lambda x, i: ~((i == 1) & F.contains(x, F.lit("-"))))

    def cells(line: Column) -> Column:
        parts = F.split(line, "[|]")
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.trim(c))

    return F.transform(kept, cells)


def prompt_text(record: Column, number: Column) -> Column:
    """`Запись n:` and a line `  key: value` for each entry of array<struct<key, value>>."""
    lines = F.transform(record, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("Запись "), number.cast("string"), F.lit(":")), lines)


def sheet_name(name: Column) -> Column:
    """Letters, digits, spaces, hyphens and underscores only."""
    return F.rtrim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))


def as_list(values: Column) -> Column:
    """An array; null is an empty one."""
    return F.coalesce(values, F.array())


def filled_template(template: str, **values: Column) -> Column:
    """A template whose {names} are replaced by columns; null is empty, other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def pretty(value: Column) -> Column:
    """A struct, array or map as indented JSON."""
    return F.to_json(value, {"pretty": "true"})
