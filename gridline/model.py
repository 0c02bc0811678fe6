"""Target schemas, header anchors, brands, terms, homoglyphs."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values. Column names, anchors and word lists that results depend on.
SIMPLIFIED = ["Наименование", "Единица измерения", "Количество", "Техническое задание"]
EXTENDED = ["Обозначение", "Наименование", "Производитель", "Единица измерения", "Количество", "Техническое задание"]

HEADER_ANCHORS = {
    "poz": ["поз", "позиция", "артикул", "№", "п/п", "№ п/п"],
    "name": ["наименование", "товар", "товары", "обозначение", "инструмент"],
    "pic": ["рис"],
    "qty": ["кол", "кол-во", "количество", "кол."],
    "price": ["цена"],
    "curr": ["валюта"],
    "disc": ["скидка"],
    "other": ["ндс", "сумма", "ставка", "бренд", "производитель", "модель", "фирма", "единица измерения", "потребность"],
}

BRANDS = ["D'Andrea", "Sandvik", "Iscar", "Kennametal", "Seco", "Walter", "Mitsubishi", "Sumitomo", "Kyocera", "Tungaloy", "Korloy"]
DOMAIN_TERMS = [
    "резец", "державка", "пластина", "цанговый", "патрон", "хвостовик", "расточной", "расточная", "кассета", "кассеты",
    "пружинный", "прецизионный", "инструмент", "вставка", "головка", "резцедержатель", "переходник", "вкладыш",
]
TECHNICAL_PATTERNS = [
    r"[A-ZА-Я]{1,3}\d{1,4}[A-ZА-Яа-я\d'.\-]*",
    r"[A-ZА-Яа-я]+\d+[A-ZА-Яа-я\d\-.]*",
    r"[A-Z]{2,}(?:\s+\d+)?",
    r"[A-ZА-Я]{2,}[A-ZА-Я]{2,}",
    r"[A-ZА-Я]{2}[A-ZА-Я]{2}\s*\d+",
]

# Fixed values. Letters that look alike: Latin in the first line, Cyrillic below.
LOOKALIKE_LATIN = "AaBEeKMHOoPpCcTtyXxruniINUY"
LOOKALIKE_CYRILLIC = "АаВЕеКМНОоРрСсТтуХхгипіІПИУ"

# Fixed values. Russian letters and their Latin spelling (capitals alike).
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh",
    "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya",
}

FIELD_NAMES = {
    "Обозначение": "designation",
    "Наименование": "name",
    "Производитель": "manufacturer",
    "единица измерения": "unit",
    "Единица измерения": "unit",
    "Количество": "quantity",
    "Техническое задание": "technical_specification",
}


def target(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def response(columns: list[str]) -> T.StructType:
    """The shape of a model's answer: {"rows": [target, ...]}."""
    return T.StructType([T.StructField("rows", T.ArrayType(target(columns)))])
