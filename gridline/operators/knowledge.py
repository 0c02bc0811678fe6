"""The knowledge graph of makers, tools and parameters as two relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY_SCHEMA = "name string, type string, attributes map<string,string>, ord long"
RELATION_SCHEMA = "from_entity string, to_entity string, relation_type string, confidence double, ord long"

# Fixed values. Makers: country, speciality and what they produce.
MAKERS = {
    "Sandvik": ("Швеция", "Металлообработка, горное дело", ["Державка", "Пластина"]),
    "YG-1": ("Южная Корея", "Режущие инструменты", ["Сверло", "Фреза"]),
    "KELITE": ("Китай", "Твердосплавные инструменты", ["Фреза", "Пластина"]),
    "ZCC": ("Китай", "Пластины и державки", ["Пластина"]),
    "EROGLU": ("Турция", "Зажимные системы", ["Цанга"]),
    "DAndrea": ("Италия", "Державки и зажимные системы", ["Державка", "Державка для сверла", "Державка для фрезы"]),
    "JieHe": ("Китай", "Державки и инструментальная оснастка", ["Державка", "Державка для сверла", "Державка для фрезы"]),
    "ZeTOOL": ("Китай", "Цанги и зажимные системы", ["Цанга", "Цанга для сверла", "Цанга для фрезы"]),
    "KGM": None,
    "CNMG": None,
    "DCMT": None,
}
# Fixed values. Tools: category (and whether the graph links it) and purpose.
TOOLS = {
    "Державка": ("режущий_инструмент", True, "Крепление режущих пластин"),
    "Пластина": ("режущий_инструмент", True, "Резание металла"),
    "Сверло": ("сверлильный_инструмент", True, "Сверление отверстий"),
    "Фреза": ("фрезерный_инструмент", True, "Фрезерование поверхностей"),
    "Цанга": ("зажимной_инструмент", True, "Зажим заготовок"),
    "Винт": ("крепежный_элемент", False, None),
    **dict.fromkeys(["Сверло центровочное", "Твердосплавная концевая фреза", "Державка для сверла", "Державка для фрезы", "Державка для пластины", "Цанга для сверла", "Цанга для фрезы", "Цанга для инструмента"]),
}
# Fixed values. Parameters: unit and type of value.
PARAMETERS = {"Lобщ": ("мм", "число"), "Lраб": ("мм", "число"), "Ø": ("мм", "число"), "угол": ("градус", "число"), "материал": ("текст", "строка"), "покрытие": None, "тип_крепления": None, "размер_хвостовика": None}
UNITS = ["мм", "градус", "шт", "мкм", "дюйм"]
LINKED_PARAMETERS = ["Lобщ", "Lраб", "Ø", "угол"]


def entities(spark: SparkSession) -> DataFrame:
    rows = []
    for name, own in MAKERS.items():
        country, field, _ = own or ("Неизвестно", "Общее машиностроение", [])
        rows.append((name, "производитель", {"страна": country, "специализация": field}))
    for name, own in TOOLS.items():
        category, _, purpose = own or ("общий_инструмент", False, None)
        rows.append((name, "тип_инструмента", {"категория": category, "назначение": purpose or "Обработка материалов"}))
    for name, own in PARAMETERS.items():
        unit, kind = own or ("безразмерная", "строка")
        rows.append((name, "параметр", {"единица_измерения": unit, "тип_значения": kind}))
    rows += [(name, "единица_измерения", {}) for name in UNITS]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ENTITY_SCHEMA)


def relations(spark: SparkSession) -> DataFrame:
    rows = [(maker, tool, "производит") for maker, own in MAKERS.items() if own for tool in own[2]]
    rows += [(p, PARAMETERS[p][0], "единица_измерения") for p in LINKED_PARAMETERS]
    rows += [(tool, own[0], "категория") for tool, own in TOOLS.items() if own and own[1]]
    return spark.createDataFrame([(*r, 1.0, i) for i, r in enumerate(rows)], RELATION_SCHEMA)


def upsert(known: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by name; of several the one of the highest ord, new before known."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("_new"), F.desc("ord")))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_new")


def add_relations(known: DataFrame, new: DataFrame) -> DataFrame:
    """Relations of both, each once, so that reloading a graph doesn't repeat them."""
    key = ["from_entity", "to_entity", "relation_type", "confidence"]
    return known.unionByName(new).groupBy(*key).agg(F.min("ord").alias("ord"))


def neighbours(relations: DataFrame, relation_type: str | None = None) -> DataFrame:
    """name, neighbour, relation_type, ord: every relation seen from both ends; a loop once."""
    kept = relations if relation_type is None else relations.where(F.col("relation_type") == relation_type)
    ahead = kept.select(F.col("from_entity").alias("name"), F.col("to_entity").alias("neighbour"), "relation_type", "ord")
    back = kept.where(F.col("from_entity") != F.col("to_entity")).select(F.col("to_entity").alias("name"), F.col("from_entity").alias("neighbour"), "relation_type", "ord")
    return ahead.unionByName(back)


def cards(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, type, attributes, relations: each entity with its neighbours in order."""
    near = neighbours(relations).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("ord", "neighbour"))).alias("_n"))
    listed = F.coalesce(F.transform("_n", lambda n: n["neighbour"]), F.array().cast("array<string>"))
    return entities.join(near, "name", "left").select("name", "type", "attributes", listed.alias("relations"))


def save(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Both relations as JSON lines."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    relations.write.mode("overwrite").json(f"{path}/relations")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(ENTITY_SCHEMA).json(f"{path}/entities"), spark.read.schema(RELATION_SCHEMA).json(f"{path}/relations")
