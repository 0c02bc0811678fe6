"""Training sets: aligned sheets, quotas, samples, records and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(sheets: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Sheets (keys, row_idx, ...) joined by row; rows that a sheet lacks are left out.

    Each sheet's other columns come as a struct of the sheet's name.
    """
    on = [*keys, "row_idx"]
    parts = [df.select(*on, F.struct(*[c for c in df.columns if c not in on]).alias(name)) for name, df in sheets.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, on)
    return out


def quotas(files: DataFrame, most: int = 50) -> DataFrame:
    """file, capacity, quota of files(file, capacity).

    All if they fit; else most // k each and one more for the first most % k
    files by name, at most the capacity; what a small file leaves isn't dealt
    again. The windows run over a row per file.
    """
    all_files = Window.partitionBy(F.lit(0))
    k, total = F.count(F.lit(1)).over(all_files), F.sum("capacity").over(all_files)
    place = F.row_number().over(Window.orderBy("file")) - 1
    share = F.floor(F.lit(most) / k) + (place < F.lit(most) % k).cast("int")
    return files.withColumn("quota", F.when(total <= most, F.col("capacity")).otherwise(F.least("capacity", share)).cast("long"))


def hash_order(key: Column, seed: str) -> Column:
    """A seeded order of rows that any engine can repeat."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows drawn without replacement, all if there are fewer."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def sample_by_quota(df: DataFrame, quota: DataFrame, file: str, key: str, seed: str) -> DataFrame:
    """Each file's quota of rows, in seeded order."""
    place = F.row_number().over(Window.partitionBy(file).orderBy(hash_order(F.col(key), seed), key))
    picked = df.join(quota.select(F.col("file").alias(file), "quota"), file)
    return picked.withColumn("_n", place).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def filled(row: Column, columns: list[str]) -> Column:
    """A target row: the columns as strings, null as empty."""
    return F.struct(*[F.coalesce(row[c].cast("string"), F.lit("")).alias(c) for c in columns])


def sheet_prompt(row: Column, columns: list[str], number: Column) -> Column:
    """`Запись n:` and a line for each column; a blank value leaves no space."""
    lines = []
    for c in columns:
        value = F.coalesce(row[c].cast("string"), F.lit(""))
        lines.append(F.concat(F.lit(f"  {c}:"), F.when(value != "", F.concat(F.lit(" "), value)).otherwise("")))
    return F.concat_ws("\n", F.concat(F.lit("Запись "), number.cast("string"), F.lit(":")), *lines)


def records(df: DataFrame, user: Column, answers: dict[str, Column], systems: dict[str, str], keep: list[str]) -> DataFrame:
    """Two records for each row, one per mode in the order of answers: mode, system, user, assistant.

    assistant is JSON text, for the two answers are of different types.
    """
    modes = [
        F.struct(F.lit(i).alias("n"), F.lit(mode).alias("mode"), F.lit(systems[mode]).alias("system"), user.alias("user"), F.to_json(F.struct(F.array(answer).alias("rows"))).alias("assistant"))
        for i, (mode, answer) in enumerate(answers.items())
    ]
    return df.select(*keep, F.explode(F.array(*modes)).alias("_m")).select(*keep, "_m.*").drop("n")


def three_views(name: str, code: str, maker: str, order_code: str, quantity: str, unit: str, spec: Column) -> dict[str, Column]:
    """The INPUT, EXTENDED and SIMPLIFIED rows of one combined row."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    full = F.concat_ws(" ", F.nullif(F.trim(c(name)), F.lit("")), F.nullif(F.trim(c(code)), F.lit("")))
    return {
        "INPUT": F.struct(c(order_code).alias("Код заказа"), F.concat_ws(" ", full, F.nullif(spec, F.lit(""))).alias("Наименование"), c(quantity).alias("Кол-во"), c(unit).alias("Ед.")),
        "EXTENDED": F.struct(c(code).alias("Обозначение"), c(name).alias("Наименование"), c(maker).alias("Производитель"), c(unit).alias("Единица измерения"), c(quantity).alias("Количество"), spec.alias("Техническое задание")),
        "SIMPLIFIED": F.struct(full.alias("Наименование"), c(unit).alias("Единица измерения"), c(quantity).alias("Количество"), spec.alias("Техническое задание")),
    }


def random_spec(key: Column, seed: str = "spec") -> Column:
    """Half of the rows: nothing; the others: two lengths (15 to 125 mm) or one of three phrases."""
    draw = lambda n: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{n}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    sizes = F.concat(F.lit("Lобщ.="), (draw(2) % 111 + 15).cast("string"), F.lit(" мм  Lраб="), (draw(3) % 111 + 15).cast("string"), F.lit("  мм"))
    phrases = F.array(F.lit("зенковка 90 градусов"), F.lit("для торцевых канавок"), F.lit("для ширины паза 0,5 мм"))
    return F.when(draw(0) % 2 == 0, "").when(draw(1) % 2 == 0, sizes).otherwise(F.element_at(phrases, (draw(4) % 3 + 1).cast("int")))


def masked_labels(ids: Column, prompt_length: Column) -> Column:
    """Token ids with -100 in place of the prompt."""
    k = F.least(prompt_length, F.size(ids))
    head = F.array_repeat(F.lit(-100).cast("long"), k)
    return F.concat(head, F.slice(ids, k + 1, F.greatest(F.size(ids) - k, F.lit(0))))


def aligned_sample(sheets: dict[str, DataFrame], keys: list[str], n: int, seed: str) -> dict[str, DataFrame]:
    """The same n rows of every sheet: rows are drawn once and joined to each."""
    first = next(iter(sheets.values())).select(*keys, "row_idx").distinct()
    place = hash_order(F.concat_ws(":", *keys, "row_idx"), seed)
    drawn = first.orderBy(place, *keys, "row_idx").limit(n)
    return {name: df.join(drawn, [*keys, "row_idx"], "left_semi") for name, df in sheets.items()}
