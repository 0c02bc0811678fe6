"""Small tables with every awkward case."""

LONG = "word " * 30_000
DOCS = [
    (1, "The cat sat on the mat and then it sat there again", "en", "b", 50),
    (2, "The cat sat on the mat and then it sat there again", "en", "b", 50),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n\x0b ", None, "a", 5),
    (6, LONG, "en", "c", len(LONG)),
    (7, "ein Text über Äpfel und Öl\nzweite Zeile\nzweite Zeile", "de", "c", 40),
    (8, "12345 67890 !!! ###", "de", None, 19),
    (9, "x", "fr", "d", 1),
    (None, "no id here", "en", "a", 10),
    (1, "The cat sat on the mat and then it sat there again", "en", "b", 50),
    (10, "line sep\x1cfs é é 日本 \U0001f600", "ja", "é", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["size", "fp", "shard", "_slice", "_key", "_row", "lang_pred", "score", "epochs", "n_tokens", "bucket", "words", "_n", "node", "kept", "_lang", "_share", "bands"]


def documents(spark, folder, rows=DOCS, extra=True):
    """Write the rows as documents.parquet into a folder, with clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        pairs = F.create_map(F.lit("k"), F.lit(1))
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING], F.lit("y").alias("a.b"), F.lit(2).alias("`odd name`.*"), pairs.alias("_at"), F.struct(pairs.alias("m"), F.lit(None).cast("binary").alias("n.o")).alias("root"))
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
