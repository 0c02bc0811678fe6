"""From raw documents to packed batches, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Every stage works
on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm import common, language, mixing, packing, secrets, similar, tokens

#: A document is rejected if no language was found or its score is lower: its
#: n-grams then hardly share an order with any profile.
LEAST_SCORE = 0.25


def plain(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with numbers for names but for those that operators read, so that no other column's name matters."""
    return docs.select(*[common.quoted(c).alias(c if c in names else f"_{i}") for i, c in enumerate(docs.columns)])


def named(rows: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns of docs, out of rows that were made from plain(docs, names)."""
    return rows.select(*[F.col(c if c in names else f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or close to no learned language.

    Null texts go; where no document has a language to learn from, no document
    can be judged and all with text stay.
    """
    profiles = language.learn(docs)
    if not profiles.names:
        return docs.where(F.col("text").isNotNull())
    rows = plain(docs, ("text",))
    found = language.predict(rows, profiles, tuple(rows.columns))
    return named(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs, ("text",))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near-duplicates.

    Five-word shingles at a similarity of 0.8 or more. Rows without a doc_id
    stay; null and blank texts are one group, and of repeated rows one stays.
    """
    read = ("doc_id", "text")
    rows = plain(docs, read)
    return named(similar.one_of_each(rows, similar.near_duplicates(rows)), docs, read)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mask; n_chars is counted again. No document goes.

    Null and empty texts stay as they are (a null one has a null n_chars), and
    repeated rows are treated alike.
    """
    read = ("text", "n_chars")
    rows = plain(docs, read)
    clean = secrets.redact(rows, secrets.scanner(rows))
    return named(clean.withColumn("n_chars", F.length("text").cast("long")), docs, read)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources reach their target words.

    Null sources are a source, null and blank texts have no words and go with
    their source's whole copies; rows that are repeated are each drawn alike.
    """
    read = ("doc_id", "source", "text")
    rows = plain(docs, read)
    mixed = mixing.mix(rows, common.word_count(F.col("text")), keep=tuple(rows.columns))
    return named(mixing.repeat(mixed.select(*rows.columns, "epochs")), docs, read)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all documents of the mix, copies included, by the tokenizer's counts.

    Null and empty texts have no tokens and are packed like others; of equally
    long rows either may come first, for they're packed alike.
    """
    import public_tokenizers

    counted = tokens.count_tokens(docs.select("doc_id", "text"), public_tokenizers.path(tokens.TOKENIZER))
    return packing.pack(counted, F.col("n_tokens"), name="n_tokens")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("packing", pack),
]

#: Models and hashes take part in four of the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A stage's files are deleted once the next stage has written its own; the
    last ones stay, for the result reads them.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            common.remove(spark, f"{folder}/{number - 1}")
    return docs
