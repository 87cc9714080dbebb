"""Corpus pipeline: from raw documents to packed training sequences.

Toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, secrets are masked, and what is left is packed.  Each stage
takes the documents that the one before it kept; all but the last return the
columns of ``documents``.  A document whose whole text was cut stays with an
empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import jaccard, packing, secrets, suffix, toxicity
from shroud.llm.common import small_batches, table, written
from shroud.llm.queries import VOCABULARY


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier chain rejects go."""
    small_batches(spark, rows=250, size=1 << 20)
    return toxicity.keep_clean(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates one row stays, that of the smallest doc_id (null last; among
    rows of one id, of the least digest).  Rows equal in all columns are one; other rows go by themselves, whatever their ids.
    """
    small_batches(spark, rows=500, size=1 << 20)
    rows = docs.select(F.struct("doc_id", "text").alias("of"), F.struct("*").alias("row"))    # no column of docs meets one of ours
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)))
    name = F.struct(F.col("of.doc_id").isNull().alias("none"), F.col("of.doc_id"), "digest").alias("name")
    found = jaccard.join(rows.select(name, F.col("of.text").alias("text")), key="name", block_bytes=2 << 20)
    gone = found.where(F.col("name") != F.col("component_id")).select(F.col("name.digest").alias("digest")).distinct()
    return rows.join(gone, "digest", "left_anti").dropDuplicates(["digest"]).select("row.*")


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: byte strings of 200 bytes that occur more than once are cut out."""
    small_batches(spark, rows=500, size=2 << 20)
    return _counted(suffix.without_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: secrets are masked."""
    small_batches(spark)
    return _counted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token pieces and their places in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, VOCABULARY, 1024, 2), 1024, order=["doc_id", "piece"])


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard", distinct_documents),
    ("suffix_dedup", without_passages),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL expresses none of the classifier, the suffix array and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packed:
            docs = written(docs, name)
    return docs
