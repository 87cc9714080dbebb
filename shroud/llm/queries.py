"""The operators over the supplied tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm, jaccard, language, near, negatives, packing, phrases, search, secrets, suffix, toxicity, warc
from .common import scratch, small_batches, table

#: Place of the vocabulary; executors have the same installation.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY, 1024, 2)
    return packing.pack(cut, 1024, order=["doc_id", "piece"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages, path = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    warc.write(pages, path, key="page_id", payload="html", target="url", min_bytes=100)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, path, payloads=False).select(
        F.col("record_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "error")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, keep_ids=False)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, size=4 << 20)
    return suffix.dedup(table(spark, sf_dir, "documents"), length=200, keep_bytes=False)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return hmm.score(table(spark, sf_dir, "documents"), fold=7, held=2)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near.link(table(spark, sf_dir, "embeddings"), least=0.95)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.identify(table(spark, sf_dir, "documents"), fold=5, rest=0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, size=4 << 20)
    return phrases.mine(table(spark, sf_dir, "documents"), least=30, share=80, top=2000)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "embeddings")
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", other), F.col("vec_id") % 100 == 0, scale=256.0, positives=5, negatives=10, low=30, high=90)


QUERIES = {"op1_packing": op1_packing, "op2_warc": op2_warc, "op3_bpe": op3_bpe, "op4_suffix": op4_suffix, "op5_hmm": op5_hmm, "op6_embeddings": op6_embeddings, "op7_jaccard": op7_jaccard,
           "op8_search": op8_search, "op9_secrets": op9_secrets,
           "op10_toxicity": op10_toxicity, "op11_language": op11_language, "op12_phrases": op12_phrases, "op13_negatives": op13_negatives}
