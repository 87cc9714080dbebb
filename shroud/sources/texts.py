"""Text sources (S1) and sinks.

Any DataFrame with an id and a text column becomes a ``texts`` table
(session_id, seq, text, language, prepend_hint).  Readers take an explicit
schema (no inference) and select only the columns they need, so the Parquet
scan reads two or three columns, not the whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS_SCHEMA = "session_id string, seq long, text string, language string, prepend_hint boolean"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_from(df: DataFrame, id_col: str, text_col: str, language: Column | None = None,
               session: Column | None = None, prepend_hint: Column | None = None) -> DataFrame:
    """Project any table into the ``texts`` shape."""
    return df.select(
        (session if session is not None else F.col(id_col).cast("string")).alias("session_id"),
        F.col(id_col).cast("long").alias("seq"),
        F.col(text_col).alias("text"),
        (language if language is not None else F.lit("ru")).alias("language"),
        (prepend_hint if prepend_hint is not None else F.lit(False)).alias("prepend_hint"))


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S1 for files already in the ``texts`` shape (parquet or json lines),
    or plain text files: one text per line, its own session, named by the file
    and a hash of the line (equal lines of a file share it), so that neither
    depends on how the file is split."""
    if fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", "text")
        name = F.concat_ws("#", F.col("_metadata.file_path"), F.sha2("text", 256))
        return df.select(name.alias("session_id"), F.lit(0).cast("long").alias("seq"), "text",
                         F.lit("ru").alias("language"), F.lit(False).alias("prepend_hint"))
    return spark.read.schema(TEXTS_SCHEMA).format(fmt).load(path)


def write_masked(masked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the masked table (Parquet)."""
    masked.write.mode(mode).parquet(path)
