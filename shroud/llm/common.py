"""Helpers shared by the operators: scratch tables, reading, safe column handling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut, safe when executors go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Rows a batch sent to a Python worker holds at most; texts are long, so the default of 10 000 is too many.

    ``size`` bounds its bytes too, for operators whose own tables have rows of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size is None:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    else:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
