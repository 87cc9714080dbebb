"""Spark session helpers: local sessions for tests/bench, and the shared
checkpoint folder (read from ``spark.checkpoint.dir``; set only when unset)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Nested-field pruning through generators copies the producing expression
# once per extracted field; exploding an array of spans that comes out of the
# masking expression would recompute the whole fold per field.  Inputs here
# are flat tables, so nested Parquet pruning gains nothing.
QUERY_CONF = {
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "false",
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    # A table's estimate before it is run is the size of its compressed files, divided among its columns: texts, JSON and
    # windows built around a narrow key would pass for small and be gathered on the driver.  Only measured sizes count.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}


def tune(spark: SparkSession) -> None:
    """Apply QUERY_CONF to a session (done by the registered queries)."""
    for k, v in QUERY_CONF.items():
        spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shroud",
                  driver_memory: str = "16g") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    for k, v in QUERY_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.  Only in a local session
    without one (tests) is a scratch folder created and set; anywhere else
    executors and driver would not share it."""
    d = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: master {master} needs a folder that all machines share")
        d = tempfile.mkdtemp(prefix="shroud-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder (never a machine-local tmp on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, name)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table under the shared checkpoint folder: computed once, its lineage cut, read by column.
    A checkpoint holds the same rows as plain objects, several times the size for texts."""
    spark, path = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
