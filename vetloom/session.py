"""Spark session with the settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time, also when the join feeds an aggregate.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Archives and files go to Python in batches bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def get_spark(app: str = "vetloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and hand-off tables.

    This lies in the shared folder named by ``spark.checkpoint.dir``. Only where that is unset and Spark
    runs in one process (tests) a local temporary folder is taken and set for later calls; on a cluster,
    whose machines would each write to their own disk, a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='vetloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def spread(df: DataFrame) -> DataFrame:
    """Give row-wise heavy work at least one partition per core.

    A scan of many files already has more partitions than cores and is returned as it is; only a
    scan that produced fewer (one small file) is redistributed.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
