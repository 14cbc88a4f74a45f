"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task works on at once.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none (tests on one machine) a local temporary folder is taken
    and set, so that later calls find it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='vetloom-llm-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``limit`` bytes of the given text or binary column.

    A single longer value is a run of its own; no value is cut.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(kind)
    return [x or b"" for x in column.to_pylist()]
