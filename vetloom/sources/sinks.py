"""Verdict files and the result store.

Store layout: ``<root>/results`` partitioned by engine, task, verdict and run, and
``<root>/main_log`` partitioned by run. The results of a run are written first and its log rows
last; readers follow the newest log row of each session, so a session is seen with all of its
results or not at all, and a session that is analysed again replaces the earlier one. Writing the
same run twice replaces its own partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_PARTITIONS = ["engine", "task", "verdict", "run_id"]


def write_verdicts(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Verdict table as CSV with header or as JSON records; an empty table is refused."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format: {fmt}")
    if df.isEmpty():
        raise ValueError("no verdicts to write")
    if fmt == "csv":
        df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    else:
        df.write.mode(mode).json(path)


def _replace_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def append_results(routed: DataFrame, root: str, run_id: str) -> None:
    """Write routed rows of one run; they stay unseen until the run's log rows exist."""
    _replace_partitions(
        routed.withColumn("run_id", F.lit(run_id)), f"{root}/results", RESULT_PARTITIONS
    )


def append_log(log: DataFrame, root: str, run_id: str) -> None:
    """Write session rows of one run, which makes its results visible."""
    log = log if "created_at" in log.columns else log.withColumn(
        "created_at", F.current_timestamp()
    )
    _replace_partitions(log.withColumn("run_id", F.lit(run_id)), f"{root}/main_log", ["run_id"])


def append_failures(failed: DataFrame, root: str, run_id: str) -> None:
    """Write sessions of one run that could not be analysed; they get no log row."""
    _replace_partitions(failed.withColumn("run_id", F.lit(run_id)), f"{root}/failures", ["run_id"])


def read_failures(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/failures")


def run_results(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Everything one run has written, logged or not."""
    return _read(spark, f"{root}/results").filter(F.col("run_id") == run_id)


def _read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("run_id", F.col("run_id").cast("string"))


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """Newest log row of every session."""
    log = _read(spark, f"{root}/main_log")
    newest = log.groupBy("session_id").agg(
        F.max(F.struct("created_at", "run_id")).alias("newest")
    ).select("session_id", "newest.*")
    return log.join(newest, ["session_id", "created_at", "run_id"], "left_semi")


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of the newest run of every session; filters on the partition columns prune."""
    runs = read_log(spark, root).select("session_id", "run_id")
    return _read(spark, f"{root}/results").join(runs, ["session_id", "run_id"], "left_semi")


def write_report(report: DataFrame, path: str) -> None:
    """Reason report as text, one package per record."""
    report.select("value").write.mode("overwrite").option("lineSep", "\n").text(path)
