"""Sorts, pages, previews and set operations. Every sort ends in a unique key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir


def recent_sessions(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("created_at"), "session_id").limit(n)


def page_sessions(log: DataFrame, skip: int, limit: int) -> DataFrame:
    """``limit`` sessions after the ``skip`` newest ones."""
    return log.orderBy(F.desc("created_at"), "session_id").offset(skip).limit(limit)


def page_index(log: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """``(page, first_at, first_id)``: where each page of ``size`` sessions begins, newest first.

    Sessions are sorted over ``parts`` tasks by ranges of their key and written to the shared folder;
    the rows of the tasks before give each task the number of its first session. No task sees more
    than its range, and the index has one row a page.
    """
    spark = log.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = log.select(_at().alias("at"), "session_id")
    order = [F.desc("at"), F.col("session_id")]
    sorted_ = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    path = scratch_dir(spark, "pages")
    numbered = sorted_.select("at", "session_id", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("row"))
    numbered.write.parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = stored.join(counts.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part")
    number = F.col("before") + F.col("row")
    return placed.filter(number % size == 0).select(
        F.floor(number / size).alias("page"), F.col("at").alias("first_at"), F.col("session_id").alias("first_id"))


def page_by_key(log: DataFrame, index: DataFrame, page: int) -> DataFrame:
    """One page of ``page_index``, from 0, newest first: the sessions between two keys, no others."""
    def key(number: int):
        return index.filter(F.col("page") == number).agg(
            F.max(F.struct(F.col("first_at").alias("at"), F.col("first_id").alias("id"))).alias("k")).scalar()

    def reached(begin):
        return (_at() < begin["at"]) | (_at() == begin["at"]) & (F.col("session_id") >= begin["id"])

    here = log.filter(reached(key(page)) & ~F.coalesce(reached(key(page + 1)), F.lit(False)))
    return here.orderBy(F.desc("created_at"), "session_id")


def _at() -> Column:
    """The time of a session; one without it is the oldest."""
    return F.coalesce(F.col("created_at"), F.lit("0010-01-01").cast("timestamp"))


def sorted_report(df: DataFrame, label: str = "label", prob: str = "prob", key: str = "file_id"):
    return df.orderBy(label, F.desc(prob), key)


def head_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """First ``k`` rows in order, with the number of rows left out."""
    total = df.agg(F.count("*").alias("n")).select("n").scalar()
    return (
        df.orderBy(*order)
        .limit(k)
        .withColumn("n_more", F.greatest(total - F.lit(k), F.lit(0)).cast("bigint"))
    )


def sorted_targets(df: DataFrame, name: str = "package") -> DataFrame:
    return df.orderBy(name)


def union_labeled(parts: Mapping[object, DataFrame], label: str = "label") -> DataFrame:
    """Concatenate tables by column name, each with its label; columns may be missing in some."""
    out = None
    for value, df in parts.items():
        marked = df.withColumn(label, F.lit(value))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts to union")
    return out


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of the left side that the right side lacks."""
    return left.select(key).filter(F.col(key).isNotNull()).subtract(right.select(key))


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).filter(F.col(key).isNotNull()).intersect(right.select(key))


def session_files(detail: DataFrame) -> DataFrame:
    """Vulnerable rows followed by malicious rows; a file in both lists appears twice."""
    vulnerable = detail.filter(F.col("result_list") == "vulnerability_results")
    malicious = detail.filter(F.col("result_list") == "malicious_results")
    return vulnerable.unionByName(malicious)
