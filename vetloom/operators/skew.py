"""Joins whose hot keys are spread, as far as the data at hand have any.

Spark splits the hot partitions of a sort-merge join at run time, but only where both sides come
straight from their shuffle. A side that is itself an aggregate by the join key keeps the
aggregate's partitioning, and then one task would get all rows of a hot key. Such joins are salted:
a summary of the keys, measured when the plan runs, tells which keys are hot and how hot, and only
their rows and their copies of the other side are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces per fair share of a task, keys that a summary tells at most, and entries it tracks at least.
PIECES, KEYS, TRACKED = 4, 1000, 10_000


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def hot_keys(facts: DataFrame, keys: Sequence[str], parts: int | None = None) -> Column:
    """A map from the hash of each hot key to the number of pieces its rows are dealt in.

    Hot is a key with more rows than a fair share, that is all rows divided by ``parts`` (the shuffle
    partitions). The counts come from a mergeable summary of frequent items, a few kilobytes a task,
    so the map has at most ``KEYS`` entries. It is a scalar subquery: nothing runs before the plan
    that uses it. What it tells moves rows between tasks and never changes a result.
    """
    parts = parts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summary = facts.select(_key_hash(keys).alias("h")).agg(
        F.call_function("approx_top_k", "h", F.lit(KEYS), F.lit(max(TRACKED, min(8 * parts, 1_000_000)))).alias("top"),
        F.count("*").alias("n"),
    )
    fair = lambda x: x["count"] * parts / F.col("n")
    hot = F.transform(
        F.filter("top", lambda x: fair(x) > 1),
        lambda x: F.struct(x["item"].alias("h"), F.ceil(PIECES * fair(x)).cast("int").alias("pieces")),
    )
    return summary.select(F.map_from_entries(hot)).scalar()


def salted_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    by: Sequence[str] | None = None,
    measured: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``facts`` joined with ``dimension`` on ``on``; ``how`` is inner, left or left_semi.

    Rows of a hot key go to several tasks by the hash of the columns ``by`` (all columns unless given),
    and the dimension's rows of that key are repeated once for each; all other rows are joined as
    they are. The salt follows from the row itself, so a recomputed task sends every row where it went
    before. The hot keys are measured on ``facts``, or on ``measured`` where its key columns are
    cheaper to get and spread alike.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"a salted join cannot be {how}")
    keys = [on] if isinstance(on, str) else list(on)
    hot = hot_keys(facts if measured is None else measured, keys, parts)
    pieces = F.coalesce(F.try_element_at(hot, _key_hash(keys)), F.lit(1))
    plain = [c for c, t in facts.dtypes if not t.startswith(("map", "variant"))]
    spread_by = [F.col(f"`{c}`") for c in (by or plain)]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), pieces).cast("int"))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
