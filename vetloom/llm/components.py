"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")
    ).first()
    return tuple(row)


def _nearest(links: DataFrame, name: str) -> DataFrame:
    """Each node's smallest neighbour or itself; kept, so that joins with it can split hot nodes."""
    return keep(links.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m")), name)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node that has a link.

    Alternates large-star and small-star contraction until the links no longer change; every round
    is two joins with an aggregate that combines map-side. Links from a node to itself, repeated
    links and nulls are ignored. Only counts come to the driver.
    """
    links = edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a"))
    links = keep(links.where("a > b").distinct(), "links")
    before = _state(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        near = _nearest(both, "large")
        large = (
            both.join(near, both.u == near.n)
            .where("v > u AND v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = keep(large, "large")
        near = _nearest(large, "small")
        small = (
            large.join(near, large.u == near.n)
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(near.select(F.col("n").alias("a"), F.col("m").alias("b")))
            .where("a > b")
            .distinct()
        )
        links = keep(small, "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
