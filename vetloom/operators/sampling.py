"""Seeded, repeatable sampling and splitting by the hash order of a unique row key.

The order is the MD5 text of seed and key, so any engine reproduces it. Taking "the first n of a
class" never ranks the class and never moves a row: the hash of the n-th row is found digit by digit
from histograms, which combine map-side, and then every row is decided where it lies by comparing its own
hash. A class with a third of all rows costs no more than its histograms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the hash that one histogram resolves, and digits after which the rows left are ranked:
# 40 bits, which a row shares with one other in a group of 10^12.
DIGITS, RESOLVED = 5, 10


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _at_rank(counts: DataFrame) -> DataFrame:
    """Rows of the histogram that hold the rank looked for, with the rank inside them."""
    upto = F.sum("n").over(Window.partitionBy("g", "i").orderBy("prefix"))
    found = counts.withColumn("below", upto - F.col("n"))
    found = found.filter((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
    return found.withColumn("rank", F.col("rank") - F.col("below"))


def _cut_hashes(rows: DataFrame, cuts: Callable[[Column], Column], digits: int) -> Column:
    """A map from group to its cuts: each cut rank, the group's size and the hash of the row at that rank.

    A scalar subquery with one entry per group and cut; ``rows`` are ``(g, h)``.
    """
    prefix = lambda n: F.substring("h", 1, n).alias("prefix")
    counts = rows.groupBy("g", prefix(digits)).agg(F.count("*").alias("n"))
    counts = counts.withColumn("size", F.sum("n").over(Window.partitionBy("g")))
    asked = counts.withColumn("cuts", cuts(F.col("size"))).select("g", "prefix", "n", "size", F.posexplode("cuts").alias("i", "cut"))
    found = _at_rank(asked.withColumn("rank", F.greatest(F.lit(1), F.least("cut", "size"))))
    known, carried = digits, ["g", "i", "cut", "size", "rank"]

    def agreeing() -> DataFrame:
        """Rows whose hash begins as that of a row looked for."""
        state = found.agg(F.collect_list(F.struct(*carried, "prefix")).alias("s")).scalar()
        same = F.filter("state", lambda s: (s["g"] == F.col("g")) & (s["prefix"] == F.substring("h", 1, known)))
        return rows.withColumn("state", state).select("h", F.explode(same).alias("s")).select("s.*", "h")

    while known < RESOLVED:
        hits, known = agreeing().drop("prefix"), min(known + digits, RESOLVED)
        found = _at_rank(hits.groupBy(*carried, prefix(known)).agg(F.count("*").alias("n")))
    place = F.row_number().over(Window.partitionBy("g", "i").orderBy("h"))
    last = agreeing().withColumn("place", place).filter("place = rank")
    each = last.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "cut", "size", "h"))).alias("cuts"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("g", "cuts")))).scalar()


def hash_cut(
    df: DataFrame,
    group: Column,
    key: str,
    cuts: Callable[[Column], Column],
    seed: int = 42,
    digits: int = DIGITS,
) -> DataFrame:
    """Add ``_part``: how many of the group's cut ranks lie before the row's hash rank.

    ``cuts`` turns the class size into an array of cut ranks. ``key`` has to be unique, else equal
    keys fall on one side of a cut together. Null is a group of its own. Groups are classes, of which there
    are few: the hashes at their cuts enter the plan as one value, and the rows stay where they are.
    """
    name = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = df.select(name.alias("g"), hash_order(key, seed).alias("h"))
    own = df.withColumns({"_h": hash_order(key, seed), "_cuts": F.try_element_at(_cut_hashes(rows, cuts, digits), name)})
    passed = F.filter("_cuts", lambda c: (c["cut"] <= 0) | (c["cut"] < c["size"]) & (F.col("_h") > c["h"]))
    return own.withColumn("_part", F.size(passed)).drop("_h", "_cuts")


def _smallest(df: DataFrame, label: str) -> Column:
    """Row count of the smallest class, as a scalar subquery."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min("n").alias("m")).select("m").scalar()


def balanced_sample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest class has."""
    least = _smallest(df, label)
    cut = hash_cut(df, F.col(label), key, lambda size: F.array(least), seed)
    return cut.filter("_part = 0").drop("_part")


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def _fractions(fractions: Sequence[float]) -> Callable[[Column], Column]:
    """Cut ranks after each fraction but the last."""
    edges = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]
    return lambda size: F.array(
        *[F.floor(size * F.lit(float(e)) + 1e-9).cast("bigint") for e in edges]
    )


def random_split(
    df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42, out: str = "part"
) -> DataFrame:
    """Exact split: ``out`` is ``train`` for the given share of all rows, else ``test``."""
    split = hash_cut(df, F.lit(0), key, _fractions((fraction, 1 - fraction)), seed)
    return split.withColumn(out, F.when(F.col("_part") == 0, "train").otherwise("test")).drop(
        "_part"
    )


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    fractions: Sequence[float] = (0.8, 0.1, 0.1),
    names: Sequence[str] = ("train", "val", "test"),
    seed: int = 42,
    min_per_class: int = 2,
    out: str = "part",
) -> DataFrame:
    """Exact shares inside every class.

    When a class has fewer than ``min_per_class`` rows, the table is split as a whole.
    """
    group = F.when(_smallest(df, label) >= min_per_class, F.col(label).cast("string")).otherwise(F.lit("*"))
    split = hash_cut(df, group, key, _fractions(fractions), seed)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("_part") + 1)
    return split.withColumn(out, name).drop("_part")
