"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits that one level of the histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc: Column) -> Column:
    """The first 60 bits of an MD5, so that any engine can repeat it; a null id hashes as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``target`` per source from ``source`` and ``source_size``.

    Sources in code point order, null last, weigh ``weights`` over and over and share the sum of all
    sizes. A target stops at ``most`` times its source's size; the excess is shared again by weight
    until none is above. Sorted by size per weight, the stopped sources are a prefix, which running
    sums find in one step. One row per source takes part, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    weighed = weighed.withColumn("full", (F.col("source_size") * most).cast("double"))
    by = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    # A source is stopped if what is left, shared by weight among it and the later ones, exceeds it.
    stopped = F.col("left") * F.col("weight") > F.col("full") * F.col("open")
    level = level.withColumn("stopped", stopped)
    rest = F.sum(F.when(~F.col("stopped"), F.lit(0.0)).otherwise(F.col("full"))).over(every)
    weight = F.sum(F.when(F.col("stopped"), F.lit(0.0)).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("stopped"), F.col("full")).otherwise(
        (F.sum("source_size").over(every) - rest) * F.col("weight") / weight
    )
    return level.select("source", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the hash below which rows fit the budget, and the one nearest to it.

    ``rows``: source, hash, size; ``goals``: source, budget. Sizes are summed by source and hash
    bucket; the bucket that the budget runs through is the only one whose rows the next level looks
    at. After the last level the bucket is a single hash.
    """
    found = goals.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - bits
        inside = rows.withColumnRenamed("source", "_source").join(
            found,
            F.col("_source").eqNullSafe(F.col("source"))
            & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")),
        )
        sums = inside.groupBy("source", "budget", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", run)
        crossing = sums.where("upto > budget AND upto - size <= budget")
        found = keep(
            crossing.select("source", (F.col("budget") - F.col("upto") + F.col("size")).alias("budget"),
                            F.col("bucket").alias("prefix"), F.col("size").alias("_size")),
            "threshold",
        )
    # The boundary hash itself joins if that comes nearer to the budget.
    return found.select("source", F.when(F.col("_size") - F.col("budget") < F.col("budget"), F.col("prefix"))
                        .otherwise(F.col("prefix") - 1).alias("cut"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source: ``_source``, ``source_size``, ``target``, ``whole`` and ``cut``.

    The mix takes a document ``whole`` times and once more if its hash is at most ``cut``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, most)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = keep(goals.withColumn("whole", F.least(share, F.lit(most)).cast("long")), "goals")
    budgets = goals.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = _threshold(rows, budgets.where("budget > 0")).withColumnRenamed("source", "_s")
    found = goals.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return keep(found.withColumnRenamed("source", "_source"), "plan")


def _sized(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    slim = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       _hash(F.col(doc)).alias("hash"))
    return keep(slim, "sizes")


def _times(hashed: Column) -> Column:
    return (F.col("whole") + F.when(hashed <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))).cast("long")


def mix(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3), most: int = 3,
) -> DataFrame:
    """``doc``, ``source``, ``size``, ``source_size``, ``target`` and ``times`` the mix takes a document.

    A source whose target is r times its size takes every document floor(r) times and, once more,
    the documents whose hash lies below the threshold at which the rest of the target is reached, so
    its words miss the target by less than the documents of one hash. No document is taken more than
    ``most`` times. Nothing is sorted and nothing is drawn: reruns agree. Null and blank texts have
    size zero; null is a source of its own; repeated rows share a hash and are taken alike; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = _sized(docs, doc, text, source)
    taken = rows.join(plan(rows, weights, most), F.col("source").eqNullSafe(F.col("_source")))
    return taken.select("doc", "source", "size", "source_size", "target", _times(F.col("hash")).alias("times"))


def mixed_documents(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3), most: int = 3,
) -> DataFrame:
    """``docs`` after mixing: rows the mix leaves out go, rows it takes k times come k times.

    Texts are not shuffled: each row is decided by its source's line of the plan and its own hash.
    """
    found = plan(_sized(docs, doc, text, source), weights, most)
    rows = docs.join(found.select("_source", "whole", "cut"), docs[source].eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_times", _times(_hash(docs[doc])).cast("int")).where("_times > 0")
    return rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[docs[c] for c in docs.columns])
