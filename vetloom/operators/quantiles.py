"""Exact quantiles by radix selection, as part of the plan that uses them.

Doubles become 64-bit integers in the same order. The rank looked for is found from the highest digit
down: a histogram of the next digit among the rows that agree with the digits found so far tells the
digit and the rank below it. Histograms combine map-side and have at most one entry per digit value,
whatever the number of rows, ties included; no sort, sketch or driver loop takes part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a key, and bits of one digit: three digits, each a pass over the columns.
BITS, DIGIT = 64, 22
_INFINITE, _NAN = 0x7FF << 52, (1 << 63) - 1


def ordered_key(x: Column) -> Column:
    """The bits of a double as a long with the order of the doubles: NaN last, both zeros equal.

    Exponent and mantissa come from exact operations only (powers of two); the logarithm just has to
    be within one of the exponent.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = guess + F.when(power(guess + 1) <= a, 1).when(power(guess) > a, -1).otherwise(0)
    normal = (exponent + 1023).cast("long") * (1 << 52) + ((a / power(exponent) - 1.0) * 2.0**52).cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")
    bits = (
        F.when(F.isnan(x), _NAN)
        .when(a == float("inf"), _INFINITE)
        .when(a < 2.0**-1022, small)
        .otherwise(normal)
    )
    return F.when(x.isNotNull(), F.when(x < 0, -bits).otherwise(bits))


def value_of_key(key: Column) -> Column:
    """The double of an ``ordered_key``."""
    bits = F.abs(key)
    exponent, mantissa = F.shiftright(bits, 52), bits.bitwiseAND((1 << 52) - 1).cast("double")
    size = (
        F.when(bits == _INFINITE, float("inf"))
        .when(exponent == 0, mantissa * 2.0**-537 * 2.0**-537)
        .otherwise((1.0 + mantissa * 2.0**-52) * F.pow(F.lit(2.0), exponent - 1023))
    )
    return F.when(key == _NAN, float("nan")).when(key < 0, -size).otherwise(size)


def _found(counts: DataFrame, *group: str) -> DataFrame:
    """Rows of the histogram that hold the wanted rank, with the rank inside them."""
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("prefix"))
    below = counts.withColumn("below", upto - F.col("n"))
    inside = below.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
    return inside.withColumn("rank", F.col("rank") - F.col("below"))


def exact_quantiles_of(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], digit: int = DIGIT
) -> Column:
    """Linearly interpolated quantiles: a map from column name to an array in the order of ``probs``.

    The map is a scalar subquery to be used in another plan; nothing runs while that is built. The
    columns are read once per digit of ``digit`` bits, all columns and ranks together. Nulls do not
    count; a column without values has no entry.
    """
    keys = F.array(*[ordered_key(F.col(f"`{c}`").cast("double")) for c in columns])
    rows = df.select(keys.alias("keys"))
    targets = F.array(*[
        F.struct(F.lit(2 * k + side).alias("target"), F.lit(float(p)).alias("p"), F.lit(side).alias("side"))
        for k, p in enumerate(probs) for side in (0, 1)
    ])
    shift = BITS - digit
    counts = rows.select(F.posexplode("keys").alias("column", "key")).filter("key IS NOT NULL")
    counts = counts.groupBy("column", F.shiftright("key", shift).alias("prefix")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))
    asked = counts.withColumn("place", total - 1).withColumn("t", F.explode(targets))
    place = F.col("t.p") * F.col("place")
    asked = asked.select(
        "column", "prefix", "n", F.col("t.target").alias("target"), (place - F.floor(place)).alias("fraction"),
        F.when(F.col("t.side") == 0, F.floor(place)).otherwise(F.ceil(place)).alias("rank"),
    )
    found = _found(asked, "column", "target")
    while shift:
        last, shift = shift, max(shift - digit, 0)
        state = found.agg(F.collect_list(F.struct("column", "target", "fraction", "rank", "prefix")))
        agree = F.filter("state", lambda s: F.shiftright(F.get(F.col("keys"), s["column"]), last) == s["prefix"])
        hits = rows.withColumn("state", state.scalar()).select("keys", F.explode(agree).alias("s"))
        key = F.get(F.col("keys"), F.col("s.column"))
        counts = hits.groupBy(
            F.col("s.column").alias("column"), F.col("s.target").alias("target"), F.col("s.fraction").alias("fraction"),
            F.col("s.rank").alias("rank"), F.shiftright(key, shift).alias("prefix"),
        ).agg(F.count("*").alias("n"))
        found = _found(counts, "column", "target")
    side = lambda s: F.max(F.when(F.col("target") % 2 == s, value_of_key(F.col("prefix"))))
    ends = found.groupBy("column", F.floor(F.col("target") / 2).alias("k"), "fraction").agg(side(0).alias("low"), side(1).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.col("low") + (F.col("high") - F.col("low")) * F.col("fraction"))
    name = reduce(lambda acc, i: acc.when(F.col("column") == i, columns[i]), range(len(columns)), F.when(F.lit(False), ""))
    each = ends.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("k", between.alias("q")))).alias("qs"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct(name.alias("name"), F.col("qs.q").alias("q"))))).scalar()


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], digit: int = DIGIT
) -> list[float | None]:
    """The quantiles of one column themselves; runs the plan."""
    found = df.sparkSession.range(1).select(F.try_element_at(exact_quantiles_of(df, [column], probs, digit), F.lit(column)))
    return found.first()[0] or [None] * len(probs)
