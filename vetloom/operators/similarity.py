"""Edit-distance-one join between package names and popular names.

Two different names are one edit apart exactly when they agree after deleting the character at one
common position (substitution), or when one equals the other minus a character. Keying the join on
the edit kind, the position and the remaining text therefore yields the answer itself: no candidate
is produced that has to be thrown away, and the rows per key are bounded by the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import core_name
from .skew import salted_join


def _deletions(name: Column) -> Column:
    """(position, text without that character) for every position; empty for an empty name."""
    at = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name)))
    cut = lambda i: F.concat(
        F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))
    )
    pieces = F.transform(at, lambda i: F.struct(i.alias("at"), cut(i).alias("rest")))
    empty = F.array().cast("array<struct<at:int,rest:string>>")
    return F.coalesce(pieces, empty)


def _keys(names: DataFrame, longer: str, shorter: str) -> DataFrame:
    """One row per join key; ``longer``/``shorter`` tag who loses a character in an indel."""
    pieces = _deletions(F.col("core"))
    key = lambda kind, at, rest: F.struct(
        F.lit(kind).alias("kind"), at.alias("at"), rest.alias("rest")
    )
    zero = F.lit(0)
    substitutions = F.transform("_pieces", lambda p: key("sub", p["at"], p["rest"]))
    dropped = F.array_distinct(F.transform("_pieces", lambda p: key(longer, zero, p["rest"])))
    whole = F.array(key(shorter, zero, F.col("core")))
    return (
        names.withColumn("_pieces", pieces)
        .select("core", F.explode(F.concat(substitutions, dropped, whole)).alias("k"))
        .select("core", "k.*")
    )


def core_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(core, popular_core)`` at edit distance exactly one."""
    a = _keys(left.select("core").distinct(), "left_longer", "right_longer")
    b = _keys(right.select("core").distinct(), "right_longer", "left_longer")
    b = b.withColumnRenamed("core", "popular_core")
    return a.join(b, ["kind", "at", "rest"]).filter("core <> popular_core").select(
        "core", "popular_core"
    )


def _cores(df: DataFrame, name: str) -> DataFrame:
    return df.select(core_name(F.col(name)).alias("core")).filter("core IS NOT NULL")


def typosquat_pairs(
    packages: DataFrame, popular: DataFrame, name: str = "name", project: str = "project"
) -> DataFrame:
    """Package name, its core name and every popular core name one edit away."""
    pairs = core_pairs(_cores(packages, name), _cores(popular, project))
    named = packages.select(F.col(name), core_name(F.col(name)).alias("core"))
    return salted_join(named, pairs, "core", measured=_cores(packages, name))


def typosquat_flag(
    packages: DataFrame,
    popular: DataFrame,
    name: str = "name",
    project: str = "project",
    out: str = "is_typo_like",
    measured: DataFrame | None = None,
) -> DataFrame:
    """True when any popular core name is one edit away; an equal name is no hit.

    Hot core names are told from ``measured``, by default ``packages``.
    """
    hits = core_pairs(_cores(packages, name), _cores(popular, project))
    hits = hits.select("core").distinct().withColumn(out, F.lit(True))
    named = packages.withColumn("core", core_name(F.col(name)))
    return (
        salted_join(named, hits, "core", "left", measured=_cores(packages if measured is None else measured, name))
        .withColumn(out, F.coalesce(out, F.lit(False)))
        .drop("core")
    )
