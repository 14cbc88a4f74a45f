"""Package features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    PACKAGE_FEATURES,
    SUMMARY_MAX_LENGTH,
    SUMMARY_MIN_ENTROPY,
    SUMMARY_MIN_LENGTH,
)
from ..functions.text import email_domain, is_valid_version, shannon_entropy
from .quantiles import exact_quantiles_of
from .similarity import typosquat_flag
from .skew import salted_join


def summary_features(df: DataFrame, summary: str = "summary") -> DataFrame:
    text = F.coalesce(F.col(summary), F.lit(""))
    return df.withColumns({summary: text, "summary_length": F.length(text)}).withColumns(
        {
            "summary_too_short": F.col("summary_length") < SUMMARY_MIN_LENGTH,
            "summary_too_long": F.col("summary_length") > SUMMARY_MAX_LENGTH,
        }
    )


def entropy_features(df: DataFrame, summary: str = "summary") -> DataFrame:
    df = df.withColumn("summary_entropy", shannon_entropy(F.coalesce(F.col(summary), F.lit(""))))
    return df.withColumn("summary_low_entropy", F.col("summary_entropy") < SUMMARY_MIN_ENTROPY)


def download_log(col: Column, raw: bool = False) -> Column:
    """``log1p`` of the count, or the count itself under ``raw``; null counts as 0."""
    count = F.coalesce(col, F.lit(0)).cast("double")
    return count if raw else F.log1p(count)


def standard_scale(df: DataFrame, column: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Centre and divide by the population deviation; a constant column is only centred.

    The statistics (of ``source``, by default ``df``) are one aggregate row, read as a scalar subquery:
    no join is planned.
    """
    stats = (df if source is None else source).select(column).select(
        F.struct(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))
    ).scalar()
    divisor = F.when(stats["sd"] > 0, stats["sd"]).otherwise(1.0)
    return df.withColumn(out, (F.col(column) - stats["mean"]) / divisor)


def minmax_inverted(df: DataFrame, column: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """1 for the smallest value (of ``source``, by default ``df``), 0 for the largest, 1 for a constant column."""
    stats = (df if source is None else source).select(column).select(
        F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ).scalar()
    scaled = F.try_divide(F.col(column) - stats["lo"], stats["hi"] - stats["lo"])
    return df.withColumn(
        out, F.when(F.col(column).isNotNull(), 1.0 - F.coalesce(scaled, F.lit(0.0)))
    )


def quantile_flags(
    df: DataFrame,
    column: str,
    low: str = "download_too_low",
    high: str = "download_too_high",
    probs: Sequence[float] = (0.05, 0.95),
    source: DataFrame | None = None,
) -> DataFrame:
    """Flags for values outside the two quantiles, which are a scalar subquery of the plan.

    The quantiles are those of ``source``, by default ``df``: the rows before joins that leave them as they are.
    """
    ends = F.try_element_at(exact_quantiles_of(df if source is None else source, [column], probs), F.lit(column))
    marked = df.withColumn("_ends", ends)
    flags = {low: F.col(column) < F.col("_ends")[0], high: F.col(column) > F.col("_ends")[1]}
    return marked.withColumns(flags).drop("_ends")


def disposable_email_flag(
    df: DataFrame, blocklist: DataFrame | None = None, email: str = "author_email"
) -> DataFrame:
    """True when the mail domain is listed; without a list the flag is constantly false."""
    if blocklist is None:
        return df.withColumn("is_disposable", F.lit(False))
    listed = blocklist.select(F.lower(F.trim("domain")).alias("_domain")).filter(
        "_domain <> ''"
    ).distinct().withColumn("_listed", F.lit(True))
    mailed = df.withColumn("_domain", F.lower(email_domain(F.col(f"`{email}`"))))
    return (
        salted_join(mailed, listed, "_domain", "left")
        .withColumn("is_disposable", F.coalesce("_listed", F.lit(False)))
        .drop("_domain", "_listed")
    )


def threat_level(status: Column, cwe: Column) -> Column:
    """2 when both flags are set, 1 for one of them, else 0."""
    return (
        F.when((status == 1) & (cwe == 1), 2).when((status == 1) | (cwe == 1), 1).otherwise(0)
    )


def _uniform(key: Column, start: int) -> Column:
    """A number between 0 and 1 from 12 hex digits of the key's MD5."""
    digits = F.conv(F.substring(F.md5(key), start, 12), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 48)


def add_noise(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], sd: float = 0.05, seed: int = 42
) -> DataFrame:
    """Gaussian noise into ``<col>_noisy``; ``sd=0`` makes plain copies, as at inference.

    The noise of a row follows from its ``key`` columns and the seed (Box and Muller over two hashed
    uniforms), so a task that runs again, another order and another partitioning give the same.
    """
    named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    noisy = {}
    for i, name in enumerate(columns):
        base = F.col(name).cast("double")
        mark = F.concat(named, F.lit(f"|{seed + i}")).cast("binary")
        normal = F.sqrt(-2.0 * F.ln(_uniform(mark, 1))) * F.cos(2.0 * math.pi * _uniform(mark, 13))
        noisy[f"{name}_noisy"] = base if sd == 0 else base + sd * normal
    return df.withColumns(noisy)


def assemble_features(
    df: DataFrame, features: Sequence[str] = tuple(PACKAGE_FEATURES), out: str = "features"
) -> DataFrame:
    """Feature vector in the given order; a feature the table lacks is 0."""
    missing = {c: F.lit(0) for c in features if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    numeric = {f"_f{i}": F.col(c).cast("double") for i, c in enumerate(features)}
    assembler = VectorAssembler(inputCols=list(numeric), outputCol=out, handleInvalid="keep")
    return assembler.transform(df.withColumns(numeric)).drop(*numeric)


def low_download_typo_score(scaled: Column, typo: Column) -> Column:
    return (1.0 - scaled) * typo.cast("int")


def package_features(
    meta: DataFrame,
    popular: DataFrame,
    blocklist: DataFrame | None = None,
    email: str = "author_email",
) -> DataFrame:
    """All metadata features of packages that carry name, summary, version and download."""
    df = meta.withColumn("download", F.coalesce("download", F.lit(0)).cast("bigint"))
    df = df.withColumn("download_log", download_log(F.col("download")))
    # Statistics read one column of the scan and no join; they enter behind the joins, whose plans stay small.
    source = df.select("download_log")
    df = entropy_features(summary_features(df))
    df = df.withColumn("version_valid", is_valid_version(F.col("version")))
    df = disposable_email_flag(df, blocklist, email)
    df = typosquat_flag(df, popular, measured=meta)
    df = quantile_flags(df, "download_log", source=source)
    df = standard_scale(df, "download_log", "download_scaled", source)
    return minmax_inverted(df, "download_log", "download_log_scaled", source)
