"""Session, package and dataset statistics. Every group combines map-side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MODEL_BERT, MODEL_LSTM, MODEL_PACKAGES
from ..functions.text import package_directory, strip_comments, strip_whitespace
from .quantiles import exact_quantiles_of
from .skew import salted_join


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def session_summary(
    results: DataFrame, mode: str = "both", is_bert: bool = False, is_ml: bool = False
) -> DataFrame:
    """One log row per session from ``(session_id, is_vulnerable, is_malicious, analysis_time)``.

    Rows without either flag were not scored: they count as input, not as results.
    """
    if mode not in ("both", "vul", "mal"):
        raise ValueError(f"unknown mode: {mode}")
    vul, mal = "coalesce(is_vulnerable, false)", "coalesce(is_malicious, false)"
    scored = "(is_vulnerable IS NOT NULL OR is_malicious IS NOT NULL)"
    found = {"mal": mal, "vul": vul, "both": f"({vul} OR {mal})"}[mode]
    counted = results.groupBy("session_id").agg(
        F.expr("count(*)").alias("input_files"),
        F.expr(f"count_if({scored})").alias("total_files"),
        F.expr(f"count_if({scored} AND NOT {found})").alias("safe_files"),
        F.expr(f"count_if({vul})" if mode != "mal" else "0L").alias("vulnerable_files"),
        F.expr(f"count_if({mal})" if mode != "vul" else "0L").alias("malicious_files"),
        F.expr(f"coalesce(sum(analysis_time) FILTER (WHERE {scored}), 0D)").alias(
            "analysis_duration"
        ),
    )
    return counted.selectExpr(
        "*",
        "input_files - total_files AS skipped_files",
        f"'{MODEL_BERT if is_bert else MODEL_LSTM}' AS analysis_model",
        "vulnerable_files > 0 AS vul_flag",
        "malicious_files > 0 AS mal_flag",
        f"{str(is_bert).lower()} AS is_bert",
        f"{str(mode == 'mal').lower()} AS is_mal",
        f"{str(is_ml).lower()} AS is_ml",
        "vulnerable_files = 0 AND malicious_files = 0 AS is_safe",
    )


def _rate(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0))


def global_stats(log: DataFrame) -> DataFrame:
    """One row: sessions, summed file counts and three rates; zeros for an empty log."""
    counts = ["total_files", "safe_files", "vulnerable_files", "malicious_files"]
    out = log.agg(
        F.count("*").alias("total_sessions"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
    )
    return out.withColumns(
        {
            "malicious_rate": _rate("malicious_files", "total_files"),
            "vulnerable_rate": _rate("vulnerable_files", "total_files"),
            "safe_rate": _rate("safe_files", "total_files"),
        }
    )


def _package_counts(packages: DataFrame) -> DataFrame:
    vulnerable = F.coalesce(F.col("lstm_vulnerability_status") == "Vulnerable", F.lit(False))
    malicious = _true("final_malicious_status")
    return packages.groupBy("session_id").agg(
        F.count("*").alias("total_packages"),
        F.count_if(malicious).alias("malicious_packages"),
        F.count_if(vulnerable).alias("vulnerable_packages"),
        F.count_if(~malicious & ~vulnerable).alias("_neither"),
        F.coalesce(F.sum("analysis_time"), F.lit(0.0)).alias("_time"),
    )


def package_summary(packages: DataFrame) -> DataFrame:
    """Per session counts and rates; safe means not malicious."""
    out = _package_counts(packages).withColumn(
        "safe_packages", F.col("total_packages") - F.col("malicious_packages")
    )
    rates = {
        f"{c}_rate": _rate(f"{c}_packages", "total_packages")
        for c in ("malicious", "vulnerable", "safe")
    }
    return out.withColumns(rates).drop("_neither", "_time")


def ml_session_log(packages: DataFrame, legacy: bool = False) -> DataFrame:
    """Session log rows of package runs; ``legacy`` subtracts both counts from the total."""
    out = _package_counts(packages)
    subtracted = F.col("total_packages") - F.col("malicious_packages") - F.col(
        "vulnerable_packages"
    )
    safe = subtracted if legacy else F.col("_neither")
    return out.select(
        "session_id",
        F.lit(MODEL_PACKAGES).alias("analysis_model"),
        F.col("_time").alias("analysis_duration"),
        F.col("total_packages").alias("total_files"),
        safe.alias("safe_files"),
        F.col("vulnerable_packages").alias("vulnerable_files"),
        F.col("malicious_packages").alias("malicious_files"),
        (F.col("vulnerable_packages") > 0).alias("vul_flag"),
        (F.col("malicious_packages") > 0).alias("mal_flag"),
        F.lit(False).alias("is_bert"),
        F.lit(False).alias("is_mal"),
        F.lit(True).alias("is_ml"),
        (safe == F.col("total_packages")).alias("is_safe"),
    )


def run_summary(df: DataFrame) -> DataFrame:
    """Malicious, vulnerable and safe package counts of one run."""
    prediction = F.coalesce(F.col("xgboost_prediction"), F.lit(0))
    return df.agg(
        F.count("*").alias("total_packages"),
        F.count_if(prediction == 1).alias("malicious_packages"),
        F.count_if(F.col("lstm_vulnerability_status") == "Vulnerable").alias(
            "vulnerable_packages"
        ),
        F.count_if(prediction == 0).alias("safe_packages"),
    )


def session_detail(log: DataFrame, results: DataFrame) -> DataFrame:
    """Session header with each of its results, one row per result.

    ``results`` has ``session_id, task, flagged, file_path, file_name, status, probability, label,
    cwe_label, analysis_time``; the list a row belongs to is ``result_list``. The rows stay apart
    instead of one nested value per session, because a session may hold any number of files. A
    session without results keeps one row. ``safe_files`` counts the safe list the mode looks at.
    """
    flagged, scored = _true("flagged"), F.col("flagged").isNotNull()
    which = F.when(F.col("task") == "vul", "vulnerability").otherwise("malicious")
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default)
    safe_word = F.when(flagged, "").when(scored, "Safe").otherwise("Error")
    is_vul = F.col("task") == "vul"
    items = results.select(
        "session_id",
        F.concat(
            which, F.when(flagged, "_results").when(scored, "_safe_results").otherwise("_errors")
        ).alias(
            "result_list"
        ),
        text("file_path", F.lit("")).alias("file_path"),
        text("file_name", F.lit("")).alias("file_name"),
        text("status", safe_word).alias("status"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.when(flagged, text("label", F.lit(""))).alias("label"),
        F.when(is_vul, text("cwe_label", safe_word)).alias("cwe_label"),
        F.coalesce("analysis_time", F.lit(0.0)).alias("analysis_time"),
    )
    safe = results.groupBy("session_id").agg(
        F.count("*").alias("_items"),
        F.count_if(scored & ~flagged & (F.col("task") == "vul")).alias("_vul_safe"),
        F.count_if(scored & ~flagged & (F.col("task") == "mal")).alias("_mal_safe"),
    )
    counted = F.when(_true("is_mal"), F.col("_mal_safe")).otherwise(F.col("_vul_safe"))
    computed = F.when(_true("is_ml"), F.col("safe_files")).otherwise(
        F.coalesce(counted, F.lit(0))
    )
    header = (
        log.join(safe, "session_id", "left")
        .withColumn("safe_files", computed)
        .withColumn("upload_time", iso_timestamp(F.col("upload_time")))
        .drop("_vul_safe", "_mal_safe")
    )
    # The rows of a large session are spread; sessions without results need no join.
    with_items = salted_join(items, header.drop("_items"), "session_id")
    without = header.filter("_items IS NULL").drop("_items")
    return with_items.unionByName(without, allowMissingColumns=True)


def iso_timestamp(col: Column) -> Column:
    """ISO text; the fraction is written only when there is one."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_trunc("second", col) == col, whole).otherwise(fraction)


def merge_package_source(files: DataFrame) -> DataFrame:
    """Comment-free source of each package in path order: ``(package, part, path, code)``.

    One row per file with code, whatever the size of the package: its merged text is the rows'
    ``code`` by ``part``, so no task has to hold a package. Parts are numbered on the paths alone and
    joined back; texts stay where they are but for that join. A path occurs once.

    Whether code is left is told without stripping where a text begins with anything but a comment or
    a quote, since nothing before the first mark is ever removed.
    """
    content = F.col("content")
    first = F.substring(F.regexp_extract(content, r"(?U)^\s*(\S)", 1), 1, 1)
    kept = F.when(~first.isin("#", "'", '"', ""), True).otherwise(strip_whitespace(strip_comments(content)) != "")
    files = files.select(package_directory(F.col("path")).alias("package"), "path", "content")
    order = Window.partitionBy("package").orderBy("path")
    numbered = files.filter(kept).select("package", "path", (F.row_number().over(order) - 1).alias("part"))
    whole = files.select("package", "path", strip_comments(content).alias("code"))
    return whole.join(numbered, ["package", "path"]).select("package", "part", "path", "code")


def download_counts(log: DataFrame, project: str = "project") -> DataFrame:
    return log.groupBy(F.col(project).alias("project")).agg(F.count("*").alias("downloads"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share per label, and the smallest class count.

    The totals are scalar subqueries over the per-label counts.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.select(F.struct(F.sum("n").alias("total"), F.min("n").alias("least"))).scalar()
    return counts.select(
        "label", "n", (F.col("n") / totals["total"]).alias("share"), totals["least"].alias("min_n")
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency, scaled so that the weights average 1."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.select(
        F.struct(F.sum(1.0 / F.col("n")).alias("inverse"), F.count("*").alias("k"))
    ).scalar()
    weight = (1.0 / F.col("n")) / totals["inverse"] * totals["k"]
    return counts.select("label", "n", weight.alias("weight"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls, from a single pass."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return row.unpivot([], list(df.columns), "column", "nulls")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, nulls, distinct top value with frequency, and for numbers the
    mean, deviation, minimum, quartiles and maximum."""
    columns = list(columns or df.columns)
    numeric = [
        f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.NumericType)
    ]
    stats = df.agg(
        *[F.struct(
            F.count(c).alias("n"),
            (F.avg(c) if c in numeric else F.lit(None).cast("double")).alias("mean"),
            (F.stddev(c) if c in numeric else F.lit(None).cast("double")).alias("sd"),
            (F.min(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("min"),
            (F.max(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("max"),
        ).alias(c) for c in columns]
    ).unpivot([], columns, "column", "s").select("column", "s.*")

    frequencies = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .filter("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("m"))
        .select("column", F.col("m.value").alias("top"), (-F.col("m.neg")).alias("freq"))
    )
    out = stats.join(frequencies, "column", "left")
    missing = F.lit(None).cast("array<double>")
    quartiles = (
        F.try_element_at(exact_quantiles_of(df, numeric, (0.25, 0.5, 0.75)), F.col("column"))
        if numeric else missing
    )
    out = out.withColumn("_q", quartiles)
    return out.withColumns({name: F.get("_q", i) for i, name in enumerate(("q25", "q50", "q75"))}).drop("_q")


def timing_stats(results: DataFrame, *keys: str) -> DataFrame:
    """Total and mean time; 0 when there are no files."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("analysis_time"), F.lit(0.0)).alias("total_time"),
        F.coalesce(F.try_divide(F.sum("analysis_time"), F.count("*")), F.lit(0.0)).alias(
            "mean_time"
        ),
    )


def malicious_ratio(df: DataFrame, prediction: str = "xgboost_prediction") -> DataFrame:
    malicious = F.count_if(F.col(prediction) == 1)
    total = F.count("*")
    return df.agg(
        total.alias("total"),
        malicious.alias("malicious"),
        (total - malicious).alias("normal"),
        F.round(F.coalesce(F.try_divide(malicious * 100.0, total), F.lit(0.0)), 2).alias("ratio"),
    )


def verdict_share(log: DataFrame, flagged: str = "vulnerable_files") -> DataFrame:
    """Flagged files in percent with one decimal, 0 for an empty session."""
    return log.withColumn("share", F.round(_rate(flagged, "total_files"), 1))


def files_per_package(packages: DataFrame, files: DataFrame) -> DataFrame:
    """``.py`` files per listed package, 0 for packages without any."""
    counts = (
        files.filter(F.col("path").endswith(".py"))
        .groupBy("package")
        .agg(F.count("*").alias("_n"))
    )
    out = packages.join(counts, "package", "left")
    return out.withColumn("n_files", F.coalesce("_n", F.lit(0))).drop("_n")
