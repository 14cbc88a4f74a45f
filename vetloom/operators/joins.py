"""Equi-joins of packages, verdicts, labels, sessions and downloads.

No side is force-broadcast: Spark broadcasts a side only after its own size check, and otherwise
runs a sort-merge join whose hot partitions are split at run time. Each outer join keeps the large
table on the preserved side, which is the side that can be split. Where the other table is itself
an aggregate by the join key, ``salted`` spreads the rows of hot keys instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CWE_CODES, CWE_OTHER_CODE, PRIORITY_COLUMNS, STATUS_CODES
from ..functions.text import map_labels
from .features import threat_level
from .files import reorder_columns
from .skew import salted_join


#: Verdict columns as the comprehensive table names them.
LSTM_COLUMNS = {
    "vulnerability_status": "lstm_vulnerability_status",
    "cwe_label": "lstm_cwe_label",
    "confidence": "lstm_confidence",
}


def _with(facts: DataFrame, dimension: DataFrame, key: str, salted: bool) -> DataFrame:
    return salted_join(facts, dimension, key, "left") if salted else facts.join(dimension, key, "left")


def join_code_verdicts(
    meta: DataFrame, verdicts: DataFrame, salted: bool = False, carry: bool = False
) -> DataFrame:
    """Numeric code verdicts next to each package; a package without one gets 0, 0 and 0.0.

    With ``carry`` the verdicts come along as written (``lstm_*``), so that
    ``comprehensive_results`` needs no second join with the same table.
    """
    coded = verdicts.select(
        F.col("package").alias("name"),
        F.col("package"),
        *[F.col(c).alias(n) for c, n in LSTM_COLUMNS.items() if carry],
        map_labels(F.col("vulnerability_status"), STATUS_CODES).alias(
            "vulnerability_status_numeric"
        ),
        map_labels(F.col("cwe_label"), CWE_CODES, CWE_OTHER_CODE).alias("cwe_label_numeric"),
        F.col("confidence"),
    )
    out = _with(meta, coded, "name", salted).na.fill(
        {"vulnerability_status_numeric": 0, "cwe_label_numeric": 0, "confidence": 0.0}
    )
    status, cwe = F.col("vulnerability_status_numeric"), F.col("cwe_label_numeric")
    return out.withColumns(
        {
            "vulnerability_status_noisy": status,
            "cwe_label_noisy": cwe,
            "threat_level_noisy": threat_level(status, cwe),
            "download_log_noisy": F.col("download_log"),
        }
    )


def comprehensive_results(
    df: DataFrame, verdicts: DataFrame | None, prediction: str = "is_malicious", salted: bool = False
) -> DataFrame:
    """Verdict columns as ``lstm_*``, the prediction renamed, priority columns first.

    Without ``verdicts`` the ``lstm_*`` columns are those that ``df`` has already.
    """
    out = df
    if verdicts is not None:
        renamed = verdicts.select(
            F.col("package").alias("name"), *[F.col(c).alias(n) for c, n in LSTM_COLUMNS.items()]
        )
        out = _with(df, renamed, "name", salted)
    out = out.withColumnRenamed(prediction, "xgboost_prediction")
    return reorder_columns(out, PRIORITY_COLUMNS)


def attach_labels(
    main: DataFrame,
    extra: DataFrame,
    key: str = "package",
    columns: Sequence[str] = ("vulnerability_status", "cwe_label"),
    salted: bool = False,
) -> DataFrame:
    return _with(main, extra.select(key, *columns), key, salted)


def keep_common(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each side whose key occurs on both sides; duplicates stay."""
    return left.join(right, key, "left_semi"), right.join(left, key, "left_semi")


def session_results(log: DataFrame, results: DataFrame) -> DataFrame:
    """Every result row with its session's columns.

    One session may hold a large part of all results, and its log row is often an aggregate by
    session, so the results of such sessions are dealt out.
    """
    return salted_join(results, log, "session_id")


def download_fallback(
    packages: DataFrame,
    first: DataFrame,
    second: DataFrame,
    name: str = "name",
    salted: bool = True,
) -> DataFrame:
    """Downloads from the first source, else the second, else 0; -1 means missing.

    A project with several count rows has the largest of them, so no package row is multiplied.
    """
    out = packages
    for i, source in enumerate((first, second)):
        count = source.groupBy(F.col("project").alias(name)).agg(
            F.max(F.nullif(F.col("downloads"), F.lit(-1))).alias(f"_d{i}")
        )
        out = salted_join(out, count, name, "left", measured=packages) if salted else out.join(count, name, "left")
    return out.withColumn("download", F.coalesce("_d0", "_d1", F.lit(0))).drop("_d0", "_d1")
