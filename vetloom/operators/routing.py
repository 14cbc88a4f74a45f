"""Routing of verdicts to result tables, reasons and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    MALICIOUS_REASONS,
    NO_REASON,
    NORMAL_REASONS,
    REPORT_MALICIOUS,
    REPORT_NORMAL,
    REPORT_PACKAGE_MARK,
    REPORT_RATIO,
    REPORT_REASON_MARK,
    REPORT_TITLE,
    REPORT_TOTAL,
    STATUS_MALICIOUS,
    STATUS_NORMAL,
)
from .aggregates import malicious_ratio


def route_verdicts(results: DataFrame, engine: str, mode: str = "both") -> DataFrame:
    """One row per file and task, with the columns all result tables share.

    ``engine``, ``task`` and ``verdict`` name the table and are the partition columns of the store.
    A file without a flag was not scored: its verdict is ``vul_error`` or ``mal_error``, its status
    ``Error`` and its flag stays null, so that no safe table holds it and logs count it as skipped.
    Both tasks come from one pass over the row, not from two scans. Needs ``session_id, file_path,
    file_name, file_size, is_vulnerable, vul_prob, cwe_label, is_malicious, mal_prob,
    analysis_time``.
    """

    def row(task: str, flag: str, prob: str, hit: str, cwe: str) -> str:
        def by_flag(on: str, off: str, missing: str) -> str:
            return f"CASE {flag} WHEN true THEN {on} WHEN false THEN {off} ELSE {missing} END"

        verdict = by_flag(f"'{task}'", f"'{task}_safe'", f"'{task}_error'")
        status = by_flag(f"'{hit}'", "'Safe'", "'Error'")
        return f"""named_struct(
            'task', '{task}', 'verdict', {verdict}, 'flagged', {flag}, 'status', {status},
            'probability', if({flag} IS NULL, {prob}, coalesce({prob}, 0D)),
            'label', if({flag}, '{hit}', NULL), 'cwe_label', {cwe})"""

    vul, mal = "is_vulnerable", "is_malicious"
    cwe = f"coalesce(cwe_label, CASE {vul} WHEN true THEN '' WHEN false THEN 'Safe' ELSE 'Error' END)"
    rows = []
    if mode in ("both", "vul"):
        rows.append(row("vul", vul, "vul_prob", "Vulnerable", cwe))
    if mode in ("both", "mal"):
        rows.append(row("mal", mal, "mal_prob", "malicious", "CAST(NULL AS STRING)"))
    if not rows:
        raise ValueError(f"unknown mode: {mode}")
    return results.selectExpr(
        "session_id",
        "file_path",
        "file_name",
        "file_size",
        "analysis_time",
        f"'{engine}' AS engine",
        f"inline(array({', '.join(rows)}))",
    )


def table_rows(routed: DataFrame, engine: str, table: str) -> DataFrame:
    """Columns of one of the eight file result tables, e.g. ``vul`` or ``mal_safe``.

    The filters are on the partition columns, so only that table's folders are read.
    """
    kind = "vulnerability" if table.startswith("vul") else "malicious"
    columns = [
        F.col("status").alias(f"{kind}_status"),
        F.col("probability").alias(f"{kind}_probability"),
    ]
    if not table.endswith("_safe"):
        columns.append(F.col("label").alias(f"{kind}_label"))
    if kind == "vulnerability":
        columns.append(F.col("cwe_label"))
    return routed.filter((F.col("engine") == engine) & (F.col("verdict") == table)).select(
        "session_id", "file_path", "file_name", "file_size", *columns, "analysis_time"
    )


def _reasons(rules: list[tuple[str, bool, str]]) -> Column:
    """Sentences of the rules that hold, in order. A missing flag counts as off.

    The code status is a number: only 1 is on, and only 0 or a missing status is off.
    """
    clauses = []
    for name, wanted, sentence in rules:
        if name == "vulnerability_status_noisy":
            test = f"coalesce(CAST({name} AS INT), 0) = {int(wanted)}"
        else:
            test = f"coalesce(CAST({name} AS INT), 0) {'=' if wanted else '<>'} 1"
        clauses.append(f"CASE WHEN {test} THEN '{sentence}' END")
    return F.expr(f"array_compact(array({', '.join(clauses)}))")


def malicious_reasons() -> Column:
    """Reasons for a flagged package, in report order."""
    return _reasons(MALICIOUS_REASONS)


def normal_reasons() -> Column:
    """Mirrored reasons for a package that was not flagged."""
    return _reasons(NORMAL_REASONS)


def reason_report(df: DataFrame, prediction: str = "is_malicious", name: str = "name") -> DataFrame:
    """Per package: status, name and reason text with a fallback, plus the two report lines."""
    bad = F.coalesce(F.col(prediction) == 1, F.lit(False))
    reasons = F.when(bad, malicious_reasons()).otherwise(normal_reasons())
    out = df.select(
        F.coalesce(F.col(name), F.lit("unknown")).alias("name"),
        F.when(bad, STATUS_MALICIOUS).otherwise(STATUS_NORMAL).alias("status"),
        F.array_join(reasons, " / ").alias("_text"),
    ).withColumn("reasons", F.when(F.col("_text") == "", NO_REASON).otherwise(F.col("_text")))
    lines = F.concat(
        F.col("status"), F.lit(f" {REPORT_PACKAGE_MARK} "), F.col("name"),
        F.lit(f"\n{REPORT_REASON_MARK}"), F.col("reasons"), F.lit("\n"),
    )
    return out.withColumn("value", lines).drop("_text")


def report_header(df: DataFrame, prediction: str = "is_malicious") -> DataFrame:
    """Title and counts as one row of text."""
    def line(template: str, value: Column) -> Column:
        before, after = template.split("{}")
        return F.concat(F.lit(before), value, F.lit(after))

    counts = malicious_ratio(df, prediction)
    lines = [
        F.lit(REPORT_TITLE + "\n"),
        line(REPORT_TOTAL, F.col("total").cast("string")),
        line(REPORT_MALICIOUS, F.col("malicious").cast("string")),
        line(REPORT_NORMAL, F.col("normal").cast("string")),
        line(REPORT_RATIO, F.format_string("%.2f", F.col("ratio"))),
        F.lit(""),
    ]
    return counts.select(F.concat_ws("\n", *lines).alias("value"))


def package_category(df: DataFrame) -> DataFrame:
    """``category`` with malicious before vulnerable before safe, and a threat word."""
    category = (
        F.when(F.coalesce("final_malicious_status", F.lit(False)), "malicious")
        .when(F.col("lstm_vulnerability_status") == "Vulnerable", "vulnerable")
        .otherwise("safe")
    )
    threat = F.when(F.col("threat_level") == 2, "high").when(
        F.col("threat_level") == 1, "medium"
    ).otherwise("low")
    return df.withColumns({"category": category, "threat": threat})


def filter_category(df: DataFrame, category: str) -> DataFrame:
    return df if category == "all" else df.filter(F.col("category") == category)


def package_rows(df: DataFrame, session_id: str | Column) -> DataFrame:
    """Store rows of packages, with defaults for what is missing."""
    session = session_id if isinstance(session_id, Column) else F.lit(session_id)
    has = set(df.columns)

    def pick(name: str, default: object) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit(default)) if name in has else F.lit(default)

    prediction = pick("xgboost_prediction", 0).cast("int")
    columns = {
        "session_id": session,
        "package_name": pick("name", ""),
        "summary": pick("summary", ""),
        "author": pick("author", ""),
        "author_email": pick("author-email", ""),
        "version": pick("version", ""),
        "download_count": pick("download", 0).cast("bigint"),
        "lstm_vulnerability_status": pick("lstm_vulnerability_status", "Not Vulnerable"),
        "lstm_cwe_label": pick("lstm_cwe_label", "N/A"),
        "lstm_confidence": pick("lstm_confidence", 0.0),
        "xgboost_prediction": prediction,
        "xgboost_confidence": pick("xgboost_confidence", 0.0),
        "final_malicious_status": prediction != 0,
        "threat_level": F.when(prediction == 1, 2).otherwise(0),
        "analysis_time": pick("analysis_time", 0.0),
    }
    return df.select(*[c.alias(n) for n, c in columns.items()])
