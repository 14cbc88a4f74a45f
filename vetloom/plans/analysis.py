"""End-to-end plans: files to session log, and packages to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import session_summary
from ..operators.features import package_features
from ..operators.files import drop_empty_content
from ..operators.joins import comprehensive_results, join_code_verdicts
from ..operators.models import predict_packages
from ..operators.routing import package_rows, route_verdicts
from ..operators.scoring import agg_triangular, triangular_weight
from ..operators.windows import char_window_array, char_windows


def triangular_score(probs: str) -> Column:
    """Triangular score of one file whose window probabilities are the array column ``probs``."""
    w = triangular_weight("i", f"size({probs})")
    return F.expr(
        f"""CASE WHEN size({probs}) > 0 THEN 0.7D * aggregate(
              transform({probs}, (p, i) -> named_struct('p', p, 'w', {w})),
              named_struct('s', 0D, 'w', 0D),
              (acc, x) -> named_struct('s', acc.s + x.p * x.w, 'w', acc.w + x.w),
              acc -> acc.s / greatest(acc.w, 1e-8D)) + 0.3D * array_max({probs})
            ELSE 0D END"""
    )


def score_files_in_place(
    files: DataFrame,
    scores: Mapping[str, Callable[[Column], Column]],
    size: int = 512,
    overlap: int = 64,
) -> DataFrame:
    """Add one score per file for each scorer, a function from window text to a column.

    Windows are cut once and stay inside the row of their file, so no score needs a shuffle.
    """
    windows = char_window_array(F.col("content"), size, overlap)
    probs = {f"_{name}": F.transform("_windows", score) for name, score in scores.items()}
    columns = {name: triangular_score(f"_{name}") for name in scores}
    return (
        drop_empty_content(files)
        .withColumn("_windows", windows)
        .withColumns(probs)
        .withColumns(columns)
        .drop("_windows", *probs)
    )


def score_files(
    files: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    probs: Sequence[str] = ("vul_prob", "mal_prob"),
    size: int = 512,
    overlap: int = 64,
) -> DataFrame:
    """One row per file with its scores, for a scorer that adds ``probs`` to a window table.

    All scores come from one cut into windows and one aggregate.
    """
    windows = char_windows(drop_empty_content(files), size, overlap)
    return agg_triangular(scorer(windows), probs=probs)


def file_verdicts(
    files: DataFrame, scores: DataFrame, threshold: float = 0.5, strict: bool = True
) -> DataFrame:
    """File columns without the text, with ``vul_prob, vul_flag, mal_prob, mal_flag``."""
    test = ">" if strict else ">="
    columns = ["file_id"]
    for side in ("vul", "mal"):
        known = f"{side}_prob" in scores.columns
        p = f"{side}_prob" if known else "CAST(NULL AS DOUBLE)"
        columns += [f"{p} AS {side}_prob", f"{p} {test} {threshold}D AS {side}_flag"]
    return files.drop("content").join(scores.selectExpr(*columns), "file_id", "left")


def store_rows(verdicts: DataFrame, engine: str, mode: str = "both") -> DataFrame:
    """Routed result rows of judged files."""
    cwe = "cwe_label" if "cwe_label" in verdicts.columns else "CAST(NULL AS STRING) AS cwe_label"
    time = "analysis_time" if "analysis_time" in verdicts.columns else "0D AS analysis_time"
    shaped = verdicts.selectExpr(
        "session_id",
        "path AS file_path",
        "name AS file_name",
        "size AS file_size",
        "vul_flag AS is_vulnerable",
        "vul_prob",
        cwe,
        "mal_flag AS is_malicious",
        "mal_prob",
        time,
    )
    return route_verdicts(shaped, engine, mode)


def session_log(routed: DataFrame, mode: str = "both", is_bert: bool = False) -> DataFrame:
    """Session log from routed rows: one row per file again, then one per session."""
    per_file = routed.groupBy("session_id", "file_path").agg(
        F.expr("max(flagged) FILTER (WHERE task = 'vul')").alias("is_vulnerable"),
        F.expr("max(flagged) FILTER (WHERE task = 'mal')").alias("is_malicious"),
        F.max("analysis_time").alias("analysis_time"),
    )
    return session_summary(per_file, mode, is_bert)


def analyze_packages(
    meta: DataFrame,
    popular: DataFrame,
    verdicts: DataFrame,
    model: object,
    email: str = "author-email",
) -> DataFrame:
    """Comprehensive package table: features, code verdicts, prediction."""
    features = package_features(meta, popular, email=email)
    joined = join_code_verdicts(features, verdicts, carry=True)
    return comprehensive_results(predict_packages(joined, model), None)


def package_store_rows(results: DataFrame, session_id: str) -> DataFrame:
    return package_rows(results, session_id)
