"""The recorded two-package example, all intermediate values."""

import pytest
from pyspark.sql import functions as F

from vetloom.operators.features import (
    download_log,
    entropy_features,
    minmax_inverted,
    quantile_flags,
    standard_scale,
    summary_features,
)
from vetloom.functions.text import is_valid_version
from vetloom.operators.aggregates import malicious_ratio
from vetloom.operators.joins import comprehensive_results, join_code_verdicts
from vetloom.operators.routing import malicious_reasons, normal_reasons, reason_report, report_header

META = [
    ("pip", "25.2", "The PyPA recommended tool for installing Python packages.", 786419394),
    ("uv", "0.8.15",
     "An extremely fast Python package and project manager, written in Rust.", 557505170),
]
VERDICTS = [
    ("pip", "Vulnerable", "malicious", 0.9682260751724243),
    ("uv", "Not Vulnerable", "Benign", 0.021550118923187256),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(META, "name string, version string, summary string, download bigint")
    df = df.withColumn("download_log", download_log(F.col("download")))
    df = quantile_flags(df, "download_log")
    df = standard_scale(df, "download_log", "download_scaled")
    df = minmax_inverted(df, "download_log", "download_log_scaled")
    df = entropy_features(summary_features(df))
    df = df.withColumn("version_valid", is_valid_version(F.col("version")))
    return df.withColumns({"is_typo_like": F.lit(True), "is_disposable": F.lit(False)})


@pytest.fixture(scope="module")
def verdicts(spark):
    return spark.createDataFrame(
        VERDICTS, "package string, vulnerability_status string, cwe_label string, confidence double"
    )


def by_name(df):
    return {row["name"]: row.asDict() for row in df.collect()}


def test_features(table):
    rows = by_name(table)
    pip, uv = rows["pip"], rows["uv"]
    assert pip["summary_entropy"] == pytest.approx(4.290954656060694, abs=1e-12)
    assert uv["summary_entropy"] == pytest.approx(4.3072573045687665, abs=1e-12)
    assert pip["download_log"] == pytest.approx(20.483000789514467, abs=1e-12)
    assert uv["download_log"] == pytest.approx(20.138982336591855, abs=1e-12)
    assert (pip["download_scaled"], uv["download_scaled"]) == (
        pytest.approx(1.0), pytest.approx(-1.0))
    assert (pip["download_log_scaled"], uv["download_log_scaled"]) == (0.0, 1.0)
    assert (pip["summary_length"], uv["summary_length"]) == (57, 70)
    assert (pip["version_valid"], uv["version_valid"]) == (False, True)
    assert (pip["download_too_low"], pip["download_too_high"]) == (False, True)
    assert (uv["download_too_low"], uv["download_too_high"]) == (True, False)
    for row in (pip, uv):
        assert not (row["summary_too_short"] or row["summary_too_long"] or row["summary_low_entropy"])


def test_joins_and_report(table, verdicts):
    joined = join_code_verdicts(table, verdicts)
    rows = by_name(joined)
    codes = ["vulnerability_status_numeric", "cwe_label_numeric", "threat_level_noisy"]
    assert [rows["pip"][c] for c in codes] == [1, 1, 2]
    assert [rows["uv"][c] for c in codes] == [0, 0, 0]

    judged = joined.withColumn("is_malicious", (F.col("name") == "uv").cast("int"))
    full = comprehensive_results(judged, verdicts)
    assert full.columns[:5] == [
        "name", "xgboost_prediction", "lstm_vulnerability_status", "lstm_cwe_label",
        "lstm_confidence",
    ]
    assert len(full.columns) == len(set(full.columns))
    assert by_name(full)["pip"]["lstm_cwe_label"] == "malicious"

    reasons = by_name(
        judged.select("name", F.size(malicious_reasons()).alias("bad"),
                      F.size(normal_reasons()).alias("good"))
    )
    assert (reasons["pip"]["good"], reasons["uv"]["bad"]) == (5, 2)

    report = by_name(reason_report(judged))
    assert report["pip"]["value"] == (
        "✅ 정상 📦 pip\n→ 판단 이유: 요약 길이 적절함 / 요약이 너무 길지 않음 / "
        "요약이 사람이 작성한 것으로 보임 / 다운로드 수가 충분함 / 신뢰할 수 있는 이메일 사용\n"
    )
    assert report["uv"]["value"] == (
        "❌ 악성 📦 uv\n→ 판단 이유: 다운로드 수가 비정상적으로 낮음 / "
        "인기 패키지 이름과 유사한 오타 기반 이름\n"
    )
    head = report_header(judged).first()["value"]
    assert head.split("\n")[2:6] == [
        "총 분석 패키지 수: 2", "악성 패키지: 1개", "정상 패키지: 1개", "악성 비율: 50.00%"
    ]
    assert malicious_ratio(full).first().asDict() == {
        "total": 2, "malicious": 1, "normal": 1, "ratio": 50.0
    }
