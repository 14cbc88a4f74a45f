"""Routing, reasons and reports."""

from pyspark.sql import functions as F

from vetloom.constants import (
    MALICIOUS_REASONS,
    NO_REASON,
    NORMAL_REASONS,
    STATUS_MALICIOUS,
    STATUS_NORMAL,
)
from vetloom.operators import routing as op
from vetloom.operators.features import package_features

from .packages import FEATURES
from .registry import PKG_ROWS, ROUTED, query


def routed(t):
    return op.route_verdicts(t.results, "lstm", "both")


@query("route_verdicts", f"WITH {ROUTED} SELECT * FROM routed")
def route_verdicts(t):
    return routed(t)


@query("route_verdicts_mal", f"WITH {ROUTED} SELECT * FROM routed WHERE task = 'mal'")
def route_verdicts_mal(t):
    return op.route_verdicts(t.results, "lstm", "mal")


def table_query(table: str):
    kind = "vulnerability" if table.startswith("vul") else "malicious"
    extra = "" if table.endswith("_safe") else f", label AS {kind}_label"
    cwe = ", cwe_label" if kind == "vulnerability" else ""

    @query(f"table_rows_{table}", f"""
WITH {ROUTED} SELECT session_id, file_path, file_name, file_size, status AS {kind}_status,
  probability AS {kind}_probability{extra}{cwe}, analysis_time FROM routed
WHERE verdict = '{table}'""")
    def run(t):
        return op.table_rows(routed(t), "lstm", table)


for _table in ("vul", "vul_safe", "mal", "mal_safe"):
    table_query(_table)


# Features with an invented prediction and code status.
JUDGED = FEATURES + """, judged AS (
  SELECT *, CAST(p_partkey % 3 = 0 AS INTEGER) AS is_malicious,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 4 - 1 AS INTEGER) END
      AS vulnerability_status_noisy FROM features)"""


def judged(t):
    key = F.col("p_partkey")
    return package_features(t.packages, t.popular).withColumns(
        {
            "is_malicious": (key % 3 == 0).cast("int"),
            "vulnerability_status_noisy": F.when(key % 5 != 0, (key % 4 - 1).cast("int")),
        }
    )


def reasons_sql(rules) -> str:
    clauses = []
    for name, wanted, sentence in rules:
        if name == "vulnerability_status_noisy":
            test = f"{name} = 1" if wanted else f"coalesce({name}, 0) = 0"
        else:
            test = name if wanted else f"NOT {name}"
        clauses.append(f"CASE WHEN {test} THEN '{sentence}' END")
    return f"concat_ws(' / ', {', '.join(clauses)})"


BAD, GOOD = reasons_sql(MALICIOUS_REASONS), reasons_sql(NORMAL_REASONS)


@query("malicious_reasons", f"""
WITH {JUDGED} SELECT p_partkey, {BAD} AS reasons FROM judged WHERE is_malicious = 1""")
def malicious_reasons(t):
    df = judged(t).filter("is_malicious = 1")
    return df.select("p_partkey", F.array_join(op.malicious_reasons(), " / ").alias("reasons"))


@query("normal_reasons", f"""
WITH {JUDGED} SELECT p_partkey, {GOOD} AS reasons FROM judged WHERE is_malicious = 0""")
def normal_reasons(t):
    df = judged(t).filter("is_malicious = 0")
    return df.select("p_partkey", F.array_join(op.normal_reasons(), " / ").alias("reasons"))


@query("reason_report", f"""
WITH {JUDGED}, r AS (SELECT name,
  CASE WHEN is_malicious = 1 THEN '{STATUS_MALICIOUS}' ELSE '{STATUS_NORMAL}' END AS status,
  coalesce(nullif(CASE WHEN is_malicious = 1 THEN {BAD} ELSE {GOOD} END, ''), '{NO_REASON}')
    AS reasons FROM judged)
SELECT name, status, reasons, concat(status, ' 📦 ', name, chr(10), '→ 판단 이유: ', reasons, chr(10))
  AS value FROM r""")
def reason_report(t):
    return op.reason_report(judged(t))


@query("report_header", f"""
WITH {PKG_ROWS}, c AS (SELECT count(*) AS n, sum(xgboost_prediction) AS m FROM pkg_rows)
SELECT concat('=== Python 패키지 보안 분석 최종 리포트 ===', chr(10), chr(10), '총 분석 패키지 수: ', n,
  chr(10), '악성 패키지: ', m, '개', chr(10), '정상 패키지: ', n - m, '개', chr(10), '악성 비율: ',
  printf('%.2f', round(m * 1e2 / n, 2)), '%', chr(10)) AS value FROM c""")
def report_header(t):
    return op.report_header(t.pkg_rows, "xgboost_prediction")


CATEGORY = PKG_ROWS + """, c AS (SELECT *, CASE WHEN final_malicious_status THEN 'malicious'
    WHEN lstm_vulnerability_status = 'Vulnerable' THEN 'vulnerable' ELSE 'safe' END AS category,
  CASE threat_level WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS threat FROM pkg_rows)"""


@query("package_category", f"WITH {CATEGORY} SELECT package_name, category, threat FROM c")
def package_category(t):
    return op.package_category(t.pkg_rows).select("package_name", "category", "threat")


@query("filter_category", f"""
WITH {CATEGORY} SELECT package_name, category FROM c WHERE category = 'vulnerable'""")
def filter_category(t):
    df = op.filter_category(op.package_category(t.pkg_rows), "vulnerable")
    return df.select("package_name", "category")


@query("package_rows", """
SELECT 's1' AS session_id, p_name AS package_name, '' AS summary, p_brand AS author,
  '' AS author_email, coalesce(nullif(p_type, 'SMALL'), '') AS version,
  CAST(p_size AS BIGINT) AS download_count, 'Not Vulnerable' AS lstm_vulnerability_status,
  'N/A' AS lstm_cwe_label, p_size / 1e2 AS lstm_confidence, p_size % 2 AS xgboost_prediction,
  0e0 AS xgboost_confidence, p_size % 2 = 1 AS final_malicious_status,
  CASE WHEN p_size % 2 = 1 THEN 2 ELSE 0 END AS threat_level, 0e0 AS analysis_time FROM part""")
def package_rows(t):
    df = t.part.select(
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("author"),
        F.nullif("p_type", F.lit("SMALL")).alias("version"),
        F.col("p_size").alias("download"),
        (F.col("p_size") / F.lit(1e2)).alias("lstm_confidence"),
        (F.col("p_size") % 2).alias("xgboost_prediction"),
    )
    return op.package_rows(df, "s1")
