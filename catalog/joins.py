"""Joins."""

from pyspark.sql import functions as F

from vetloom.operators import joins as op

from .registry import LOG, VERDICTS, query

CODED = """coded AS (
  SELECT package, CASE vulnerability_status WHEN 'Vulnerable' THEN 1 WHEN 'Not Vulnerable' THEN 0
      WHEN 'Error' THEN -1 END AS vs,
    CASE WHEN cwe_label = 'Benign' THEN 0 WHEN cwe_label = 'parsing_error' THEN -1 ELSE 1 END AS cw,
    confidence FROM verdicts),
joined AS (
  SELECT p.*, ln(1e0 + coalesce(download, 0)) AS download_log, coalesce(vs, 0) AS vs,
    coalesce(cw, 0) AS cw, coalesce(confidence, 0e0) AS confidence
  FROM packages p LEFT JOIN coded ON p.name = coded.package)"""
THREAT = "CASE WHEN vs = 1 AND cw = 1 THEN 2 WHEN vs = 1 OR cw = 1 THEN 1 ELSE 0 END"


def with_log(t):
    return t.packages.withColumn(
        "download_log", F.log1p(F.coalesce("download", F.lit(0)).cast("double"))
    )


@query("join_code_verdicts", f"""
WITH {VERDICTS}, {CODED}
SELECT name, vs AS vulnerability_status_numeric, cw AS cwe_label_numeric, confidence,
  vs AS vulnerability_status_noisy, cw AS cwe_label_noisy, {THREAT} AS threat_level_noisy,
  round(download_log, 6) AS download_log_noisy FROM joined""")
def join_code_verdicts(t):
    out = op.join_code_verdicts(with_log(t), t.verdicts)
    return out.select(
        "name", "vulnerability_status_numeric", "cwe_label_numeric", "confidence",
        "vulnerability_status_noisy", "cwe_label_noisy", "threat_level_noisy", "download_log_noisy",
    )


@query("comprehensive_results", f"""
WITH {VERDICTS}
SELECT name, p_partkey % 2 AS xgboost_prediction, vulnerability_status AS lstm_vulnerability_status,
  v.cwe_label AS lstm_cwe_label, v.confidence AS lstm_confidence, summary, version, download,
  p_partkey, author_email FROM packages p LEFT JOIN verdicts v ON p.name = v.package""")
def comprehensive_results(t):
    df = t.packages.withColumn("is_malicious", F.col("p_partkey") % 2)
    return op.comprehensive_results(df, t.verdicts)


@query("attach_labels", f"""
WITH {VERDICTS}, main AS (SELECT name AS package, download FROM packages WHERE download IS NOT NULL)
SELECT package, download, vulnerability_status, cwe_label FROM main LEFT JOIN verdicts USING (package)""")
def attach_labels(t):
    main = t.packages.select(F.col("name").alias("package"), "download").filter(
        "download IS NOT NULL"
    )
    return op.attach_labels(main, t.verdicts)


@query("keep_common", """
SELECT 'left' AS side, c_custkey AS id, c_mktsegment AS word FROM customer
  WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'right', s_suppkey, s_name FROM supplier
  WHERE s_nationkey IN (SELECT c_nationkey FROM customer)""")
def keep_common(t):
    a = t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("k"))
    b = t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").alias("k"))
    left, right = op.keep_common(a, b, "k")
    return left.select(
        F.lit("left").alias("side"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("word")
    ).union(right.select(F.lit("right"), "s_suppkey", "s_name"))


@query("session_results", f"""
WITH {LOG}, routed AS (
  SELECT session_id, file_path, coalesce(is_vulnerable, false) AS flagged FROM results)
SELECT session_id, total_files, is_safe, file_path, flagged FROM log JOIN routed USING (session_id)""")
def session_results(t):
    from .stats import log

    results = t.results.select(
        "session_id", "file_path", F.coalesce("is_vulnerable", F.lit(False)).alias("flagged")
    )
    return op.session_results(log(t).select("session_id", "total_files", "is_safe"), results)


@query("download_fallback", f"""
WITH {VERDICTS}, a AS (SELECT name AS project, CASE WHEN p_partkey % 3 = 0 THEN -1
    ELSE p_partkey * 10 END AS downloads FROM packages WHERE p_partkey % 2 = 0),
b AS (SELECT name AS project, CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_partkey END AS downloads
  FROM packages WHERE p_partkey % 5 <> 0)
SELECT p.name, coalesce(nullif(a.downloads, -1), nullif(b.downloads, -1), 0) AS download
FROM packages p LEFT JOIN a ON p.name = a.project LEFT JOIN b ON p.name = b.project""")
def download_fallback(t):
    key, name = F.col("p_partkey"), F.col("name").alias("project")
    first = t.packages.filter("p_partkey % 2 = 0").select(
        name, F.when(key % 3 == 0, -1).otherwise(key * 10).alias("downloads")
    )
    second = t.packages.filter("p_partkey % 5 <> 0").select(
        name, F.when(key % 9 == 0, -1).otherwise(key).alias("downloads")
    )
    return op.download_fallback(t.packages.select("name"), first, second)

