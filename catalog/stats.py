"""Aggregations, sorts, pages and set operations."""

from pyspark.sql import functions as F

from vetloom.operators import aggregates as op
from vetloom.operators import ordering as order

from .registry import FILES, LOG, PACKAGES, PKG_ROWS, RESULTS, ROUTED, query


def log(t):
    return op.session_summary(t.results)


LOG_COLUMNS = """session_id, input_files, total_files, safe_files, vulnerable_files, malicious_files,
  round(analysis_duration, 6) AS analysis_duration, skipped_files, analysis_model, vul_flag, mal_flag,
  is_bert, is_mal, is_ml, is_safe"""


@query("session_summary", f"WITH {LOG} SELECT {LOG_COLUMNS} FROM log")
def session_summary(t):
    return log(t)


@query("session_summary_mal", f"""
WITH {RESULTS} SELECT session_id, count(*) AS input_files, count(is_malicious) AS total_files,
  count(*) FILTER (NOT is_malicious) AS safe_files, CAST(0 AS BIGINT) AS vulnerable_files,
  count(*) FILTER (is_malicious) AS malicious_files,
  round(coalesce(sum(analysis_time) FILTER (is_malicious IS NOT NULL), 0e0), 6) AS analysis_duration,
  count(*) - count(is_malicious) AS skipped_files, 'Integrated BERT' AS analysis_model,
  false AS vul_flag, count(*) FILTER (is_malicious) > 0 AS mal_flag, true AS is_bert, true AS is_mal,
  false AS is_ml, count(*) FILTER (is_malicious) = 0 AS is_safe
FROM results GROUP BY 1""")
def session_summary_mal(t):
    return op.session_summary(t.results, "mal", is_bert=True)


@query("session_summary_vul", f"""
WITH {RESULTS} SELECT session_id, count(*) AS input_files, count(is_vulnerable) AS total_files,
  count(*) FILTER (NOT is_vulnerable) AS safe_files, count(*) FILTER (is_vulnerable) AS
  vulnerable_files, CAST(0 AS BIGINT) AS malicious_files,
  round(coalesce(sum(analysis_time) FILTER (is_vulnerable IS NOT NULL), 0e0), 6) AS analysis_duration,
  count(*) - count(is_vulnerable) AS skipped_files, 'Integrated LSTM' AS analysis_model,
  count(*) FILTER (is_vulnerable) > 0 AS vul_flag, false AS mal_flag, false AS is_bert,
  false AS is_mal, false AS is_ml, count(*) FILTER (is_vulnerable) = 0 AS is_safe
FROM results GROUP BY 1""")
def session_summary_vul(t):
    return op.session_summary(t.results, "vul")


@query("global_stats", f"""
WITH {LOG}, s AS (SELECT count(*) AS total_sessions, CAST(sum(total_files) AS BIGINT) AS total_files,
  CAST(sum(safe_files) AS BIGINT) AS safe_files, CAST(sum(vulnerable_files) AS BIGINT)
  AS vulnerable_files, CAST(sum(malicious_files) AS BIGINT) AS malicious_files FROM log)
SELECT *, round(malicious_files * 1e2 / total_files, 6) AS malicious_rate,
  round(vulnerable_files * 1e2 / total_files, 6) AS vulnerable_rate,
  round(safe_files * 1e2 / total_files, 6) AS safe_rate FROM s""")
def global_stats(t):
    return op.global_stats(log(t))


COUNTED = PKG_ROWS + """,
c AS (SELECT session_id, count(*) AS total_packages,
  count(*) FILTER (final_malicious_status) AS malicious_packages,
  count(*) FILTER (lstm_vulnerability_status = 'Vulnerable') AS vulnerable_packages,
  count(*) FILTER (NOT final_malicious_status AND coalesce(lstm_vulnerability_status, '')
    <> 'Vulnerable') AS neither, sum(analysis_time) AS time FROM pkg_rows GROUP BY 1)"""


@query("package_summary", f"""
WITH {COUNTED} SELECT session_id, total_packages, malicious_packages, vulnerable_packages,
  total_packages - malicious_packages AS safe_packages,
  round(malicious_packages * 1e2 / total_packages, 6) AS malicious_rate,
  round(vulnerable_packages * 1e2 / total_packages, 6) AS vulnerable_rate,
  round((total_packages - malicious_packages) * 1e2 / total_packages, 6) AS safe_rate FROM c""")
def package_summary(t):
    return op.package_summary(t.pkg_rows)


def ml_log_sql(safe: str) -> str:
    return f"""WITH {COUNTED} SELECT session_id, 'ML (LSTM + XGBoost)' AS analysis_model,
  round(time, 6) AS analysis_duration, total_packages AS total_files, {safe} AS safe_files,
  vulnerable_packages AS vulnerable_files, malicious_packages AS malicious_files,
  vulnerable_packages > 0 AS vul_flag, malicious_packages > 0 AS mal_flag, false AS is_bert,
  false AS is_mal, true AS is_ml, {safe} = total_packages AS is_safe FROM c"""


@query("ml_session_log", ml_log_sql("neither"))
def ml_session_log(t):
    return op.ml_session_log(t.pkg_rows)


@query("ml_session_log_legacy",
       ml_log_sql("(total_packages - malicious_packages - vulnerable_packages)"))
def ml_session_log_legacy(t):
    return op.ml_session_log(t.pkg_rows, legacy=True)


@query("run_summary", f"""
WITH {PKG_ROWS} SELECT count(*) AS total_packages, count(*) FILTER (xgboost_prediction = 1)
  AS malicious_packages, count(*) FILTER (lstm_vulnerability_status = 'Vulnerable')
  AS vulnerable_packages, count(*) FILTER (xgboost_prediction = 0) AS safe_packages FROM pkg_rows""")
def run_summary(t):
    return op.run_summary(t.pkg_rows)


# Session log of all sources plus one without results, with an upload time.
DETAIL = ROUTED + """,
head AS (
  SELECT session_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MILLISECOND * count(*) * 100
    AS upload_time, false AS is_mal, false AS is_ml, CAST(0 AS BIGINT) AS safe_files
  FROM results GROUP BY 1
  UNION ALL SELECT concat('empty-', n_nationkey), TIMESTAMP '2024-02-01 00:00:00', true, false, 7
  FROM nation),
safe AS (SELECT session_id, count(*) AS n FROM routed WHERE task = 'vul' AND NOT flagged GROUP BY 1)"""


def detail(t):
    from .routing import routed

    counts = t.results.groupBy("session_id").agg(F.count("*").alias("n"))
    head = counts.select(
        "session_id",
        F.timestamp_micros(
            F.lit(1704067200000000) + F.col("n") * 100_000
        ).alias("upload_time"),
        F.lit(False).alias("is_mal"),
        F.lit(False).alias("is_ml"),
        F.lit(0).cast("bigint").alias("safe_files"),
    )
    empty = t.nation.select(
        F.concat(F.lit("empty-"), F.col("n_nationkey").cast("string")),
        F.timestamp_micros(F.lit(1706745600000000)),
        F.lit(True), F.lit(False), F.lit(7).cast("bigint"),
    )
    return op.session_detail(head.union(empty), routed(t))


@query("session_detail", f"""
WITH {DETAIL}
SELECT h.session_id, CASE WHEN h.upload_time = date_trunc('second', h.upload_time)
    THEN strftime(h.upload_time, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(h.upload_time, '%Y-%m-%dT%H:%M:%S.%f') END AS upload_time,
  coalesce(s.n, 0) AS safe_files,
  CASE WHEN task IS NOT NULL THEN concat(CASE task WHEN 'vul' THEN 'vulnerability' ELSE 'malicious' END, CASE flagged WHEN true THEN '_results'
    WHEN false THEN '_safe_results' ELSE '_errors' END) END AS result_list,
  file_path, status, probability, label, cwe_label, analysis_time
FROM head h LEFT JOIN safe s ON h.session_id = s.session_id
LEFT JOIN routed r ON h.session_id = r.session_id""")
def session_detail(t):
    return detail(t).drop("file_name", "is_mal", "is_ml")


@query("merge_package_source", f"""
WITH {FILES}, code AS (
  SELECT split_part(path, '/', 1) AS package, path, regexp_replace(content, '#[^\n]*', '', 'g') AS code FROM files)
SELECT package, CAST(row_number() OVER (PARTITION BY package ORDER BY path) - 1 AS INTEGER) AS part, path, md5(code) AS code
FROM code WHERE trim(code, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> ''""")
def merge_package_source(t):
    return op.merge_package_source(t.files).withColumn("code", F.md5("code"))


@query("download_counts", """
SELECT p_name AS project, count(*) AS downloads FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1""")
def download_counts(t):
    log = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return op.download_counts(log.select(F.col("p_name").alias("project")))


@query("download_counts_raw", """
SELECT l_returnflag AS project, count(*) AS downloads FROM lineitem GROUP BY 1""")
def download_counts_raw(t):
    return op.download_counts(t.lineitem, "l_returnflag")


@query("label_distribution", """
SELECT o_orderpriority AS label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6)
  AS share, min(count(*)) OVER () AS min_n FROM orders GROUP BY 1""")
def label_distribution(t):
    return op.label_distribution(t.orders, "o_orderpriority")


@query("class_weights", """
WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1)
SELECT label, n, round((1e0 / n) / sum(1e0 / n) OVER () * count(*) OVER (), 6) AS weight FROM c""")
def class_weights(t):
    return op.class_weights(t.orders, "o_orderpriority")


@query("null_counts", f"""
WITH {PACKAGES}
SELECT 'name' AS column, count(*) - count(name) AS nulls FROM packages
UNION ALL SELECT 'summary', count(*) - count(summary) FROM packages
UNION ALL SELECT 'version', count(*) - count(version) FROM packages
UNION ALL SELECT 'download', count(*) - count(download) FROM packages""")
def null_counts(t):
    return op.null_counts(t.packages.select("name", "summary", "version", "download"))


def profile_sql(column: str, numeric: bool) -> str:
    q = (
        f"""round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS sd,
    CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
    round(quantile_cont(CAST({column} AS DOUBLE), 25e-2), 6) AS q25,
    round(quantile_cont(CAST({column} AS DOUBLE), 5e-1), 6) AS q50,
    round(quantile_cont(CAST({column} AS DOUBLE), 75e-2), 6) AS q75"""
        if numeric
        else ", ".join(
            f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "sd", "min", "max", "q25", "q50", "q75")
        )
    )
    return f"""SELECT '{column}' AS column, count({column}) AS n, {q},
    (SELECT CAST({column} AS VARCHAR) FROM part GROUP BY {column}
     ORDER BY count(*) DESC, CAST({column} AS VARCHAR) LIMIT 1) AS top,
    (SELECT count(*) FROM part GROUP BY {column} ORDER BY count(*) DESC LIMIT 1) AS freq FROM part"""


@query("profile", " UNION ALL ".join(
    profile_sql(c, n) for c, n in (("p_name", False), ("p_brand", False), ("p_size", True),
                                   ("p_partkey", True))))
def profile(t):
    return op.profile(t.part, ["p_name", "p_brand", "p_size", "p_partkey"])


@query("timing_stats", f"""
WITH {RESULTS} SELECT session_id, count(*) AS n_files, round(sum(analysis_time), 6) AS total_time,
  round(sum(analysis_time) / count(*), 6) AS mean_time FROM results GROUP BY 1""")
def timing_stats(t):
    return op.timing_stats(t.results, "session_id")


@query("malicious_ratio", f"""
WITH {PKG_ROWS} SELECT count(*) AS total, count(*) FILTER (xgboost_prediction = 1) AS malicious,
  count(*) FILTER (xgboost_prediction <> 1) AS normal,
  round(count(*) FILTER (xgboost_prediction = 1) * 1e2 / count(*), 2) AS ratio FROM pkg_rows""")
def malicious_ratio(t):
    return op.malicious_ratio(t.pkg_rows)


@query("verdict_share", f"""
WITH {LOG} SELECT session_id, vulnerable_files, total_files,
  round(coalesce(vulnerable_files * 1e2 / nullif(total_files, 0), 0e0), 1) AS share FROM log""")
def verdict_share(t):
    df = op.verdict_share(log(t))
    return df.select("session_id", "vulnerable_files", "total_files", "share")


@query("files_per_package", f"""
WITH {FILES}, p AS (SELECT DISTINCT source AS package FROM documents
  UNION ALL SELECT n_name FROM nation)
SELECT package, count(f.path) AS n_files FROM p LEFT JOIN files f
  ON split_part(f.path, '/', 1) = package AND f.path LIKE '%.py' GROUP BY 1""")
def files_per_package(t):
    listed = t.documents.select(F.col("source").alias("package")).distinct()
    listed = listed.union(t.nation.select("n_name"))
    files = t.files.select("path", F.split("path", "/")[0].alias("package"))
    return op.files_per_package(listed, files)


def order_log(t):
    return t.orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("filename"),
    )


ORDER_LOG = """olog AS (SELECT o_orderkey AS session_id, o_orderdate AS created_at,
  o_orderpriority AS filename FROM orders)"""


@query("recent_sessions", f"""
WITH {ORDER_LOG} SELECT * FROM olog ORDER BY created_at DESC, session_id LIMIT 10""")
def recent_sessions(t):
    return order.recent_sessions(order_log(t))


@query("page_sessions", f"""
WITH {ORDER_LOG} SELECT * FROM olog ORDER BY created_at DESC, session_id LIMIT 20 OFFSET 40""")
def page_sessions(t):
    return order.page_sessions(order_log(t), 40, 20)


@query("page_sessions_by_key", f"""
WITH {ORDER_LOG} SELECT * FROM olog ORDER BY created_at DESC, session_id LIMIT 20 OFFSET 40""")
def page_sessions_by_key(t):
    """The third page of 20 by the stored index of page boundaries."""
    log = order_log(t)
    return order.page_by_key(log, order.page_index(log, 20), 2)


@query("sorted_report", """
SELECT CASE WHEN toxic = 1 THEN 'malicious' ELSE 'benign' END AS label, (doc_id % 100) / 1e2 AS prob,
  doc_id AS file_id FROM labels ORDER BY 1, 2 DESC, 3""")
def sorted_report(t):
    df = t.labels.select(
        F.when(F.col("toxic") == 1, "malicious").otherwise("benign").alias("label"),
        ((F.col("doc_id") % 100) / F.lit(1e2)).alias("prob"),
        F.col("doc_id").alias("file_id"),
    )
    return order.sorted_report(df)


@query("head_rows", """
SELECT doc_id, quality, toxic, (SELECT count(*) FROM labels) - 8 AS n_more FROM labels
ORDER BY doc_id LIMIT 8""")
def head_rows(t):
    return order.head_rows(t.labels, 8, "doc_id")


@query("sorted_targets", "SELECT p_name AS package, p_partkey FROM part ORDER BY p_name")
def sorted_targets(t):
    return order.sorted_targets(t.part.select(F.col("p_name").alias("package"), "p_partkey"))


@query("union_labeled", """
SELECT c_name AS name, c_acctbal AS balance, 1 AS label FROM customer
UNION ALL SELECT s_name, s_acctbal, 0 FROM supplier""")
def union_labeled(t):
    customers = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return order.union_labeled({1: customers, 0: suppliers})


def _keys(t):
    return t.documents.select(F.col("doc_id").alias("k")), t.labels.select(F.col("doc_id").alias("k"))


@query("only_in", "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels")
def only_in(t):
    return order.only_in(*_keys(t), "k")


@query("in_both", "SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels")
def in_both(t):
    return order.in_both(*_keys(t), "k")


@query("session_files", f"""
WITH {DETAIL} SELECT session_id, file_path, status, label FROM routed WHERE flagged""")
def session_files(t):
    return order.session_files(detail(t)).select("session_id", "file_path", "status", "label")
