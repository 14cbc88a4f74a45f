"""Status events and the end-to-end plans."""

from pyspark.sql import functions as F

from vetloom.plans import analysis as plan
from vetloom.session import spread
from vetloom.operators.aggregates import session_summary
from vetloom.streaming import events as op

from .registry import CHUNKS, EVENTS, LOG, TRIANGULAR, mal_score, query, vul_score
from .stats import log


@query("latest_status", f"""
WITH {EVENTS} SELECT session_id, ts, event, payload FROM status_events
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event DESC, payload DESC) = 1""")
def latest_status(t):
    return op.latest_status(t.status_events)


@query("session_events", f"""
WITH {LOG}, l AS (SELECT *, concat(session_id, '.zip') AS filename,
  CASE WHEN total_files % 3 = 0 THEN 'no result' END AS error FROM log)
SELECT session_id, 'analysis_started' AS event, concat('{{"session_id":"', session_id,
  '","filename":"', filename, '","status":"processing","model":"lstm","mode":"both"}}') AS payload FROM l
UNION ALL
SELECT session_id, 'analysis_complete', concat('{{"session_id":"', session_id,
  '","model":"lstm","filename":"', filename, '","status":"completed","summary":{{"total_files":',
  total_files, ',"safe_files":', safe_files, ',"vulnerable_files":', vulnerable_files,
  ',"malicious_files":', malicious_files, ',"analysis_time":', CAST(0 AS VARCHAR), '.0}},"redirect_url":"/session/',
  session_id, '","mode":"both"}}') FROM l WHERE error IS NULL
UNION ALL
SELECT session_id, 'analysis_failed', concat('{{"session_id":"', session_id,
  '","model":"lstm","filename":"', filename, '","status":"failed","error":"', error,
  '","mode":"both"}}') FROM l WHERE error IS NOT NULL""")
def session_events(t):
    named = log(t).withColumns(
        {
            "filename": F.concat("session_id", F.lit(".zip")),
            "analysis_duration": F.lit(0.0),
            "error": F.when(F.col("total_files") % 3 == 0, "no result"),
        }
    )
    return op.session_events(named, "lstm", "both")


@query("session_timeouts", f"""
WITH {EVENTS}, n AS (SELECT max(ts) AS now FROM status_events),
s AS (SELECT session_id, max(ts) FILTER (event = 'analysis_started') AS started,
  max(ts) FILTER (event IN ('analysis_complete', 'analysis_failed')) AS ended FROM status_events GROUP BY 1),
w AS (SELECT session_id, started, epoch_us(CASE WHEN ended >= started THEN ended ELSE now END)
  - epoch_us(started) AS waited FROM s, n WHERE started IS NOT NULL)
SELECT session_id, started, CAST(waited // 1000000 AS BIGINT) AS waited_seconds FROM w
WHERE waited > 600 * 1000000""")
def session_timeouts(t):
    return op.session_timeouts(t.status_events)


JUDGED = CHUNKS + f""",
v AS (SELECT file_id, {TRIANGULAR} AS vul_prob FROM chunk_probs GROUP BY 1),
m AS (SELECT file_id, {TRIANGULAR} AS mal_prob FROM mal_probs GROUP BY 1),
judged AS (SELECT f.session_id, f.size, vul_prob > 5e-1 AS vul, mal_prob > 5e-1 AS mal
  FROM files f JOIN v USING (file_id) JOIN m USING (file_id))"""

PIPELINE_SQL = f"""
WITH {JUDGED} SELECT session_id, count(*) AS input_files, count(*) AS total_files,
  count(*) FILTER (NOT vul AND NOT mal) AS safe_files, count(*) FILTER (vul) AS vulnerable_files,
  count(*) FILTER (mal) AS malicious_files, round(sum(size / 1e3), 6) AS analysis_duration,
  CAST(0 AS BIGINT) AS skipped_files, 'Integrated BERT' AS analysis_model,
  count(*) FILTER (vul) > 0 AS vul_flag, count(*) FILTER (mal) > 0 AS mal_flag, true AS is_bert,
  false AS is_mal, false AS is_ml, count(*) FILTER (vul OR mal) = 0 AS is_safe
FROM judged GROUP BY 1"""


@query("file_analysis", PIPELINE_SQL)
def file_analysis(t):
    """Files to session log with scorers that are column expressions: one shuffle, of the log."""
    files = spread(t.files.select("session_id", "file_id", "content", "size"))
    scored = plan.score_files_in_place(files, {"vul_prob": vul_score, "mal_prob": mal_score})
    judged = scored.select(
        "session_id",
        (F.col("vul_prob") > 0.5).alias("is_vulnerable"),
        (F.col("mal_prob") > 0.5).alias("is_malicious"),
        (F.col("size") / F.lit(1e3)).alias("analysis_time"),
    )
    return session_summary(judged, is_bert=True)


@query("file_analysis_store", PIPELINE_SQL)
def file_analysis_store(t):
    """The same through window tables, routed store rows and the log made from them."""
    text = F.col("text")
    scores = plan.score_files(
        spread(t.files),
        lambda w: w.withColumns({"vul_prob": vul_score(text), "mal_prob": mal_score(text)}),
    )
    verdicts = plan.file_verdicts(t.files, scores).withColumn(
        "analysis_time", F.col("size") / F.lit(1e3)
    )
    return plan.session_log(plan.store_rows(verdicts, "bert"), is_bert=True)


@query("package_analysis")
def package_analysis(t):
    """Packages to comprehensive results with a freshly trained model.

    ``part`` tells the packages the model was fitted on (``train``) from the held-out ones.
    """
    from .training import _package_models

    df, models = _package_models(t, ["gradient_boosting"])
    results = plan.analyze_packages(
        t.packages, t.popular, t.verdicts, models["gradient_boosting"], email="author_email"
    ).select("name", "xgboost_prediction", "lstm_vulnerability_status", "download")
    return results.join(df.select("name", "part"), "name", "left")
