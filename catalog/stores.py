"""Sources and sinks: what is written comes back the same."""

from pyspark.sql import functions as F

from vetloom.session import scratch_dir
from vetloom.sources import scans, sinks

from .registry import EVENTS, LOG, ROUTED, query
from .routing import routed
from .stats import LOG_COLUMNS, log


@query("append_results", f"""
WITH {ROUTED} SELECT session_id, file_path, task, verdict, flagged, probability FROM routed""")
def append_results(t):
    """Two runs over the same sessions; readers see the second one only."""
    root = scratch_dir(t.spark, "store")
    sessions = log(t).select("session_id", "total_files")
    for run, scale in (("run-1", 0.5), ("run-2", 1.0)):
        rows = routed(t).withColumn("probability", F.col("probability") * scale)
        sinks.append_results(rows, root, run)
        sinks.append_log(sessions, root, run)
    return sinks.read_results(t.spark, root).select(
        "session_id", "file_path", "task", "verdict", "flagged", "probability"
    )


@query("append_log", f"WITH {LOG} SELECT {LOG_COLUMNS} FROM log")
def append_log(t):
    root = scratch_dir(t.spark, "log")
    sinks.append_log(log(t), root, "run-1")
    return sinks.read_log(t.spark, root).drop("created_at", "run_id")


@query("write_verdicts_csv", """
SELECT doc_id AS file_id, lang AS label, text AS preview FROM documents""")
def write_verdicts_csv(t):
    """Whole texts with line breaks and quotes go through CSV."""
    path = scratch_dir(t.spark, "csv")
    rows = t.documents.select(
        F.col("doc_id").alias("file_id"), F.col("lang").alias("label"), F.col("text").alias("preview")
    )
    sinks.write_verdicts(rows, path)
    back = scans.scan_csv(t.spark, path, required=["file_id"])
    return back.withColumn("file_id", F.col("file_id").cast("bigint"))


@query("write_verdicts_json", """
SELECT doc_id AS file_id, lang AS label, text AS preview FROM documents""")
def write_verdicts_json(t):
    path = scratch_dir(t.spark, "json")
    rows = t.documents.select(
        F.col("doc_id").alias("file_id"), F.col("lang").alias("label"), F.col("text").alias("preview")
    )
    sinks.write_verdicts(rows, path, "json")
    return t.spark.read.schema("file_id bigint, label string, preview string").json(path)


@query("scan_versions", """
SELECT concat(replace(p_name, ' ', '-'), '-', p_partkey) AS name, concat(p_size, '.0') AS version
FROM part""")
def scan_versions(t):
    path = scratch_dir(t.spark, "versions")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"),
                    F.col("p_partkey").cast("string"))
    lines = t.part.select(
        F.concat(name, F.lit("   "), F.col("p_size").cast("string"), F.lit(".0")).alias("value")
    )
    heading = t.region.select(
        F.when(F.col("r_regionkey") == 0, "Package Version").otherwise("------- -------")
        .alias("value")
    )
    lines.union(heading).write.text(path)
    return scans.scan_versions(t.spark, path)


@query("scan_labels", """
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS class_idx, n_name AS name
FROM nation""")
def scan_labels(t):
    """The nation names as one label text with blank lines in between."""
    path = scratch_dir(t.spark, "labels")
    names = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))["n_name"]
    text = F.concat(F.lit("\n  "), F.array_join(names, "\n\n  "), F.lit("\n\n"))
    t.nation.agg(text.alias("value")).write.text(path)
    return scans.scan_labels(t.spark, path)


@query("scan_top_packages", """
SELECT p_name AS project FROM part""")
def scan_top_packages(t):
    path = scratch_dir(t.spark, "top")
    row = F.struct(
        F.col("p_name").alias("project"), F.col("p_partkey").alias("download_count")
    )
    listing = F.to_json(F.struct(F.array(row).alias("rows")))
    t.part.select(listing.alias("value")).write.text(path)
    return scans.scan_top_packages(t.spark, path, multi_line=False)


@query("stream_latest_status", f"""
WITH {EVENTS} SELECT session_id, ts, event, payload FROM status_events
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event DESC, payload DESC) = 1""")
def stream_latest_status(t):
    """The status table kept by a stream over the events, after all of them have arrived."""
    from vetloom.streaming.events import latest_status

    out = scratch_dir(t.spark, "status")
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        t.sf_dir
    )
    events = stream.select(
        F.col("user_id").alias("session_id"), "ts", F.col("props").alias("payload"),
        F.when(F.col("event_type") == "signup", "analysis_started")
        .when(F.col("event_type") == "purchase", "analysis_complete")
        .when(F.col("event_type") == "error", "analysis_failed")
        .otherwise(F.col("event_type")).alias("event"),
    )

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:09d}")

    query = (
        latest_status(events).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", scratch_dir(t.spark, "status-check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_status(t.spark.read.parquet(out).drop("batch"))
