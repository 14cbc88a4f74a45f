"""Session status events. Each operator takes a batch or a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("analysis_complete", "analysis_failed")


def latest_status(events: DataFrame) -> DataFrame:
    """Last event per session; on a stream use output mode ``update``."""
    last = F.max(F.struct("ts", "event", "payload"))
    return events.groupBy("session_id").agg(last.alias("e")).select(
        "session_id", "e.ts", "e.event", "e.payload"
    )


def session_events(log: DataFrame, model: str, mode: str | None = None) -> DataFrame:
    """Started, complete and failed payload rows, as JSON, from session log rows.

    A row with an ``error`` gives a failed event instead of a complete one. Needs ``session_id,
    filename, total_files, safe_files, vulnerable_files, malicious_files, analysis_duration``.
    """
    error = F.col("error") if "error" in log.columns else F.lit(None).cast("string")
    tail = [F.lit(mode).alias("mode")] if mode else []
    head = ["session_id", F.lit(model).alias("model"), "filename"]
    started = F.struct(
        "session_id", "filename", F.lit("processing").alias("status"),
        F.lit(model).alias("model"), *tail,
    )
    complete = F.struct(
        *head,
        F.lit("completed").alias("status"),
        F.struct(
            "total_files",
            "safe_files",
            "vulnerable_files",
            "malicious_files",
            F.col("analysis_duration").alias("analysis_time"),
        ).alias("summary"),
        F.concat(F.lit("/session/"), F.col("session_id")).alias("redirect_url"),
        *tail,
    )
    failed = F.struct(
        *head, F.lit("failed").alias("status"), error.alias("error"), *tail
    )
    row = lambda name, payload: F.struct(
        F.lit(name).alias("event"), F.to_json(payload).alias("payload")
    )
    rows = F.array(
        row("analysis_started", started),
        F.when(error.isNull(), row("analysis_complete", complete)).otherwise(
            row("analysis_failed", failed)
        ),
    )
    return log.select("session_id", F.inline(rows))


def session_timeouts(events: DataFrame, limit_seconds: int = 600) -> DataFrame:
    """Sessions whose last start got no terminal event within the limit.

    The clock is the newest event of the table. One aggregate row per session; no event list of a
    session is gathered.
    """
    now = events.agg(F.max("ts").alias("now")).select("now").scalar()
    started = F.max(F.when(F.col("event") == "analysis_started", F.col("ts")))
    ended = F.max(F.when(F.col("event").isin(*TERMINAL), F.col("ts")))
    last = events.groupBy("session_id").agg(started.alias("started"), ended.alias("ended"))
    end = F.when(F.col("ended") >= F.col("started"), F.col("ended"))
    waited = F.timestamp_diff("MICROSECOND", F.col("started"), F.coalesce(end, now))
    return (
        last.filter("started IS NOT NULL")
        .withColumn("waited_seconds", F.floor(waited / F.lit(1_000_000)).cast("bigint"))
        .filter(waited > limit_seconds * 1_000_000)
        .select("session_id", "started", "waited_seconds")
    )


def stream_session_timeouts(
    events: DataFrame, limit_seconds: int = 600, lateness: str = "10 minutes"
) -> DataFrame:
    """Streaming form: each run of events without a longer gap than the limit is one window.

    A run whose last start has no later terminal event has timed out once the watermark has passed
    it. The state is two times per run, never a list of events. The lateness of 10 minutes is this
    library's choice.
    """
    gap = f"{limit_seconds * 1000 + 1} milliseconds"
    runs = (
        events.withWatermark("ts", lateness)
        .filter(F.col("event").isin("analysis_started", *TERMINAL))
        .groupBy("session_id", F.session_window("ts", gap).alias("run"))
        .agg(
            F.max(F.when(F.col("event") == "analysis_started", F.col("ts"))).alias("started"),
            F.max(F.when(F.col("event").isin(*TERMINAL), F.col("ts"))).alias("ended"),
        )
    )
    return runs.filter("started IS NOT NULL AND (ended IS NULL OR ended < started)").select(
        "session_id", "started"
    )
