"""Continuous analysis of uploaded archives."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import session_log
from ..sources.ranges import can_range
from ..sources.scans import archive_files, archive_stem
from ..sources.sinks import append_failures, append_log, append_results, run_results


def stream_analyze(
    spark: SparkSession,
    path: str,
    root: str,
    analyze: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    mode: str = "both",
    is_bert: bool = False,
    max_files: int = 8,
    available_now: bool = True,
    ranged: bool | None = None,
) -> StreamingQuery:
    """Analyse every new archive below ``path`` into the store at ``root``.

    ``analyze`` turns a file table with ``session_id`` into routed result rows. The run id names the
    stream by its ``checkpoint``, a folder all machines share, and the batch by its number: a batch
    that is retried replaces its own run, and another stream never does. A session is one archive.
    Archives are read as the batch scan reads them (``ranged`` as there); empty files are left out. Damaged members reach
    ``analyze`` with null ``content`` and have to leave it as unscored rows without ``file_size``; the
    log counts them as skipped. An archive without a readable source file is an ``analysis_failed``
    event and gets no log row.
    """
    ranged = can_range(path) if ranged is None else ranged
    arriving = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", "*.zip")
        .load(path)
    )
    stamp = F.md5(F.concat_ws("|", "path", "modificationTime", "length"))
    uploads = arriving.select(
        F.concat_ws("-", archive_stem(F.col("path")), F.substring(stamp, 1, 12)).alias("archive"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("file_size"),
        F.col("path").alias("location") if ranged else F.col("content").alias("bytes"),
    )
    held = "location" if ranged else "bytes"

    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def run(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{stream_id}-{batch_id:012d}"
        members = archive_files(batch.select("archive", held))
        files = members.filter("length(content) > 0 OR error IS NOT NULL")
        append_results(analyze(files.withColumn("session_id", F.col("archive"))), root, run_id)
        # The log is made from what was written, so files are scored once per batch.
        session = batch.sparkSession
        sessions = batch.select(F.col("archive").alias("session_id"), "filename", "file_size")
        written = run_results(session, root, run_id)
        # Only damaged members have no size.
        readable = written.filter("file_size IS NOT NULL").select("session_id").distinct()
        failed = sessions.join(readable, "session_id", "left_anti")
        append_failures(failed.withColumn("event", F.lit("analysis_failed")), root, run_id)
        log = session_log(written.join(readable, "session_id", "left_semi"), mode, is_bert)
        append_log(sessions.join(log, "session_id"), root, run_id)

    writer = arriving_writer(uploads, run, checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arriving_writer(uploads: DataFrame, run: Callable, checkpoint: str):
    return uploads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
