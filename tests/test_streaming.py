import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import mal_score, vul_score
from vetloom.plans.analysis import file_verdicts, score_files, session_log, store_rows
from vetloom.sources import sinks
from vetloom.sources.scans import scan_archives
from vetloom.streaming.analyze import stream_analyze
from vetloom.streaming.events import session_timeouts, stream_session_timeouts

from .test_sources import zip_bytes


def analyze(files):
    files = files.withColumn("file_id", F.concat_ws("/", "session_id", "path"))
    text = F.col("text")
    scores = score_files(
        files, lambda w: w.withColumns({"vul_prob": vul_score(text), "mal_prob": mal_score(text)})
    )
    return store_rows(file_verdicts(files, scores), "bert")


def test_stream_equals_batch(spark, tmp_path):
    uploads, root = tmp_path / "in", str(tmp_path / "store")
    uploads.mkdir()
    members = {f"source/p/{i}.py": "aeiou " * (i * 40) + "x" * (3 - i) * 99 for i in range(4)}
    for i in range(3):
        (uploads / f"a{i}.zip").write_bytes(zip_bytes(dict(list(members.items())[: i + 2])))
    (uploads / "none.zip").write_bytes(zip_bytes({"readme.txt": "no code"}))
    (uploads / "broken.zip").write_bytes(b"no archive")
    extra = {"p/__pycache__/x.py": "aeiou", "p/empty.py": "", "p\\\\q.py": "aeiou" * 50}
    (uploads / "mixed.zip").write_bytes(zip_bytes(extra))
    check = str(tmp_path / "check")

    def run():
        stream_analyze(
            spark, str(uploads), root, analyze, is_bert=True, max_files=2, checkpoint=check
        ).awaitTermination()

    run()
    key = F.regexp_replace("session_id", "-[0-9a-f]{12}$", "")
    columns = ["total_files", "safe_files", "vulnerable_files", "malicious_files", "is_safe"]
    got = {r[0]: tuple(r)[1:] for r in sinks.read_log(spark, root).select(key, *columns).collect()}
    batch = scan_archives(spark, f"{uploads}/*.zip").withColumn("session_id", F.col("archive"))
    log = session_log(analyze(batch.filter("size > 0")), is_bert=True)
    expected = {r[0]: tuple(r)[1:] for r in log.select("session_id", *columns).collect()}
    assert got == expected and set(got) == {"a0", "a1", "a2", "mixed"} and got["mixed"][0] == 1
    failures = {r.filename for r in sinks.read_failures(spark, root).collect()}
    assert failures == {"none.zip", "broken.zip"}

    before = sinks.read_results(spark, root).count()
    run()  # nothing new
    assert sinks.read_results(spark, root).count() == before
    (uploads / "late.zip").write_bytes(zip_bytes({"b.py": "aeiou"}))
    run()
    assert sinks.read_results(spark, root).count() == before + 2


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENTS = [
    ("ok", "analysis_started", at(0)), ("ok", "analysis_complete", at(5)),
    ("slow", "analysis_started", at(0)), ("slow", "analysis_complete", at(11)),
    ("lost", "analysis_started", at(1)),
    ("failed", "analysis_started", at(2)), ("failed", "analysis_failed", at(3)),
    ("young", "analysis_started", at(55)),
    ("clock", "view", at(60)),
]


def test_timeouts_batch(spark):
    df = spark.createDataFrame(EVENTS, "session_id string, event string, ts timestamp")
    rows = {r["session_id"]: r["waited_seconds"] for r in session_timeouts(df).collect()}
    assert rows == {"slow": 660, "lost": 59 * 60}


def test_timeouts_stream(spark, tmp_path):
    schema = "session_id string, event string, ts timestamp"
    source, out = tmp_path / "events", str(tmp_path / "out")
    for i, minutes in enumerate(((0, 30), (30, 70))):
        part = [e for e in EVENTS if at(minutes[0]) <= e[2] < at(minutes[1])]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        stream_session_timeouts(events).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r["session_id"] for r in spark.read.parquet(out).collect()} == {"slow", "lost"}


def test_damaged_members_are_skipped_files(spark, tmp_path):
    uploads, root = tmp_path / "in", str(tmp_path / "store")
    uploads.mkdir()
    whole = zip_bytes({"p/good.py": "aeiou" * 50, "p/bad1.py": "BROKEN1" * 9, "p/bad2.py": "BROKEN2" * 9})
    (uploads / "part.zip").write_bytes(whole.replace(b"BROKEN", b"brokeN"))
    (uploads / "all.zip").write_bytes(zip_bytes({"p/bad.py": "BROKEN"}).replace(b"BROKEN", b"brokeN"))
    (uploads / "none.zip").write_bytes(b"no archive")

    rows = {(r.archive, r.path): r for r in scan_archives(spark, f"{uploads}/*.zip", unreadable=True).collect()}
    assert {k for k, r in rows.items() if r.error is None} == {("part", "p/good.py")}
    assert set(rows) == {("part", f"p/{n}.py") for n in ("good", "bad1", "bad2")} | {("all", "p/bad.py"), ("none", None)}
    assert all((r.content is None) == (r.error is not None) for r in rows.values())

    stream_analyze(spark, str(uploads), root, analyze, is_bert=True, checkpoint=str(tmp_path / "check")).awaitTermination()
    log, = sinks.read_log(spark, root).collect()
    assert (log.filename, log.input_files, log.total_files, log.skipped_files) == ("part.zip", 3, 1, 2)
    errors = sinks.read_results(spark, root).filter("status = 'Error'").select("file_path", "verdict").collect()
    assert sorted(map(tuple, errors)) == [(f"p/bad{i}.py", f"{side}_error") for i in (1, 2) for side in ("mal", "vul")]
    assert {r.filename for r in sinks.read_failures(spark, root).collect()} == {"all.zip", "none.zip"}
