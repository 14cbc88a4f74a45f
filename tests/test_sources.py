import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vetloom.operators.models import load_model, save_model
from vetloom.sources import archives, csv_ranges, scans, sinks


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, data in {
        "source/a/x.py": "x = 1\n".encode(),
        "source/a/__pycache__/x.py": b"no",
        "source/b.dist-info/y.py": b"no",
        "source/b/Y.PY": "é = 2".encode(),
        "source/b/bad.py": b"ok \xff\xfe end",
        "source/b/empty.py": b"",
        "source/b/notes.txt": b"no",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def contents(df):
    return {r["path"]: r["content"] for r in df.collect()}


def test_scan_source_files(spark, tree):
    strict = scans.scan_source_files(spark, str(tree))
    assert strict.columns == ["archive", "path", "name", "content", "size"]
    assert contents(strict) == {
        "source/a/x.py": "x = 1\n", "source/b/Y.PY": "é = 2"
    }  # Spark's file scan leaves out files of no bytes
    sizes = {r["name"]: r["size"] for r in strict.collect()}
    assert sizes == {"x.py": 6, "Y.PY": 5}
    assert contents(scans.scan_source_files(spark, str(tree), "ignore"))["source/b/bad.py"] == "ok  end"
    replaced = contents(scans.scan_source_files(spark, str(tree), "replace"))["source/b/bad.py"]
    assert replaced == b"ok \xff\xfe end".decode(errors="replace")
    assert "source/b/Y.PY" not in contents(scans.scan_source_files(spark, str(tree), ignore_case=False))
    with pytest.raises(ValueError):
        scans.scan_source_files(spark, str(tree), "guess")


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path):
    """Spark's source lists every file on the driver and makes a task of each 32 small ones."""
    root = tmp_path / "many"
    places = [f"{a}/{b}" if b else str(a) for a in range(40) for b in ("", "x", "x/y z/ü", "_metadata_of/z")]
    places += ["_hidden", ".git", "k=1", "_k=1", "a/__pycache__", "t._COPYING_"]
    for i, place in enumerate(places):
        (root / place).mkdir(parents=True, exist_ok=True)
        for name in ("m.py", "_n.py", ".o.py", "_p=1.py", "empty.py", "notes.txt", "u.py._COPYING_", "_metadata.py"):
            (root / place / name).write_text("" if name == "empty.py" else f"x = {i}\n")
    (root / "gone.py").symlink_to(tmp_path / "nowhere")
    (root / "link").symlink_to(root / "0", target_is_directory=True)
    for scan, column in ((scans.scan_source_files, "path"), (scans.scan_package_metadata, "file_name")):
        df = scan(spark, str(root))
        assert not df.inputFiles() and df.rdd.getNumPartitions() <= 8
        rows = sorted(tuple(r) for r in df.collect())
        assert rows == sorted(tuple(r) for r in scan(spark, f"file://{root}/", ranged=False).collect())
    assert len(contents(scans.scan_source_files(spark, str(root)))) > 300
    part = scans.scan_source_files(spark, f"{root}/[01]")
    assert part.inputFiles() and part.count()
    with pytest.raises(AnalysisException) as missing:
        scans.scan_source_files(spark, str(tmp_path / "none"))
    assert missing.value.getCondition() == "PATH_NOT_FOUND"


def test_written_trees_are_read_back(spark, tmp_path):
    files = spark.createDataFrame([(f"s{i % 3}/{i % 5}/{i}.py", f"é = {i}") for i in range(60)], "path string, content string")
    assert archives.write_tree(files.repartition(4), f"file://{tmp_path}/t").count() == 60
    assert contents(scans.scan_source_files(spark, f"file://{tmp_path}/t")) == dict(tuple(r) for r in files.collect())


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_scan_archives(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(
        zip_bytes({"source/p/a.py": "a", "source/p/__pycache__/a.py": "no", "r.txt": "no"})
    )
    (tmp_path / "two-1.0.zip").write_bytes(zip_bytes({"b.py": "b" * 10, "c.py": b"\xff"}))
    (tmp_path / "none.zip").write_bytes(zip_bytes({"r.txt": "no"}))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    df = scans.scan_archives(spark, f"{tmp_path}/*.zip")
    got = {(r["archive"], r["path"], r["content"]) for r in df.collect()}
    assert got == {("one", "source/p/a.py", "a"), ("two-1.0", "b.py", "b" * 10)}
    with pytest.raises(Exception):
        scans.scan_archives(spark, f"{tmp_path}/*.zip", fail=True).collect()


def test_archive_beyond_one_row_is_read_by_ranges(spark, tmp_path):
    """Members before and behind a hole of 3 GB; nothing of the hole is read."""
    path = tmp_path / "big.zip"
    texts = {f"source/p/m{i}.py": f"x = {i}\n" * (i * 700) for i in range(1, 40)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, text) in enumerate(texts.items()):
            if i == 20:
                z.fp.seek(3 << 30)
                z.start_dir = z.fp.tell()
            z.writestr(name, text, compress_type=[zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2][i % 3])
        z.writestr("huge.bin", b"\0" * 1000)
        z.writestr("odd.py", b"lzma", compress_type=zipfile.ZIP_LZMA)
    assert path.stat().st_size > 3 << 30
    df = scans.scan_archives(spark, str(path))
    rows = {r["path"]: r for r in df.collect()}
    assert {p: r["content"] for p, r in rows.items() if r["error"] is None} == texts
    assert rows["odd.py"]["error"].startswith("NotImplementedError")
    members = archives.read_members(
        spark.createDataFrame([("big", str(path))], "archive string, location string"), lambda p: F.lit(True), span=1 << 10, parts=16)
    tasks = members.filter("bytes IS NOT NULL").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 5 and sum(r["count"] for r in tasks) == 39


def test_members_that_lie_are_rows_with_an_error(spark, tmp_path):
    bomb = zip_bytes({"a.py": "ok", "b.py": "b" * 100})
    info = zipfile.ZipFile(io.BytesIO(bomb)).getinfo("b.py")
    short = bomb.replace((100).to_bytes(4, "little") * 2, (100).to_bytes(4, "little") + (7).to_bytes(4, "little"))
    assert short != bomb and info.file_size == 100
    (tmp_path / "short.zip").write_bytes(short)
    (tmp_path / "cut.zip").write_bytes(bomb[: info.header_offset + 20] + bomb[-200:])
    rows = scans.scan_archives(spark, f"{tmp_path}/*.zip", unreadable=True).collect()
    errors = {(r["archive"], r["path"]): r["error"] for r in rows}
    assert errors["short", "a.py"] is None and "BadZipFile" in errors["short", "b.py"]
    assert all(e for (a, _), e in errors.items() if a == "cut")


def test_scan_package_metadata(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Name: a\xff\nVersion: 1\n")
    (tmp_path / "b.txt").write_text("nothing\n")
    (tmp_path / "c.md").write_text("Name: c\n")
    rows = scans.scan_package_metadata(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["name"], r["version"], r["author"]) for r in rows] == [
        ("a.txt", "a", "1", None)
    ]


def test_scan_versions(spark, tmp_path):
    path = tmp_path / "versions.txt"
    path.write_text("Package Version\n------- -------\nnumpy 1.2\nlonely\n  scipy   3.4  \n")
    rows = {tuple(r) for r in scans.scan_versions(spark, str(path)).collect()}
    assert rows == {("numpy", "1.2"), ("scipy", "3.4")}
    path.write_text("numpy==1.2\n-e git\nscipy==3\n")
    rows = {tuple(r) for r in scans.scan_versions(spark, str(path), freeze=True).collect()}
    assert rows == {("numpy", "1.2"), ("scipy", "3")}


def test_scan_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes('﻿Directory,MergedCodeWithoutComments\np,"a\n""b"""\n'.encode())
    df = scans.scan_csv(spark, str(path), required=["package", "code"])
    assert [tuple(r) for r in df.collect()] == [("p", 'a\n"b"')]
    path.write_bytes("package,author\np,é\n".encode("latin-1"))
    assert [tuple(r) for r in scans.scan_csv(spark, str(path)).collect()] == [("p", "é")]
    with pytest.raises(ValueError):
        scans.scan_csv(spark, str(path), required=["code"])


def csv_text(rng, rows, *more):
    cells = [*more, "", "plain", "two\nlines", 'say "hi"', ",,", "é한글漢", '"', "\n\n\n", " blank ", "x" * 300]
    lines = [["id", "Directory", "a b"]] + [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(rows)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r') or rng.random() < 0.3 else c
    ends = rng.choice(["\n", "\r\n"])
    return ends.join(",".join(map(quoted, line)) for line in lines) + rng.choice(["", ends])


@pytest.mark.parametrize("span", [2, 30, 1000, 1 << 25])
def test_csv_by_ranges_equals_the_plain_reader(spark, tmp_path, span):
    rng = random.Random(span)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_bytes(csv_text(rng, 8 if span == 2 else 60).encode())
    ours = csv_ranges.read_csv_ranges(spark, str(tmp_path), span=span)
    plain = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path))
    assert ours.columns == plain.columns == ["id", "Directory", "a b"]
    order = lambda df: sorted(map(str, df.collect()))
    assert order(ours) == order(plain)


@pytest.mark.parametrize("span", [10, 500])
def test_csv_by_ranges_keeps_all_line_breaks_in_quotes(spark, tmp_path, span):
    """Spark's own reader makes them line feeds in some files; Python's and pandas' keep them."""
    text = csv_text(random.Random(span), 40, "\r\n", "a\r\nb")
    (tmp_path / "a.csv").write_bytes(text.encode())
    expected = list(csv.reader(io.StringIO(text, newline="")))[1:]
    found = csv_ranges.read_csv_ranges(spark, str(tmp_path), span=span).collect()
    assert sorted([x or "" for x in r] for r in found) == sorted(expected)


def test_csv_encodings_are_told_file_by_file(spark, tmp_path):
    texts = {"utf-8": "é한", "utf-8-sig": "é", "cp949": "똠방각하", "euc-kr": "한글", "utf-16": 'a"é\n한', "utf-16-be": "漢\n\n字", "latin-1": "é\n"}
    for name, text in texts.items():
        body = 'package,code\n' + f'{name},"' + text.replace('"', '""') * 40 + '"\n'
        mark = b"\xfe\xff" if name == "utf-16-be" else b""
        (tmp_path / f"{name}.csv").write_bytes(mark + body.encode(name))
    for span in (26, 1 << 20):
        found = csv_ranges.read_csv_ranges(spark, str(tmp_path), span=span).collect()
        assert {r["package"]: r["code"] for r in found} == {name: text * 40 for name, text in texts.items()}
    (tmp_path / "bad.csv").write_bytes(b"package,code\n\xff\xff,x\n")
    with pytest.raises(ValueError):
        scans.scan_csv(spark, str(tmp_path / "bad.csv"), encodings=["utf-8", "utf-16"])


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("n,text\n" + "".join(f'{i},"line {i}\nmore, ""q"""\n' for i in range(20_000)))
    df = csv_ranges.read_csv_ranges(spark, str(path), span=16 << 10, parts=32)
    tasks = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 16 and sum(r["count"] for r in tasks) == 20_000
    assert df.filter(F.col("text") == F.concat(F.lit("line "), "n", F.lit('\nmore, "q"'))).count() == 20_000


def test_scan_labels(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("  CWE-94\nCWE-79 \n\n CLEAN\n\n")
    rows = [tuple(r) for r in scans.scan_labels(spark, str(path)).orderBy("class_idx").collect()]
    assert rows == [(0, "CWE-94"), (1, "CWE-79"), (2, "CLEAN")]
    assert scans.scan_labels(spark, str(tmp_path / "absent.txt")).isEmpty()
    path.write_text("\n\n")
    assert scans.scan_labels(spark, str(path)).isEmpty()


def test_scan_json(spark, tmp_path):
    path = tmp_path / "top.json"
    path.write_text(json.dumps({"rows": [{"project": "a", "download_count": 1}, {"project": "b"}]},
                               indent=1))
    assert [r["project"] for r in scans.scan_top_packages(spark, str(path)).collect()] == ["a", "b"]
    path.write_text('{"file": {"project": "a"}}\n{"file": {"project": "a"}}\n')
    assert scans.scan_download_log(spark, str(path)).count() == 2


def test_write_verdicts(spark, tmp_path):
    df = spark.createDataFrame([("a.py", "Safe")], "file_path string, status string")
    for fmt in ("csv", "json"):
        sinks.write_verdicts(df, str(tmp_path / fmt), fmt)
    assert scans.scan_csv(spark, str(tmp_path / "csv")).first()["status"] == "Safe"
    assert spark.read.json(str(tmp_path / "json")).first()["status"] == "Safe"
    with pytest.raises(ValueError):
        sinks.write_verdicts(df, str(tmp_path / "x"), "excel")
    with pytest.raises(ValueError):
        sinks.write_verdicts(df.filter("false"), str(tmp_path / "y"))


def routed(spark, session, verdict):
    return spark.sql(
        f"SELECT '{session}' AS session_id, 'a.py' AS file_path, 'lstm' AS engine, 'vul' AS task, "
        f"'{verdict}' AS verdict, {str(verdict == 'vul').lower()} AS flagged"
    )


def test_result_store(spark, tmp_path):
    root = str(tmp_path / "store")
    log = lambda s: spark.sql(f"SELECT '{s}' AS session_id, 1L AS total_files")
    sinks.append_results(routed(spark, "s1", "vul"), root, "r1")
    sinks.append_log(log("s1"), root, "r1")
    sinks.append_results(routed(spark, "s2", "vul"), root, "r2")  # never logged
    seen = lambda: sorted(
        (r["session_id"], r["verdict"]) for r in sinks.read_results(spark, root).collect()
    )
    assert seen() == [("s1", "vul")]
    sinks.append_log(log("s2"), root, "r2")
    assert seen() == [("s1", "vul"), ("s2", "vul")]
    sinks.append_results(routed(spark, "s1", "vul_safe"), root, "r3")  # analysed again
    sinks.append_log(log("s1"), root, "r3")
    assert seen() == [("s1", "vul_safe"), ("s2", "vul")]
    sinks.append_results(routed(spark, "s1", "vul_safe"), root, "r3")  # a retry of the same run
    assert seen() == [("s1", "vul_safe"), ("s2", "vul")]
    assert sinks.read_log(spark, root).count() == 2


def test_store_prunes_folders(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.append_results(routed(spark, "s1", "vul").union(routed(spark, "s2", "vul_safe")), root, "r1")
    df = sinks.run_results(spark, root, "r1").filter(F.col("verdict") == "vul")
    assert "PartitionFilters: [" in df._jdf.queryExecution().toString()
    assert len(df.inputFiles()) >= 1 and df.count() == 1


def test_report_text(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([("a\nb\n",)], "value string"), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["a", "b", ""]


def test_models_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from vetloom.operators.models import predict, train_code_classifier

    rows = [(i, ["eval", "input"] if i % 4 == 0 else ["print", "x"], int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, label_idx int")
    model = train_code_classifier(df, buckets=64, iterations=10)
    before = predict(df, model, "predicted", "p").orderBy("id").collect()
    assert [r["predicted"] for r in before] == [r[2] for r in rows]
    assert all(0.5 <= r["p"] <= 1.0 for r in before)
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(PipelineModel, str(tmp_path / "m"))
    assert predict(df, loaded, "predicted", "p").orderBy("id").collect() == before
