"""Operators that split hot groups, against plain Python on small or forced-small settings."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetloom.operators import sampling, scoring
from vetloom.operators.aggregates import merge_package_source, session_detail, session_summary
from vetloom.operators.aggregates import profile
from vetloom.operators.features import quantile_flags
from vetloom.operators.files import find_source, find_sources
from vetloom.operators.ordering import page_by_key, page_index
from vetloom.operators.quantiles import exact_quantiles, exact_quantiles_of, ordered_key, value_of_key
from vetloom.operators.similarity import core_pairs, typosquat_flag


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(7)
    names = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(120)}
    other = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(90)}
    left = spark.createDataFrame([(n,) for n in names], "core string")
    right = spark.createDataFrame([(n,) for n in other], "core string")
    got = [tuple(r) for r in core_pairs(left, right).collect()]
    expected = {(a, b) for a, b in itertools.product(names, other) if distance(a, b) == 1}
    assert len(got) == len(set(got)) and set(got) == expected


def test_typosquat_flag(spark):
    packages = spark.createDataFrame(
        [("requets-x",), ("requests",), ("Numpi.core",), ("other",), (None,)], "name string"
    )
    popular = spark.createDataFrame([("requests_lib",), ("numpy",)], "project string")
    flags = {r["name"]: r["is_typo_like"] for r in typosquat_flag(packages, popular).collect()}
    assert flags == {
        "requets-x": True, "requests": False, "Numpi.core": True, "other": False, None: False
    }


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "constant", "skewed"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=4000),
        "ties": rng.integers(0, 5, 4000).astype(float),
        "two": np.repeat([1.0, 2.0], [200, 3800]),
        "constant": np.full(4000, 2.5),
        "skewed": np.where(rng.random(4000) < 0.4, 0.0, np.exp(rng.normal(size=4000) * 5)),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    expected = [np.quantile(values, p) for p in probs]
    for digit in (16, 11):
        assert exact_quantiles(df, "v", probs, digit) == pytest.approx(expected)


def test_keys_have_the_order_and_bits_of_doubles(spark):
    rng = np.random.default_rng(8)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, float(np.nextafter(2.0**-1022, 0)), 1.7976931348623157e308, float("inf"), -float("inf"), float("nan")]
    values += [float(np.nextafter(2.0**e, d)) for e in range(-1021, 1024, 37) for d in (0, 1e309)] + [2.0**e for e in range(-1074, 1024)]
    values += rng.integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64).view(np.float64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_key(F.col("v")).alias("k"))
    rows = df.select("v", "k", value_of_key(F.col("k")).alias("back")).collect()
    for r in rows:
        bits = int(np.float64(abs(r.v)).view(np.int64))
        assert np.isnan(r.v) and r.k == (1 << 63) - 1 or r.k == (-bits if r.v < 0 else bits)
        assert r.back == r.v or np.isnan(r.v) and np.isnan(r.back)


def test_quantiles_of_columns_run_with_the_plan_only(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(3000, 2)) * [1e-310, 1e300]
    df = spark.createDataFrame([(float(a), float(b) if i % 3 else None, None) for i, (a, b) in enumerate(data)], "`a.b` double, b double, c double")
    probs = [0.25, 0.5, 0.9]
    spark.sparkContext.setJobGroup("quantiles", "plans only")
    found = spark.range(1).select(exact_quantiles_of(df, ["a.b", "b", "c"], probs).alias("q"))
    flagged, profiled = quantile_flags(df, "b"), profile(df.select("b", "c"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    spark.sparkContext.setJobGroup("", "")
    q = found.first()["q"]
    assert q["a.b"] == pytest.approx(np.quantile(data[:, 0], probs).tolist(), rel=1e-12)
    b = [v for i, v in enumerate(data[:, 1]) if i % 3]
    assert q["b"] == pytest.approx(np.quantile(b, probs).tolist()) and "c" not in q
    assert flagged.filter("download_too_low").count() == 100
    rows = {r["column"]: r for r in profiled.collect()}
    assert rows["b"]["q50"] == pytest.approx(np.quantile(b, 0.5)) and rows["c"]["q50"] is None


def test_no_rows_have_no_quantiles(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_triangular_score(spark):
    df = spark.createDataFrame(
        [(1, i, p) for i, p in enumerate((0.1, 0.9, 0.4))] + [(2, 0, 0.3)],
        "file_id int, chunk_idx int, prob double",
    )
    got = {r["file_id"]: r["prob"] for r in scoring.agg_triangular(df).collect()}
    assert got[1] == pytest.approx(0.824166666667, abs=1e-12) and got[2] == pytest.approx(0.3)


def test_chunk_count_is_spread_over_blocks(spark):
    rows = [(1, i, 0.5) for i in range(50)] + [(2, i, 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "file_id int, chunk_idx int, prob double")
    out = scoring.with_chunk_count(df, block=4).collect()
    assert len(out) == 54
    assert {(r["file_id"], r["n_chunks"]) for r in out} == {(1, 50), (2, 4)}


def test_exponential_and_top_classes(spark):
    probs = {(0, 0): 0.2, (0, 7): 0.8, (1, 0): 0.6, (1, 7): 0.4}
    df = spark.createDataFrame(
        [(9, i, c, p) for (i, c), p in probs.items()],
        "file_id int, chunk_idx int, class_idx int, prob double",
    )
    scores = {r["class_idx"]: r["prob"] for r in scoring.agg_exponential(df).collect()}
    w = [math.exp(-0.1 * abs(i - 1)) for i in range(2)]
    for c in (0, 7):
        mean = sum(w[i] * probs[i, c] for i in range(2)) / sum(w)
        assert scores[c] == pytest.approx(0.6 * mean + 0.4 * max(probs[0, c], probs[1, c]))
    per_file = scoring.agg_exponential(df)
    assert scoring.top_cwe(per_file).first()["class_idx"] == 0  # the clean class leads
    only_clean = per_file.filter("class_idx = 7")
    assert scoring.top_cwe(only_clean).first()["class_idx"] == 7


def labelled(spark):
    rows = [(i, "hot" if i % 3 else "b" if i % 2 else "c") for i in range(900)]
    return spark.createDataFrame(rows, "id int, label string")


def test_balanced_sample_is_exact_and_repeatable(spark):
    df = labelled(spark)
    out = sampling.balanced_sample(df, "label", "id", seed=5)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"hot": 150, "b": 150, "c": 150}
    again = sampling.balanced_sample(df.repartition(5), "label", "id", seed=5)
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in again.collect())
    assert out.select("id").distinct().count() == 450


def test_splits_are_disjoint_complete_and_exact(spark):
    df = labelled(spark)
    for digits in (1, 3):
        cut = sampling.hash_cut(
            df, F.col("label"), "id", sampling._fractions((0.8, 0.1, 0.1)), digits=digits
        )
        counts = {(r["label"], r["_part"]): r["count"]
                  for r in cut.groupBy("label", "_part").count().collect()}
        assert counts == {
            ("hot", 0): 480, ("hot", 1): 60, ("hot", 2): 60,
            ("b", 0): 120, ("b", 1): 15, ("b", 2): 15,
            ("c", 0): 120, ("c", 1): 15, ("c", 2): 15,
        }
        assert cut.select("id").distinct().count() == 900
    train = sampling.random_split(df, "id").filter("part = 'train'")
    assert train.count() == 720


def test_stratified_split_falls_back(spark):
    df = spark.createDataFrame([(i, "a") for i in range(19)] + [(99, "b")], "id int, label string")
    parts = sampling.stratified_split(df, "label", "id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 16, "val": 2, "test": 2}


def test_merged_source_parts_equal_the_whole(spark):
    files = [("hot/%02d.py" % i, f"\n x{i} = 1 # c\n y\n") for i in range(60)]
    files += [("source/small/a.py", "a\n"), ("source/small/b.py", "# all\n"), ("empty/a.py", " # x\n")]
    df = spark.createDataFrame([(p, c, len(c)) for p, c in files], "path string, content string, size int")
    rows = merge_package_source(df).orderBy("package", "part").collect()
    assert {r.package for r in rows} == {"hot", "small"}
    assert [(r.part, r.path, r.code) for r in rows if r.package == "small"] == [(0, "source/small/a.py", "a\n")]
    hot = [r for r in rows if r.package == "hot"]
    assert [r.part for r in hot] == list(range(60)) and [r.path for r in hot] == sorted(r.path for r in hot)
    assert "\n".join(r.code for r in hot) == "\n".join(c.replace(" # c", " ") for _, c in files[:60])


def test_summary_invariants(spark):
    rows = [("s", bool(i % 2), bool(i % 3 == 0), 0.5) for i in range(30)] + [("s", None, None, 9.0)]
    df = spark.createDataFrame(
        rows, "session_id string, is_vulnerable boolean, is_malicious boolean, analysis_time double"
    )
    for mode in ("both", "vul", "mal"):
        r = session_summary(df, mode).first()
        assert (r["input_files"], r["total_files"], r["skipped_files"]) == (31, 30, 1)
        assert r["analysis_duration"] == pytest.approx(15.0)
    vul, mal = (session_summary(df, m).first() for m in ("vul", "mal"))
    assert vul["safe_files"] + vul["vulnerable_files"] == vul["total_files"]
    assert mal["safe_files"] + mal["malicious_files"] == mal["total_files"]


def test_session_detail_keeps_sessions_without_results(spark):
    log = spark.sql(
        "SELECT s AS session_id, timestamp'2024-01-01' AS upload_time, false AS is_mal, "
        "false AS is_ml, 0L AS safe_files FROM VALUES ('a'), ('b') AS t(s)"
    )
    results = spark.sql(
        "SELECT 'a' AS session_id, 'vul' AS task, false AS flagged, 'p' AS file_path, "
        "'n' AS file_name, '' AS status, CAST(null AS double) AS probability, "
        "CAST(null AS string) AS label, '' AS cwe_label, CAST(null AS double) AS analysis_time"
    )
    rows = {r["session_id"]: r for r in session_detail(log, results).collect()}
    assert rows["a"]["safe_files"] == 1 and rows["a"]["cwe_label"] == "Safe"
    assert rows["a"]["upload_time"] == "2024-01-01T00:00:00"
    assert rows["b"]["result_list"] is None and rows["b"]["safe_files"] == 0


def test_equal_names_make_one_row_each(spark):
    files = spark.range(3000).select(F.lit("s").alias("session_id"), F.concat(F.lit("d"), "id", F.lit("/same.py")).alias("path"))
    wanted = spark.range(3000).select(F.lit("s").alias("session_id"), F.concat(F.lit("other"), "id", F.lit("/"), F.when(F.col("id") % 2 == 0, "same.py").otherwise("me.py")).alias("wanted"))
    rows = find_sources(files, wanted).collect()
    assert len(rows) == 3000 and {r["path"] for r in rows} == {"d0/same.py"}
    assert {(r["wanted"].endswith("same.py"), r["match_kind"]) for r in rows} == {(True, 1), (False, 2)}


def test_requests_find_what_one_by_one_they_find(spark):
    rng = random.Random(9)
    paths = ["/".join(rng.choice("ab") for _ in range(rng.randint(0, 2))) + "/" + "".join(rng.choice("xy.") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    files = spark.createDataFrame([(rng.choice("st"), p) for p in paths], "session_id string, path string")
    asked = [(rng.choice("stu"), rng.choice([*paths, "x", "y.", "q/xy", "zz"])) for _ in range(40)]
    found = {(r["session_id"], r["wanted"]): (r["match_kind"], r["path"]) for r in find_sources(files, spark.createDataFrame(asked, "session_id string, wanted string")).collect()}
    for session, path in set(asked):
        one = [(r["match_kind"], r["path"]) for r in find_source(files, session, path).collect()]
        assert [found[session, path]] == one if one else (session, path) not in found


def test_pages_by_key(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", None if i % 50 == 0 else dt.datetime(2024, 1, 1, rng.randint(0, 5))) for i in range(205)]
    log = spark.createDataFrame(rows, "session_id string, created_at timestamp").repartition(6)
    index = page_index(log, 20, parts=5)
    every = [r["session_id"] for r in log.orderBy(F.desc("created_at"), "session_id").collect()]
    assert sorted((r["page"], r["first_id"]) for r in index.collect()) == [(i, every[20 * i]) for i in range(11)]
    for page in (0, 3, 10, 11):
        df = page_by_key(log, index, page)
        assert [r["session_id"] for r in df.collect()] == every[20 * page : 20 * page + 20]
    assert page_index(log.filter("false"), 20).count() == 0
