"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from vetloom.operators import joins, skew
from vetloom.operators.similarity import typosquat_flag
from vetloom.operators.tokens import embed_tokens
from vetloom.session import scratch_dir

SF_DIR = "/root/testdata/sf0.001"
TRAINING = {
    "train_package_models", "predict", "feature_importance", "package_analysis", "train_word2vec",
    "score_windows_model", "train_code_classifier",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING))
def test_no_query_pairs_rows_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["session_summary"](spark, SF_DIR)
    scans = [line for line in plan(df).split("\n") if "FileScan" in line]
    assert not any("text:" in line for line in scans)  # summaries never read file contents
    assert any("PushedFilters: [IsNotNull(doc_id)]" in line for line in scans)


def test_in_place_scores_shuffle_only_the_summary(spark):
    assert plan(QUERIES["file_analysis"](spark, SF_DIR)).count("Exchange hashpartitioning") == 1


@pytest.fixture()
def small_thresholds(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        # Rows as few as these would be put together again in one task of a megabyte.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def hot_rows(spark):
    """A third of the rows share one name."""
    return spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        F.md5(F.col("id").cast("string")).alias("pad"),
        F.col("id").cast("double").alias("download_log"),
    )


def test_hot_key_of_a_join_is_split(spark, small_thresholds):
    verdicts = spark.range(0, 60000, 7, 4).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("n"), "id")).alias("package"),
        F.lit("Vulnerable").alias("vulnerability_status"),
        F.lit("CWE-79").alias("cwe_label"),
        F.lit(0.5).alias("confidence"),
    )
    df = joins.join_code_verdicts(hot_rows(spark), verdicts)
    rows = df.collect()
    assert "skew=true" in plan(df)
    assert len(rows) == 60000
    hot = [r for r in rows if r["name"] == "hot"]
    assert len(hot) == 20000 and all(r["vulnerability_status_numeric"] == 1 for r in hot)


def test_hot_session_is_split(spark, small_thresholds):
    results = hot_rows(spark).withColumnRenamed("name", "session_id")
    log = results.select("session_id").distinct().withColumn("total_files", F.lit(1))
    df = joins.session_results(log, results)
    rows = df.collect()
    assert len(rows) == 60000 and "_salt" in plan(df)
    # The rows of the hot session arrive in many partitions, none with more than its share.
    sizes = [r["n"] for r in df.filter("session_id = 'hot'").groupBy(
        F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20000 and max(sizes) < 10000


def test_hot_core_name_is_split(spark, small_thresholds):
    packages = hot_rows(spark)
    popular = spark.createDataFrame([("hat",), ("n1x",)], "project string")
    df = typosquat_flag(packages, popular)
    assert df.filter("is_typo_like").count() >= 20000 and df.count() == 60000
    assert "_salt" in plan(df)


def test_hot_token_is_spread(spark, small_thresholds):
    tokens = hot_rows(spark).select(
        (F.col("download_log") % 100).cast("int").alias("file_id"), F.col("download_log").cast("int").alias("pos"),
        F.col("name").alias("token"),
    )
    vectors = spark.createDataFrame([("hot", [1.0, 2.0]), ("n1", [3.0, 4.0])], "token string, vector array<float>")
    df = embed_tokens(tokens, vectors, "drop", 2)
    assert df.count() == 20001
    assert "hashpartitioning(token" in plan(df) and "_salt" in plan(df)
    sizes = [r["n"] for r in df.filter("token = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20000 and max(sizes) < 10000


def test_only_hot_keys_are_dealt_out(spark):
    rows = hot_rows(spark)
    found = spark.range(1).select(skew.hot_keys(rows, ["name"], 30).alias("m")).first()["m"]
    assert list(found.values()) == [40]  # a third of 30 tasks, in quarters
    assert list(found) == [spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]]
    even = rows.filter("name <> 'hot'")
    assert spark.range(1).select(skew.hot_keys(even, ["name"], 30).alias("m")).first()["m"] == {}
    nothing = spark.range(1).select(skew.hot_keys(rows.filter("false"), ["name"], 30).alias("m")).first()["m"]
    assert nothing == {}
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("n1", 3), (None, 4)], "name string, v int")
    for how in ("inner", "left", "left_semi"):
        part = rows.filter("id < 300") if "id" in rows.columns else rows.limit(300)
        ours = skew.salted_join(part, other, "name", how, parts=30)
        plain = part.join(other, "name", how)
        assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": lambda _, k, d: None, "set": lambda _, k, v: None})()

    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            scratch_dir(Session(master), "x")
    assert scratch_dir(Session("local[2]"), "x").startswith("file://")
