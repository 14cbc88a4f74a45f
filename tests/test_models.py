import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog.registry import Tables
from catalog.training import _package_models, training_packages
from vetloom.operators import models as ml
from vetloom.operators import word2vec
from vetloom.operators.tokens import model_vectors, train_word2vec
from vetloom.plans.analysis import analyze_packages, package_store_rows


@pytest.fixture(scope="module")
def trained(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    df = training_packages(t).persist()
    yield t, df, ml.train_package_models(df, trees=10, rounds=5, iterations=50)
    df.unpersist()


def test_models_beat_the_majority(trained):
    _, df, models = trained
    rows = df.count()
    positive = df.filter("label = 1").count()
    majority = max(positive, rows - positive) / rows
    for name, model in models.items():
        out = ml.predict_packages(df, model)
        right = out.filter(F.col("is_malicious") == F.col("label")).count() / rows
        low, high = out.agg(F.min("xgboost_confidence"), F.max("xgboost_confidence")).first()
        assert 0 < majority < right, name
        assert 0.0 <= low <= high <= 1.0


def test_importances(spark, trained):
    _, df, models = trained
    rows = ml.feature_importance(df, models["gradient_boosting"]).collect()
    values = [r["importance"] for r in rows]
    assert len(rows) == 12 and values == sorted(values, reverse=True)
    assert sum(values) == pytest.approx(1.0)


def test_package_plan(trained):
    t, _, models = trained
    out = analyze_packages(
        t.packages, t.popular, t.verdicts, models["random_forest"], email="author_email"
    )
    assert out.columns[:2] == ["name", "xgboost_prediction"]
    rows = package_store_rows(out, "s")
    assert rows.count() == t.packages.count()
    assert rows.filter("final_malicious_status <> (threat_level = 2)").isEmpty()


def test_word2vec_is_repeatable(spark):
    df = spark.createDataFrame([(["a", "b", "c"] * 10,)] * 5, "tokens array<string>").coalesce(1)
    runs = [
        {r["token"]: r["vector"] for r in model_vectors(
            train_word2vec(df, size=4, min_count=2, epochs=2)).collect()}
        for _ in range(2)
    ]
    assert runs[0] == runs[1] and set(runs[0]) == {"a", "b", "c"}


@pytest.mark.parametrize("name", ["train_package_models", "predict", "package_analysis"])
def test_package_queries_fit_whole_models_on_the_training_part(spark, monkeypatch, name):
    fitted, fit = [], ml.train_package_models

    def small(df, **options):
        # Whatever a query does not set has the operator's default.
        fitted.append((df, options))
        return fit(df, **options, trees=2, rounds=2, iterations=5)

    monkeypatch.setattr(ml, "train_package_models", small)
    defaults = {k: p.default for k, p in inspect.signature(fit).parameters.items()}
    assert (defaults["trees"], defaults["rounds"], defaults["iterations"]) == (100, 100, 1000)
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    (df, options), = fitted
    assert not {"trees", "rounds", "iterations"} & set(options)
    train = {r["name"] for r in df.select("name").collect()}
    every = {r["name"] for r in Tables(spark, "/root/testdata/sf0.001").packages.collect()}
    held_out = out.filter("part = 'test'") if "part" in out.columns else out
    rest = {r["name"] for r in held_out.select("name").collect()}
    assert train and rest and not train & rest and train | rest == every


def test_code_classifier_is_whole_and_judged_on_held_out_texts(spark, monkeypatch):
    fitted, fit = [], ml.train_code_classifier

    def small(df, **options):
        fitted.append((df, options))
        return fit(df, **options, iterations=2)

    monkeypatch.setattr(ml, "train_code_classifier", small)
    out = QUERIES["train_code_classifier"](spark, "/root/testdata/sf0.001")
    (df, options), = fitted
    assert options == {}
    train, rest = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (df, out))
    assert train and rest and not train & rest
    assert len(train | rest) == Tables(spark, "/root/testdata/sf0.001").documents.count()


def test_word2vec_query_trains_whole_vectors_in_all_partitions(spark):
    df = spark.createDataFrame([(["a", "b", "c"] * 10,)] * 6, "tokens array<string>").repartition(3)
    assert train_word2vec(df, size=4, min_count=2, epochs=1).getNumPartitions() == 3
    out = QUERIES["train_word2vec"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["token", "vector"]
    assert {len(r["vector"]) for r in out.collect()} == {100}


def test_word2vec_vectors_stay_off_the_driver(spark):
    """Spark's estimator hands its vectors out as rows of the driver, and fails at null texts."""
    topics = [[f"{t}{i}" for i in range(8)] for t in "xy"]
    rng = random.Random(1)
    rows = [([rng.choice(topics[k % 2]) for _ in range(60)] + ["rare"] * (k == 0),) for k in range(200)]
    df = spark.createDataFrame([*rows, (None,), ([],), ([None, "x0"],)], "tokens array<string>").repartition(4)
    out = model_vectors(train_word2vec(df, size=16, min_count=3, epochs=4))
    assert out.inputFiles()
    found = {r["token"]: np.array(r["vector"]) for r in out.collect()}
    assert set(found) == {w for t in topics for w in t}
    unit = np.array([[found[w] / np.linalg.norm(found[w]) for w in t] for t in topics])
    near, far = (unit[0] @ unit[0].T)[~np.eye(8, dtype=bool)].mean(), (unit[0] @ unit[1].T).mean()
    assert near > far + 0.3


def test_leaves_are_a_prefix_code_of_shannon_lengths(spark):
    counts = [10] * 300 + [17] * 40 + [5000, 900, 64, 33]
    rows = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "token string, n bigint")
    code = {r["token"]: f"{r['leaf']:b}"[1:] for r in word2vec.leaves(rows).collect()}
    total = sum(counts)
    for i, n in enumerate(counts):
        depth = len(code[f"w{i}"])
        assert n * 2**depth >= total > n * 2 ** (depth - 1)
    order = sorted(code.values())
    assert len(code) == len(counts) and not any(b.startswith(a) for a, b in zip(order, order[1:]))
    one = spark.createDataFrame([("a", 10)], "token string, n bigint")
    assert [r["leaf"] for r in word2vec.leaves(one).collect()] == [2]
    with pytest.raises(IllegalArgumentException):
        word2vec.leaves(rows.limit(0))


def test_means_join_runs_across_batches():
    rows = [(p, 0, at, float(p + at)) for at in range(5) for p in range(3)]

    def batch(some):
        part, kind, at, x = zip(*some)
        data = [np.full(2, v, np.float32).tobytes() for v in x]
        columns = [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=word2vec._SCHEMA)

    got = [r for b in word2vec._means(2)(batch(rows[i : i + 4]) for i in range(0, len(rows), 4)) for r in b.to_pylist()]
    assert [r["at"] for r in got] == list(range(5))
    assert all(np.frombuffer(r["data"], np.float32).tolist() == [r["at"] + 1.0] * 2 for r in got)


def _pairwise(leaf, words, nodes, word, text, window, rates, rng):
    """The training of a part, pair by pair: the vectors of a batch move together, by at most STEPS single steps."""
    words, nodes, reach = words.astype(float), nodes.astype(float), rng.integers(1, window + 1, len(word))
    ids = sorted({int(x) >> up for x in leaf for up in range(1, int(x).bit_length())})
    at = {n: i for i, n in enumerate(ids)}
    for a in range(0, len(word), word2vec.BATCH):
        moves, counts = {}, {}
        for c in range(a, min(a + word2vec.BATCH, len(word))):
            for i in range(max(c - reach[c], 0), min(c + reach[c] + 1, len(word))):
                if i == c or text[i] != text[c]:
                    continue
                own, goal = word[i], int(leaf[word[c]])
                counts["w", own] = counts.get(("w", own), 0) + 1
                for up in range(1, goal.bit_length()):
                    n = at[goal >> up]
                    error = (goal >> up - 1 & 1 == 0) - 1 / (1 + np.exp(-words[own] @ nodes[n]))
                    counts["n", n] = counts.get(("n", n), 0) + 1
                    moves["w", own] = moves.get(("w", own), 0) + error * nodes[n]
                    moves["n", n] = moves.get(("n", n), 0) + error * words[own]
        for (kind, x), move in moves.items():
            (words if kind == "w" else nodes)[x] += rates[a] * min(1, word2vec.STEPS / counts[kind, x]) * move
    return words, nodes


@pytest.mark.parametrize("window", [1, 5, 40])
def test_batches_looked_up_together_train_as_pair_by_pair(monkeypatch, window):
    rng = np.random.default_rng(2)
    leaf = np.array([2, 6, 14, 30, 62, 126, 127])
    word = rng.choice(7, 400, p=[0.5, 0.2, 0.1, 0.08, 0.05, 0.04, 0.03])
    text = np.repeat(np.arange(5), [1, 150, 70, 2, 177])
    rates = np.linspace(0.025, 0.01, 400)
    monkeypatch.setattr(word2vec, "TOGETHER", 3)
    part = word2vec._Part(leaf, word2vec._first_vectors(leaf, 6, 1), 6)
    part.nodes += rng.normal(size=part.nodes.shape).astype(np.float32) / 4
    expected = _pairwise(leaf, part.words, part.nodes, word, text, window, rates, np.random.default_rng(3))
    part.train(word, text, window, rates, np.random.default_rng(3))
    assert np.allclose(part.words, expected[0], atol=1e-4) and np.allclose(part.nodes, expected[1], atol=1e-4)


def test_word2vec_epochs_leave_the_disk(spark, tmp_path, monkeypatch):
    """An epoch is written in place of the one before the last, and is dealt out again without a join."""
    monkeypatch.setattr(word2vec, "scratch_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    dealt, keep = [], word2vec._keep

    def kept(df, name, path=None):
        if name == "epoch":
            dealt.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name, path)

    monkeypatch.setattr(word2vec, "_keep", kept)
    df = spark.createDataFrame([(["a", "b", "c"] * 10,)] * 6, "tokens array<string>").repartition(3)
    model = train_word2vec(df, size=4, min_count=2, epochs=5)
    assert model.getVectors().count() == 3
    assert len(dealt) == 5 and not any("Join" in plan for plan in dealt)
    last = spark.read.parquet(f"file://{tmp_path}/texts")
    assert last.columns == ["kind", "at", "parts", "data"]
    assert {(r["kind"], tuple(r["parts"])) for r in last.collect()} == {(word2vec.WORD, (0, 1, 2)), (word2vec.NODE, (0, 1, 2))}


def test_package_rows_are_worked_out_once(spark, monkeypatch):
    monkeypatch.setattr(ml, "train_package_models", lambda df, **options: {})
    df, _ = _package_models(Tables(spark, "/root/testdata/sf0.001"))
    assert {name.rsplit("/", 2)[1].split("-")[0] for name in df.inputFiles()} == {"packages"}
