"""Boosting next to a plain loop over rows, and its trees as a table."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector

from vetloom.operators import boosting
from vetloom.operators.boosting import Boosted, Penalty, gradient_sums, split_gains, train_boosting, walk


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(600):
        x = [rng.gauss(0, 1), float(rng.randint(0, 3)), rng.random(), 1.0, float(i % 2)]
        made.append((i, x, float(x[0] + 0.7 * (x[1] == 2) + rng.gauss(0, 0.3) > 0.4)))
    df = spark.createDataFrame(made, "id int, values array<double>, label double").withColumn("features", array_to_vector("values")).persist()
    yield df, made
    df.unpersist()


def test_gains_are_those_of_a_plain_loop(spark):
    rng = random.Random(1)
    given = [(rng.choice([1, 2]), rng.randint(0, 1), [rng.randint(0, 6), rng.randint(0, 2)], rng.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(given, "node int, label int, bins array<int>, margin double")
    penalty = Penalty(0.7, 0.3)
    found = {(r.node, r.feature, r.bin): r.gain for r in split_gains(gradient_sums(df, "margin", "node", [0, 1]), penalty).collect()}
    p = lambda m: 1 / (1 + math.exp(-m))
    expected = {}
    for node in (1, 2):
        for f in (0, 1):
            own = [(b[f], p(m) - y, p(m) * (1 - p(m))) for n, y, b, m in given if n == node]
            for cut in range(max(b for b, _, _ in own)):
                side = lambda keep: [sum(x) for x in zip(*[(g, h) for b, g, h in own if keep(b)])]
                score = lambda s: max(abs(s[0]) - 0.7, 0) ** 2 / (s[1] + 0.3)
                if any(b == cut for b, _, _ in own):
                    expected[node, f, cut] = score(side(lambda b: b <= cut)) + score(side(lambda b: b > cut)) - score(side(lambda b: True))
    assert set(found) == set(expected)
    assert all(found[k] == pytest.approx(expected[k], abs=1e-3) for k in found)


def test_fitted_trees(spark, rows):
    df, made = rows
    model = train_boosting(df, rounds=12, columns=0.9)
    assert len(model.trees) == 12 and all(max(t) < 16 for t in model.trees)
    out = model.transform(df).select("id", "label", "prediction", "probability").collect()
    right = sum(r.label == r.prediction for r in out) / len(out)
    assert right > 0.85
    assert sum(model.featureImportances) == pytest.approx(1.0) and model.featureImportances[3] == 0.0

    def margin(x):
        total = 0.0
        for tree in model.trees:
            at = 1
            while not isinstance(tree[at], float):
                f, b, _ = tree[at]
                at = 2 * at + (x[f] > model.cuts[f][b])
            total += tree[at]
        return total

    plain = {i: margin(x) for i, x, _ in made}
    for r in out:
        assert r.probability[1] == pytest.approx(1 / (1 + math.exp(-plain[r.id])))
    table = model.table(spark)
    walked = {r.id: r.margin for r in walk(df, table, "id").collect()}
    assert walked == pytest.approx(plain)
    again = Boosted.from_table(table)
    both = df.selectExpr(f"{model.margin('values')} AS a", f"{again.margin('values')} AS b")
    assert both.filter("abs(a - b) > 1e-12").isEmpty()
    same = train_boosting(df.repartition(7), rounds=2, columns=0.9)
    assert same.trees == model.trees[:2]


def test_penalties_shrink_leaves(spark, rows):
    df, _ = rows
    leaves = lambda m: [abs(n) for t in m.trees for n in t.values() if isinstance(n, float)]
    free = train_boosting(df, rounds=1, columns=0.9, penalty=Penalty(0.0, 0.0))
    held = train_boosting(df, rounds=1, columns=0.9, penalty=Penalty(20.0, 50.0))
    assert max(leaves(held)) < max(leaves(free))
    nothing = train_boosting(df, rounds=2, columns=0.9, penalty=Penalty(1e6, 0.2))
    assert nothing.trees == [] and nothing.transform(df).filter("prediction = 1").isEmpty()


def test_cells_are_plain_numbers_and_keep_missing_and_negative_bins(spark):
    given = [(1, 0, [-5, None], 0.0), (1, 1, [-5, 7], 0.0), (1, 1, [2147483647, -2147483648], 0.0), (2, 1, [None, 7], 0.0)]
    df = spark.createDataFrame(given, "node int, label int, bins array<int>, margin double")
    sums = gradient_sums(df, "margin", "node", [0, 1])
    found = {(r.node, r.feature, r.bin): (r.g, r.h) for r in sums.collect()}
    assert found == {
        (1, 0, -5): (0.0, 0.5), (1, 0, 2147483647): (-0.5, 0.25), (2, 0, None): (-0.5, 0.25),
        (1, 1, None): (0.5, 0.25), (1, 1, 7): (-0.5, 0.25), (1, 1, -2147483648): (-0.5, 0.25), (2, 1, 7): (-0.5, 0.25),
    }
    assert "explode(array(c0" in sums._jdf.queryExecution().optimizedPlan().toString()


def test_a_level_reads_the_drawn_features_only(spark, rows, monkeypatch):
    seen, sums = [], boosting.gradient_sums
    monkeypatch.setattr(boosting, "gradient_sums", lambda *a: seen.append((a[3], sums(*a))) or seen[-1][1])
    train_boosting(rows[0], rounds=1, columns=0.4)
    drawn, df = seen[0]
    scan, = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert [i for i in range(5) if f"b{i}#" in scan] == drawn and len(drawn) == 2
