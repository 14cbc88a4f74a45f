"""Hard negatives next to brute force; intervals hold what they bound."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, key string"


def brute(rows, every, positives=5, kept=3, share=(50, 95), scale=256):
    clamp = lambda s: max(-negatives.LONG, min(negatives.LONG, s))
    fine = [(i, label, [floor(Fraction(scale) * Fraction(x)) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for a, label, q in {(i, x, tuple(v)) for i, x, v in fine if i % every == 0}:
        scored = [(-clamp(sum(x * y for x, y in zip(q, v))), i, other == label) for i, other, v in fine if i != a and len(v) == len(q)]
        for p, near, _ in sorted(s for s in scored if s[2])[:positives]:
            inside = sorted(s for s in scored if not s[2] and share[0] * -p <= 100 * -s[0] <= share[1] * -p)[:kept]
            out += [(a, near, r, i, -p, -s) for r, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    home = rng.integers(0, 6, n)
    x = centres[home] + rng.normal(size=(n, dim)) * spread
    return [(i, int(h if rng.random() < 0.7 else rng.integers(0, 6)), v.tolist()) for i, (h, v) in enumerate(zip(home, x))]


@pytest.mark.parametrize("dim,spread,least", [(5, 0.3, 1 << 10), (70, 0.8, 1 << 12), (64, 0.2, 1 << 20)])
def test_matches_brute_force(spark, dim, spread, least):
    rows = clustered(dim, 260, dim, spread)
    rows += [(400 + i, i % 3, rows[10][2]) for i in range(12)] + [(20, 4, rows[21][2]), rows[30], rows[31]]
    rows += [(500, None, rows[1][2]), (None, 1, rows[1][2]), (510, 1, None), (520, 1, [1.0, None] * dim), (530, 2, [float("nan")] * dim),
             (540, 2, []), (550, 2, [1.0, 2.0]), (551, 2, [1.0, 2.5]), (552, 3, [1.0, 1.0]), (560, 0, [0.0] * dim)]
    frame = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
    found = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, least_bytes=least, group_bytes=4096).collect()
    assert sorted(map(tuple, found)) == brute(rows, 10)


def test_large_components_are_scored_in_whole_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(size=4) * 10.0 ** rng.choice([0, 3, 9, 17, 300])).tolist()) for i in range(90)]
    frame = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    found = negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found)) == brute(rows, 5)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0).count() == 0


def test_intervals_hold_the_scores_and_leave_few_rows():
    rng = np.random.default_rng(6)
    for dim, most in ((3, 10), (64, 100), (100, 1 << 20)):
        values, q = rng.integers(-most, most, (500, dim)), rng.integers(-most, most, (7, dim))
        codes, anchors, widths = negatives.Codes(values), negatives.Anchors(q, negatives.LEVELS), []
        for levels in range(1, negatives.LEVELS + 1):
            low, high = codes.intervals(anchors, np.arange(7), slice(0, 500), levels)
            assert ((low <= q @ values.T) & (q @ values.T <= high)).all()
            widths.append((high - low).mean())
        assert widths == sorted(widths, reverse=True)
    centres = rng.normal(size=(20, 64)) * 100
    values = np.rint(centres[rng.integers(0, 20, 5000)] + rng.normal(size=(5000, 64)) * 10).astype(np.int64)
    codes, scored = negatives.Codes(values), []
    plain = codes.scores
    codes.scores = lambda anchors, i, at: scored.append(len(at)) or plain(anchors, i, at)
    ids = np.arange(5000)
    block = negatives.Block(ids, ["a"] * 5000, codes)
    for i, found, scores in block.best(negatives.Anchors(values[:20], negatives.LEVELS), list(range(20)), ["a"] * 20, 5):
        exact = values @ values[i]
        assert found.tolist() == [j for j in np.lexsort((ids, -exact)) if j != i][:5] and (scores == exact[found]).all()
    assert len(scored) == 20 and max(scored) < 1000
