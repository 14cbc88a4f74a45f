"""Embedding near-dedup and top-k search next to brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetloom.llm import embeddings, topk
from vetloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_links(rows, threshold):
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    units = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in fine]
    root, degree = list(range(len(units))), [0] * len(units)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(units)):
        for b in range(a):
            if len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= threshold:
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda k: units[k][0])
                root[y] = x
    out = [(i, degree[k], units[find(k)][0], units[find(k)][0] == i) for k, (i, _) in enumerate(units)]
    known = {i for i, _ in units}
    return sorted(out + [(i, 0, i, True) for i, v in rows if i not in known or (i, v) and not v], key=str)


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.35, 1.0], (n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("cell,block", [(20, 16), (1000, 2048)])
def test_links_match_brute_force_whatever_the_cells(spark, cell, block):
    rows = clustered(1, 400, 6)
    rows += [(1000 + i, rows[7][1]) for i in range(9)] + [(2000, [2 * x for x in rows[7][1]])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    found = embeddings.embedding_dedup(frame, cell=cell, block=block).collect()
    assert sorted(map(tuple, found), key=str) == brute_links(rows, 0.95)


def test_links_of_unusual_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1e300, 2e300]), (3, [1e-300, 2e-300]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, []), (10, [1.0, 2.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component int")
    found = sorted(map(tuple, embeddings.embedding_dedup(frame).collect()))
    assert found == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)] + [(i, 0, i, True) for i in range(4, 11)] + [(11, 1, 11, True), (12, 1, 11, False)]
    with_null = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, unit int")
    assert sorted(map(tuple, embeddings.embedding_dedup(with_null).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]
    assert embeddings.embedding_dedup(frame.where("false")).count() == 0


def test_given_embeddings(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = QUERIES["op1_embedding_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found), key=str) == brute_links(rows, 0.95)


def test_sliced_selection_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, d, most = rng.integers(1, 200), rng.integers(1, 9), int(rng.choice([0, 1, 3, 50, 700, 5000, 1 << 20]))
        values, query = rng.integers(-most, most + 1, (n, d)), rng.integers(-most, most + 1, d)
        ids, k, own = rng.permutation(n), int(rng.integers(1, 12)), int(rng.integers(0, n))
        vecs, scores = topk.best(topk.Slices(values.astype(np.int64), int(rng.choice([1, 2, 4, 8]))), ids, query, own, k)
        exact = values @ query
        order = [i for i in np.lexsort((ids, -exact)) if ids[i] != own][:k]
        assert vecs.tolist() == ids[order].tolist() and scores.tolist() == exact[order].tolist()


def test_carry_save_sum_is_the_sum():
    rng = np.random.default_rng(1)
    values, query = rng.integers(-100, 100, (130, 5)), np.array([3, -7, 0, 12, -1])
    slices = topk.Slices(values, 8)
    bits = slices.sum(query)
    total = sum((np.unpackbits(b.view(np.uint8), bitorder="little")[:130].astype(int) << i) for i, b in enumerate(bits))
    stored = values - values.min(axis=0)
    full = (1 << slices.bits) - 1
    assert (total == sum(abs(q) * (stored[:, d] if q > 0 else full - stored[:, d]) for d, q in enumerate(query))).all()


@pytest.mark.parametrize("block,queries", [(16, 3), (1 << 16, 128)])
def test_top_k_matches_brute_force(spark, block, queries):
    rows = clustered(2, 120, 5)
    rows += [(500 + i, rows[3][1]) for i in range(15)] + [(40, rows[41][1]), (600, None), (601, [1.0, None, 0.0, 0.0, 0.0]), (602, [float("inf")] * 5), (603, [1.0] * 3), (620, [0.5] * 3), (None, rows[1][1]), (700, [])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, block=block, queries=queries).collect()
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = []
    for q, x in ints:
        if q % 20 == 0:
            scored = sorted((-int(x @ y), i) for i, y in ints if i != q and len(y) == len(x))[:7]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, found)) == sorted(expected)
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_no_row_holds_a_block(spark):
    """Candidates and queries move as single rows; a block that is one row is copied for every group and fills the heap."""
    frame = spark.createDataFrame([(*r, 0) for r in clustered(3, 60, 4)], SCHEMA)
    found = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=3, block=16, queries=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan


def test_slices_are_made_once_a_block(monkeypatch):
    rng, made, rows = np.random.default_rng(5), [], []

    class Counted(topk.Slices):
        def __init__(self, values, keep):
            made.append(len(values))
            super().__init__(values, keep)

    monkeypatch.setattr(topk, "Slices", Counted)
    x = rng.integers(-500, 500, (60, 3))
    x[7] *= 1000
    packed = [topk.quantise(v, 1.0) for v in x]
    assert {len(p) for p in packed} == {6, 12}
    for part in range(2):
        rows += [(3, part, 0, i, None, packed[i]) for i in range(part, 60, 2)] + [(3, part, 0, i, i, packed[i]) for i in range(12)]
    rows += [(3, 2, 0, 1, 1, packed[1])]
    names, types = ["dim", "part", "slot", "vec", "ask", "q"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 7]), types)], names=names) for a in range(0, len(rows), 7)]
    found = [r for b in topk._search(4, 8, 5)(iter(batches)) for r in b.to_pylist()]
    assert made == [30, 30]
    for i in range(12):
        for part in range(2):
            best = sorted((-int(x[i] @ x[j]), j) for j in range(part, 60, 2) if j != i)[:4]
            assert [(r["vec_id"], r["score"]) for r in found if r["ask"] == i and r["vec_id"] % 2 == part] == [(j, -s) for s, j in best]


def test_blocks_are_bounded_by_bytes_and_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 512)
    rows = [(10 + i, [0.5 * i, -1.0, 2.0, 40000.0 * (i == 3)]) for i in range(20)] + [(5, [1.0, 1.0, 1.0, 1.0])] * 90
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    found = topk.top_k(frame, F.col("vec_id") % 5 == 0, k=25, queries=1)
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    expected = []
    for q, x in {i: x for i, x in ints if i % 5 == 0}.items():
        scored = sorted((-int(x @ y), i) for i, y in ints if i != q)[:25]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
