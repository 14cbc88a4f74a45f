"""The pipeline stage by stage, next to brute force on a small table."""

import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from vetloom.llm import mixing

from .test_simhash import groups, plain_fingerprint
from .test_suffixes import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with copies, a shared passage, text without letters and unusual rows."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    passage = rows[5][1][:400]
    extra = [(1000, rows[3][1], "fr", "src0", 1), (1001, passage + rows[9][1][::-1][:300], "en", "src1", 1), (1002, None, "en", "src2", 0),
             (1003, "", None, None, 0), (1004, "12 34 !!", "en", "src3", 8), (1005, rows[7][1] + " end", "en", None, 1)]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + extra, schema).coalesce(2).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = cp.keep(stage(spark, docs, folder), name)
        results.append((before, docs.collect()))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    (before, named), (_, single), (_, cut), (_, mixed), (_, encoded) = results
    assert {r.doc_id for r in before} - {r.doc_id for r in named} == {1002, 1003, 1004}

    prints = {r.doc_id: plain_fingerprint(r.text) for r in named}
    parts = groups(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(r.doc_id for r in single) == sorted(d for d, c in parts.items() if d == c)
    assert 1000 not in {r.doc_id for r in single}

    left = {d: (n, k.decode("utf-8", "ignore")) for d, _, n, _, k in brute([(r.doc_id, r.text) for r in single], 50)}
    assert {r.doc_id: r.text for r in cut} == {d: t for d, (n, t) in left.items() if t or not n}
    assert all(r.n_chars == len(r.text) for r in cut)

    times = {r.doc: r.times for r in mixing.mix(spark.createDataFrame(cut)).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(d for d, n in times.items() for _ in range(n))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [(r.doc_id, np.array(tokenizer.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed]
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in encoded) == sorted(expected)


def test_run_gives_what_the_stages_give_and_empty_tables_work(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
    assert cp.run(spark, folder).count() > 100
