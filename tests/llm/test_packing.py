"""Packing: every id once, limits kept, nothing padded, next to the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vetloom.llm import packing
from vetloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "example long, ids binary, mask binary, offset int, sequence_id string"


def whole(rows, limits):
    """Ids of each example put together again; checks every sequence on the way."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        pieces[r.example].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == np.r_[0, np.cumsum([r.length for r in own])][:-1].tolist()
        assert total <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
        assert {r.sequence_tokens for r in own} == {total}
    out = {}
    for key, own in pieces.items():
        own.sort()
        assert [s for s, _ in own] == np.r_[0, np.cumsum([len(x) // 4 for _, x in own])][:-1].tolist()
        out[key] = b"".join(x for _, x in own)
    return out


@pytest.mark.parametrize("limits", [
    packing.Limits(64, 4, 64), packing.Limits(64, 64, 20), packing.Limits(100, 3, 30), packing.Limits(1, 1, 1), packing.Limits(2048, 256, 2048)])
def test_limits_hold_and_every_id_lies_in_one_piece(spark, limits):
    rng, rows = np.random.default_rng(3), []
    for i in range(300):
        n = int(rng.choice([0, 1, 5, 30, 64, 200, 1500], p=[0.1, 0.2, 0.3, 0.2, 0.1, 0.08, 0.02]))
        ids, mask = rng.integers(0, 50_000, n).astype("<u4"), (rng.random(n) < rng.choice([0, 0.2, 1])).astype(np.uint8)
        rows.append((i, ids.tobytes(), None if i % 7 == 0 else mask.tobytes(), i, "clash"))
    rows += [(1000, None, None, 0, None), (None, np.arange(9, dtype="<u4").tobytes(), None, 0, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = packing.pack_examples(frame, limits=limits, pool=40).collect()
    assert whole(found, limits) == {k: bytes(x) for k, x, *_ in rows if x}
    loss = defaultdict(int)
    for r in found:
        loss[r.example] += r.loss_tokens
    for k, x, mask, *_ in rows:
        assert loss[k] == (len(x or b"") // 4 if mask is None else sum(m != 0 for m in mask))


def test_dot_product_prefers_what_the_bin_has_most_of():
    packer = packing.Packer(packing.Limits(100, 10, 10))
    for key, n, loss in (("loss", 20, 10), ("plain", 80, 0), ("small", 5, 5)):
        packer._put(packing.Example(key, np.arange(n), np.r_[np.ones(loss), np.zeros(n - loss)]), 0, n)
    first = packer._sequence()
    assert [(e.key, a, b) for e, a, b in first] == [("loss", 0, 20), ("plain", 0, 80)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_examples(empty).count() == 0
    twice = spark.createDataFrame([(1, np.arange(3, dtype="<u4").tobytes(), None, 0, "")] * 2, SCHEMA).coalesce(1)
    assert sum(r.length for r in packing.pack_examples(twice).collect()) == 6
    short = spark.createDataFrame([(1, np.arange(3, dtype="<u4").tobytes(), b"\1", 0, "")], SCHEMA)
    with pytest.raises(Exception, match="mask"):
        packing.pack_examples(short).collect()
    with pytest.raises(ValueError):
        packing.Limits(0, 1, 1)


def test_texts_have_the_ids_of_the_library(spark):
    library = Tokenizer.from_file(PATH)
    given = ["", None, " ", "a", "héllo \x85\xa0 wörld\x1c", "<|endoftext|> x<|endoftext|>", "汉字 😀 " * 900, "x" * 9000, " \n\t" * 700, "don't 123 ½ ²"] * 3
    given += [" " * 2_000_000 + "end"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(given)], "doc_id long, text string, start long").repartition(4)
    found = whole(packing.pack_texts(docs, PATH).collect(), packing.Limits())
    for i, t in enumerate(given):
        assert found[i] == np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    found, library = QUERIES["op13_packing"](spark, sf).collect(), Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(pieces) == len(docs)
    for d in docs:
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == np.r_[0, np.cumsum([n for _, n in own])][:-1].tolist()
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
