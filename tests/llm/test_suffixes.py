"""Suffix-array dedup next to brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vetloom.llm import suffixes


def brute(rows, match):
    """Kept bytes, removed bytes and removed runs per row by comparing every window."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - match + 1):
            key = data[i : i + match]
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - match + 1):
            if first[data[i : i + match]] < doc:
                covered[i : i + match] = b"\1" * match
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out.append((doc, len(data), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), kept))
    return sorted(out)


def ours(spark, rows, match, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.remove_repeats(docs, match=match, **options).collect()
    return sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)


def sample(seed):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "été", "漢字", "a", "aaaaaaaaaa", "\0", "x y"]
    passage = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for doc in range(40):
        text = " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(rng.randrange(40)))
        if rng.random() < 0.6:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passage)[rng.randrange(20) :] + text[at:]
        rows.append((doc, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, ""), (103, None), (104, "a" * 300), (105, "b" + "a" * 200), (106, "ab" * 100), (107, "ab" * 90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = sample(seed)
    assert ours(spark, rows, 50) == brute(rows, 50)


def test_hot_anchors_and_parts_give_the_same(spark, monkeypatch):
    rows = sample(3)
    assert ours(spark, rows, 50, hot=1) == brute(rows, 50)
    strings = sorted({t[i : i + 70].encode() for _, t in rows if t for i in range(0, max(len(t) - 70, 0), 7)})
    strings = [s for s in strings if len(s) >= 50]
    holder = np.arange(len(strings))[::-1].copy()
    whole = suffixes.smallest_holders(strings, holder, 50)
    for size in (100, 777, 5000):
        for a, b in zip(whole, suffixes.smallest_holders(strings, holder, 50, size)):
            assert a.tolist() == b.tolist()


def test_ids_that_repeat_or_miss_and_other_columns(spark):
    long = "the same long passage of more than fifty bytes, once more and again"
    docs = spark.createDataFrame(
        [(1, long, "x"), (1, long + "!", "y"), (None, long, "z"), (2, "0" + long, None), (2, "other", "n"), (2, "0" + long, "n")],
        "doc_id long, text string, kept string",
    )
    found = [(r.row.doc_id, r.row.kept, bytes(r.kept).decode()) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted(
        [(1, "x", long), (1, "y", long + "!"), (None, "z", long), (2, None, "0"), (2, "n", "other"), (2, "n", "0")], key=str)
    assert suffixes.without_repeats(docs).columns == docs.columns
    assert suffixes.remove_repeats(docs.where("false")).count() == 0


def test_cut_characters_go(spark):
    same = "漢" * 30
    docs = spark.createDataFrame([(1, same + "漢"), (2, "è" + same + "漣ê")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixes.without_repeats(docs).collect()}[2] == "èê"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=30), min_size=1, max_size=12, unique=True))
def test_suffix_array_and_common_prefixes(strings):
    lengths = np.array([len(s) for s in strings])
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    symbols[starts + lengths] = 0
    words = suffixes._words(symbols)
    order = suffixes.suffix_array(words)
    tails = [symbols[i:].tolist() for i in range(len(symbols))]
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: tails[i])
    shared = suffixes.repeats_previous(words, order, 6)
    expected = [False] + [tails[a][:6] == tails[b][:6] and len(tails[a]) >= 6 for a, b in zip(order, order[1:])]
    assert shared.tolist() == expected


def test_query_on_given_table(spark):
    from vetloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute(rows, 50)]
    assert sorted(map(tuple, QUERIES["op8_suffix_dedup"](spark, "/root/testdata/sf0.001").collect())) == expected
