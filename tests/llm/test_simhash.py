"""SimHash near-dedup next to brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash

from vetloom.llm import simhash
from vetloom.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    near = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = groups(prints, near)
    found = simhash.simhash_dedup(docs).collect()
    assert {r.doc: r.fp % (1 << 64) for r in found} == prints
    assert {r.doc: r.component for r in found} == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in expected.items() if d == c)


def near_prints(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)]
    out = {0}
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_links_between_blocks_and_tables(spark):
    prints = near_prints(4, 300)
    expected = groups(range(300), [(a, b) for a, b in combinations(range(300), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    for block in (16, 4096):
        found = {r.node: r.component for r in components(simhash.links(distinct, 3, block), "a", "b").collect()}
        assert {i: found.get(i, i) for i in range(300)} == expected


def test_planes_tell_distances():
    prints = np.array(near_prints(5, 200), dtype=np.uint64)
    planes = simhash.bit_planes(prints)
    for radius in (0, 1, 3, 4, 7):
        for shift in (1, 5, 63, 64, 65, 130):
            rows = len(prints) - shift
            expected = [i for i in range(rows) if int(prints[i] ^ prints[i + shift]).bit_count() <= radius]
            assert simhash.within(planes, rows, shift, radius).tolist() == expected


def test_tables_lose_no_pair():
    rng = random.Random(6)
    for rows in (10, 1 << 22, 1 << 31, 1 << 40):
        masks = simhash.tables_for(rows, 3)
        for _ in range(200):
            differ = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & differ == 0 for m in masks)


def test_unusual_rows(spark):
    text = "one two three four five six"
    rows = [(5, None, 1), (4, "", 1), (9, " \n\t", 1), (3, text, 1), (3, text, 1), (None, text, 1), (8, "A b", 1), (7, "a  B", 1), (6, "word " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted(((r.doc, r.component) for r in simhash.simhash_dedup(docs).collect()), key=str)
    assert found == sorted([(5, 4), (4, 4), (9, 4), (3, 3), (3, 3), (None, 3), (8, 7), (7, 7), (6, 6)], key=str)
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([4, 3, None, 7, 6], key=str)
    assert simhash.simhash_dedup(docs.where("false")).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    expected = groups({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges for n in (a, b) if a != b}
    found = components(spark.createDataFrame(edges + edges[:5], "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {n: c for n, c in expected.items() if n in linked}
    assert len(found) == len(linked)
