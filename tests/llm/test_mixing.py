"""Mixing: targets, thresholds and unusual rows."""

import random

from vetloom.llm import mixing


def water(sizes, most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest, shared = total - sum(full.values()), sum(w for s, w in weight.items() if s not in full)
        target = full | {s: rest * w / shared for s, w in weight.items() if s not in full}
        over = [s for s in target if s not in full and target[s] > most * sizes[s]]
        if not over:
            return target
        full |= {s: most * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    names = ["big", "b", "c", "\U0001F642", "～", "empty", None, "d"]
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["big"] * 10 + names)) for i in range(3000)]
    rows += [(9000, " \x1c\x0b", "empty2"), (9001, None, "empty2"), (9002, "a\xa0b\x85c d", "few")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    found = mixing.mix(docs).collect()
    size = {i: len([w for w in (t or "").encode().split() if w]) for i, t, _ in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    target = water(sums)
    taken = {}
    for r in found:
        assert r.size == size[r.doc] and r.source_size == sums[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.times <= 3
        taken[r.source] = taken.get(r.source, 0) + r.times * r.size
    assert len(found) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 60 for s in sums)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in found)


def test_unusual_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "y"), (None, "d e", "y"), (2, None, None)], "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == 5 and all(r.times <= 3 for r in found)
    assert len({r.times for r in found if r.doc == 1}) == 1
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("text IS NULL")).collect()[0].target == 0
