"""Collocations next to brute force; tiles and packing next to a plain counter."""

import re
from collections import Counter

import numpy as np
import pytest

from vetloom.llm import phrases

SCHEMA = "text string, lang string, id long, score string"


def brute(rows, least, longest=5, first=2000):
    counts, out = Counter(), []
    fold = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    totals = Counter()
    for (lang, p), f in counts.items():
        totals[lang] += f * (len(p) == 1)
    often = {key: f for key, f in counts.items() if f >= least}
    covered = {(lang, p[i : i + k]) for (lang, p), f in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
               if f >= often[lang, p[i : i + k]]}
    by_lang = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in covered:
            n = totals[lang]
            score, _, left, right = min((1000 * a * n // (often[lang, p[:k]] * often[lang, p[k:]]), k, often[lang, p[:k]], often[lang, p[k:]])
                                        for k in range(1, len(p)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n))
    for lang, found in by_lang.items():
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def corpus(seed, docs):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "STRASSE", "ß", "汉", "😀", "a-b", "\x00", "\xa0x", "\x1cq"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(docs):
        n = int(rng.choice([0, 1, 4, 60, 200]))
        got = rng.choice(words, n, p=share / share.sum()).tolist()
        if rng.random() < 0.5:
            got += ["Planted", "phrase", "of", "six", "fixed", "words"] * int(rng.integers(1, 3))
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "? ", " ! "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.025, 0.025, 0.025, 0.025])) for w in got)
        rows.append((text, [None, "und", "en", "en", "de"][i % 5]))
    return rows + [(None, "en"), ("", None), (" \t.,\n", "xx"), ("the same phrase " * 50, "fr"), ("The Same Phrase " * 5, "fr")]


@pytest.mark.parametrize("least,first,block,added", [(20, 2000, 1 << 21, 1024), (12, 7, 300, 2), (1, 30, 40, 1024)])
def test_matches_brute_force(spark, least, first, block, added):
    rows = corpus(least, 150)
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    found = phrases.collocations(frame, least=least, first=first, block=block, added=added).collect()
    assert sorted(map(tuple, found)) == brute(rows, least, first=first)


def test_tiles_count_as_a_plain_counter(monkeypatch):
    rng = np.random.default_rng(1)
    for dense in (1, 50, 10**9):
        monkeypatch.setattr(phrases, "DENSE", dense)
        a, b = rng.zipf(1.3, (2, 20_000)).clip(1, 3000)
        weights = rng.integers(1, 1 << 40, len(a))
        for counts in (None, weights):
            x, y, sums = phrases.count_pairs(a, b, counts)
            plain = Counter()
            for i, j, c in zip(a.tolist(), b.tolist(), (weights if counts is not None else np.ones_like(weights)).tolist()):
                plain[i, j] += c
            assert list(zip(zip(x.tolist(), y.tolist()), sums.tolist())) == sorted(plain.items())
            back = phrases.unpack(phrases.pack(x, y, sums))
            assert all((p == q).all() for p, q in zip(back, (x, y, sums)))


def test_words_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 10)
    for text in ("a bb ccc, dddd eeeee ffffff. " * 20, "x" * 100 + " y", "x" * 35, "", ",,,,,,,,,,,,,,,", " " * 50, "ab\tcd\nEF" * 30):
        expected = []
        for i, piece in enumerate(re.split(r"[.,;:!?\x0A-\x0D]", text.lower())):
            expected += [b"\xff"] * bool(i) + [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
        assert [w for part in phrases.words_of(text.encode()) for w in part] == expected


def test_exact_arithmetic_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(a, n, x, y) for a in (100, 10**12, 10**15) for n in (10**13, 10**16 + 7) for x in (a, 3 * a + 1) for y in (a, 7 * a + 5)]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", phrases._score(*(F.col(c) for c in "anlr")).alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in found)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(frame).count() == 0


def test_ids_are_ranked_by_frequency(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(f)) for i, f in enumerate(rng.zipf(1.2, 3000).clip(1, 10**12))]
    found = phrases.ranked(spark.createDataFrame(rows, "w long, f long"), "w").collect()
    assert sorted(r.id for r in found) == list(range(1, 3001))
    ordered = [r.f for r in sorted(found, key=lambda r: r.id)]
    assert all(a * 1.01 + 1 >= b for a, b in zip(ordered, ordered[1:]))
