"""Hard negatives by inner product, with rotated one-bit codes and exact residual intervals.

A vector x is stored as the signs c of its rotated components, its alignment a = <x, c> (c scaled to
length 1) and the length of what is left, e = x - a c. The inner product with an anchor q is a <q, c>,
which popcounts give, plus <q, e>. As e is orthogonal to c, Cauchy-Schwarz bounds the latter by
|e| sqrt(|q|^2 - <q, c>^2): a certain interval, not an estimate with an error probability. What is left
is coded again in the same way, which narrows the interval level by level, and only rows whose interval
leaves them open are scored in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .vectors import rows_of

#: Bytes of a block of candidates (at 8 a component) and of a group of anchors; codes a row; bits of an anchor's component.
BLOCK_BYTES, LEAST_BYTES, GROUP_BYTES, LEVELS, PLANES = 64 << 20, 1 << 20, 128 << 10, 4, 8
#: Intervals worked out together, a bound on the memory they take.
TOGETHER = 1 << 17
#: Scores beyond a long are held at its ends.
LONG = (1 << 63) - 1


def quantise(x: np.ndarray, scale: float) -> tuple[int, bytes]:
    """floor(scale * x) and how it is packed: integers of 2, 4 or 8 bytes, or decimal numbers (0) beyond."""
    if not len(x) or np.abs(x).max() < 2.0**50 / scale:
        q = np.floor(scale * x)
        most = np.abs(q).max() if len(q) else 0
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        return width, q.astype(f"<i{width}").tobytes()
    return 0, _written([floor(Fraction(scale) * Fraction(v)) for v in x.tolist()])


def _written(values) -> bytes:
    return b",".join(str(v).encode() for v in values)


def unpack(width: int, data: bytes, dim: int) -> np.ndarray:
    """Integers as rows of ``dim``: 64-bit ones, or Python's where those do not suffice."""
    if width:
        return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dim)
    return np.array([int(v) for v in data.split(b",")], object).reshape(-1, dim)


def pack(widths: list[int], rows: list[bytes], dim: int) -> tuple[int, bytes]:
    if len(set(widths)) == 1:
        return widths[0], (b"" if widths[0] else b",").join(rows)
    every = [unpack(w, r, dim)[0] for w, r in zip(widths, rows)]
    if 0 in widths:
        return 0, b",".join(map(_written, every))
    return max(widths), np.concatenate(every).astype(f"<i{max(widths)}").tobytes()


@lru_cache(maxsize=64)
def rotation(dim: int, level: int) -> np.ndarray:
    """The same random rotation in every task."""
    q, r = np.linalg.qr(np.random.default_rng((dim, level)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    short = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, short))), axis=1, bitorder="little").view(np.uint64)


class Anchors:
    """Anchors of one length: rotated, and each component cut into bit planes."""

    def __init__(self, values: np.ndarray, levels: int):
        self.values, self.coded = values, values.dtype != object
        if not self.coded:
            return
        q, dim = values.astype(np.float64), values.shape[1]
        self.floats, self.length, self.levels = q, np.sqrt(np.einsum("ij,ij->i", q, q)), []
        self.most = np.abs(values).max(axis=1, initial=0).tolist()
        for level in range(levels):
            q = q @ rotation(dim, level).T
            low, step = q.min(axis=1), np.ptp(q, axis=1) / ((1 << PLANES) - 1)
            step[step == 0] = 1.0
            k = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
            near = low[:, None] + step[:, None] * k
            planes = [_words((k >> b & 1).astype(bool)) for b in range(PLANES)]
            self.levels.append((planes, low, step, near.sum(axis=1), np.abs(q - near).sum(axis=1) / np.sqrt(dim)))


class Codes:
    """One-bit codes of a block of candidates, in ``levels`` steps."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS):
        self.values, self.coded = values, values.dtype != object
        if not self.coded:
            return
        self.floats, self.root = values.astype(np.float64), np.sqrt(values.shape[1])
        left = self.floats
        self.length = np.sqrt(np.einsum("ij,ij->i", left, left))
        self.most, self.levels = int(np.abs(values).max()) if values.size else 0, []
        for level in range(levels):
            left = left @ rotation(values.shape[1], level).T
            up = left >= 0
            align = np.abs(left).sum(axis=1) / self.root
            left -= np.where(up, align[:, None], -align[:, None]) / self.root
            code = _words(up)
            self.levels.append((code, np.bitwise_count(code).sum(axis=1, dtype=np.int64), align, np.sqrt(np.einsum("ij,ij->i", left, left))))

    def intervals(self, anchors: Anchors, which: slice, rows: slice, levels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the scores of some anchors (down) and rows (across)."""
        about = loose = 0.0
        for (code, ones, align, rest), (planes, low, step, total, error) in list(zip(self.levels, anchors.levels))[:levels]:
            own, hits = code[rows], 0
            for b, plane in enumerate(planes):
                for word in range(own.shape[1]):
                    hits = hits + (np.bitwise_count(own[None, :, word] & plane[which, word][:, None]).astype(np.int32) << b)
            along = (2 * (low[which, None] * ones[rows] + step[which, None] * hits) - total[which, None]) / self.root
            about = about + align[rows] * along
            loose = loose + align[rows] * error[which, None]
            across = np.sqrt(np.maximum(anchors.length[which, None] ** 2 - np.maximum(np.abs(along) - error[which, None], 0) ** 2, 0))
        # The last terms cover the rounding of doubles.
        reach = loose + rest[rows] * across + 1e-9 * self.length[rows] * anchors.length[which, None] + 1e-6
        return about - reach, about + reach

    def scores(self, anchors: Anchors, one: int, at: np.ndarray) -> np.ndarray:
        """Integer inner products of one anchor."""
        if self.coded and anchors.coded:
            bound = self.most * anchors.most[one] * self.values.shape[1]
            if bound < 1 << 53:
                return (self.floats[at] @ anchors.floats[one]).astype(np.int64)
            if bound <= LONG:
                return self.values[at] @ anchors.values[one]
        exact = self.values[at].astype(object) @ anchors.values[one].astype(object)
        return np.array([max(-LONG, min(LONG, s)) for s in exact], np.int64)

    def open_rows(self, anchors: Anchors, which: np.ndarray, rows: slice, choose) -> Iterator[tuple[int, np.ndarray]]:
        """For each of the anchors ``which``, the rows that ``choose(anchor, low, high)`` leaves open."""
        n = rows.stop - rows.start
        if not (self.coded and anchors.coded) or not n:
            yield from ((i, np.arange(rows.start, rows.stop)) for i in which.tolist())
            return
        step = max(1, TOGETHER // n)
        for start in range(0, len(which), step):
            part = which[start : start + step]
            low, high = self.intervals(anchors, part, rows)
            for i, a, b in zip(part.tolist(), low, high):
                yield i, np.flatnonzero(choose(i, a, b)) + rows.start


def _least(low: np.ndarray, k: int) -> float:
    """The k-th largest lower end: no row below it can be among the k best."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


class Block:
    """Candidates in the order of their labels."""

    def __init__(self, ids: np.ndarray, labels: list[str], codes: Codes):
        self.ids, self.codes, self.spans = ids, codes, {}
        for i, label in enumerate(labels):
            self.spans[label] = (self.spans.get(label, (i,))[0], i + 1)

    def best(self, anchors: Anchors, own: list[int], labels: list[str], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Anchor, ids and scores of the ``k`` highest scores of its label, ties to the smaller id."""
        for label in sorted(set(labels) & set(self.spans)):
            rows = slice(*self.spans[label])
            which = np.array([i for i, x in enumerate(labels) if x == label])

            def choose(i, low, high):
                other = self.ids[rows] != own[i]
                return other & (high >= _least(low[other], k))

            for i, at in self.codes.open_rows(anchors, which, rows, choose):
                at = at[self.ids[at] != own[i]]
                yield i, *self._first(at, self.codes.scores(anchors, i, at), k)

    def within(self, anchors: Anchors, own: list[int], labels: list[str], windows: list[list[tuple[int, int]]], k: int):
        """Anchor, number of the window, ids and scores of the ``k`` highest scores of other labels in each window."""
        allowed = np.ones(len(self.ids), bool)

        def other(i):
            keep = allowed.copy()
            keep[slice(*self.spans.get(labels[i], (0, 0)))] = False
            return keep & (self.ids != own[i])

        def choose(i, low, high):
            if not windows[i]:
                return np.zeros(len(low), bool)
            # Rows that reach any window at all; only they are looked at window by window.
            mine = other(i) & (high >= min(least for least, _ in windows[i])) & (low <= max(most for _, most in windows[i]))
            at = np.flatnonzero(mine)
            low, high, kept = low[at], high[at], np.zeros(len(at), bool)
            for least, most in windows[i]:
                sure = low[(low >= least) & (high <= most)]
                kept |= (high >= max(_least(sure, k), least)) & (low <= most)
            mine[at] = kept
            return mine

        for i, at in self.codes.open_rows(anchors, np.arange(len(own)), slice(0, len(self.ids)), choose):
            at = at[other(i)[at]]
            scores = self.codes.scores(anchors, i, at)
            for number, (least, most) in enumerate(windows[i]):
                inside = (scores >= least) & (scores <= most)
                yield i, number, *self._first(at[inside], scores[inside], k)

    def _first(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][first], scores[first]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch.column(3))
            made = [(None, None) if r is None else quantise(r, scale) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([0 if r is None else len(r) for r in rows], pa.int32()),
                 pa.array([w for w, _ in made], pa.int32()), pa.array([q for _, q in made], pa.binary())],
                names=["vec", "label", "asks", "dim", "width", "q"])

    return run


def _block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("label")
    dim = rows.column("dim")[0].as_py()
    width, data = pack(rows.column("width").to_pylist(), rows.column("q").to_pylist(), dim)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "part": rows.column("part").slice(0, 1), "vecs": pa.array([rows.column("vec").to_pylist()], pa.list_(pa.int64())),
        "labels": pa.array([rows.column("label").to_pylist()], pa.list_(pa.string())), "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary())})


_FOUND = pa.schema([("anchor_id", pa.int64()), ("key", pa.string()), ("around", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int, levels: int, share: tuple[int, int] | None):
    """Blocks as they come, each before the anchors that were sent to it; codes are made once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = block = None
        for batch in batches:
            for row in batch.to_pylist():
                here = row["dim"], row["part"]
                if row["vecs"] is not None:
                    codes = Codes(unpack(row["width"], row["data"], row["dim"]), levels)
                    place, block = here, Block(np.array(row["vecs"], np.int64), row["labels"], codes)
                    continue
                if here != place:
                    continue
                out: list[tuple] = []
                group = row["anchors"]
                own, labels, keys = ([a[c] for a in group] for c in ("vec", "label", "key"))
                anchors = Anchors(np.concatenate([unpack(a["width"], a["q"], row["dim"]) for a in group]), levels)
                if share is None:
                    for i, vecs, scores in block.best(anchors, own, labels, k):
                        out += [(own[i], keys[i], None, v, s) for v, s in zip(vecs.tolist(), scores.tolist())]
                else:
                    around = [a["around"] for a in group]
                    windows = [[window(p, *share) for p in ps] for ps in around]
                    for i, n, vecs, scores in block.within(anchors, own, labels, windows, k):
                        out += [(own[i], keys[i], around[i][n], v, s) for v, s in zip(vecs.tolist(), scores.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, _FOUND)], schema=_FOUND)

    return run


def _met(blocks: DataFrame, anchors: DataFrame, parts: int, groups: int, run) -> DataFrame:
    """Every group of anchors is sent to every block of its length; blocks stay where they are dealt."""
    fields = [F.col(c) for c in ("vec", "key", "label", "around", "width", "q")]
    grouped = anchors.groupBy("dim", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct(*fields)).alias("anchors"))
    sent = grouped.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "anchors")
    both = blocks.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(min(parts, 100_000), "dim", "part").sortWithinPartitions("dim", "part", F.col("vecs").isNull())
    return dealt.mapInArrow(run, "anchor_id bigint, key string, around bigint, vec_id bigint, score bigint")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, vec: str = "vec_id", label: str = "label", embedding: str = "embedding",
    positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: float = 256.0,
    block_bytes: int = BLOCK_BYTES, least_bytes: int = LEAST_BYTES, group_bytes: int = GROUP_BYTES, levels: int = LEVELS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become floor(``scale`` * x); a score is the inner product of the integers. Anchors are the
    rows for which ``is_anchor`` holds. An anchor's positives are its ``positives`` highest scores of the
    same label; for each of them the ``negatives`` highest scores of other labels follow whose share of
    the positive's score, in per cent, lies within ``share``, ties to the smaller id (all, if fewer).
    Labels are compared as text.

    Candidates lie in blocks of at most about ``block_bytes`` whose codes are made once; anchors travel to
    the blocks, and at most ``positives`` or ``negatives`` rows for each question leave one.

    Rows without an id or a label and vectors that are null or hold null or non-finite components take no
    part, nor do empty ones; vectors of different lengths do not meet; rows with an anchor's id are no
    candidates of it; repeated candidates have a rank each, repeated anchors are asked once. Scores beyond a long are held at
    its ends, and components too large for it are scored in whole numbers without codes. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    named = vectors.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.col(vec).cast("long").alias("vec"), F.col(label).cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(embedding).alias("embedding"))
    rows = named.mapInArrow(_integers(scale), "vec bigint, label string, asks boolean, dim int, width int, q binary")
    rows = keep(rows.where("dim > 0 AND q IS NOT NULL"), "integers")
    size = rows.agg(F.sum(F.col("dim") * 8).alias("all"), F.sum(F.when(F.col("asks"), F.col("dim") * 8)).alias("asked")).first()
    cores = 2 * spark.sparkContext.defaultParallelism
    parts = max(-(-(size["all"] or 0) // block_bytes), min(cores, -(-(size["all"] or 0) // least_bytes)), 1)
    groups = max(-(-(size["asked"] or 0) // group_bytes), 1)
    placed = rows.select("vec", "label", "dim", "width", "q", F.pmod(F.xxhash64("vec", "label", "q"), F.lit(parts)).cast("int").alias("part"))
    blocks = placed.groupBy("dim", "part").applyInArrow(
        _block, "dim int, part int, vecs array<bigint>, labels array<string>, width int, data binary")
    blocks = keep(blocks, "blocks")
    key = F.sha2(F.concat(F.encode("label", "UTF-8"), F.lit(b"\0"), F.col("q")), 256)
    anchors = keep(rows.where("asks").select("vec", "label", "dim", "width", "q", key.alias("key")).distinct(), "anchors")

    def top(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    nothing = F.lit(None).cast("array<bigint>").alias("around")
    found = _met(blocks, anchors.select("*", nothing), parts, groups, _search(positives, levels, None))
    near = keep(top(found, positives, "anchor_id", "key").select("anchor_id", "key", "vec_id", "score"), "positives")
    around = near.groupBy("anchor_id", "key").agg(F.collect_set("score").alias("around"))
    asked = anchors.join(around, (F.col("vec") == F.col("anchor_id")) & (anchors.key == around.key)).select(anchors["*"], "around")
    found = _met(blocks, asked, parts, groups, _search(negatives, levels, share))
    hard = top(found, negatives, "anchor_id", "key", "around")
    near = near.select(F.col("anchor_id").alias("_a"), F.col("key").alias("_k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = hard.join(near, (F.col("anchor_id") == F.col("_a")) & (F.col("key") == F.col("_k")) & (F.col("around") == F.col("positive_score")))
    return met.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
