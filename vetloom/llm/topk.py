"""Exact top-k by inner product with a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .vectors import rows_of

#: Candidates of a block and its bytes at 8 a component, queries worth a copy of a block, slices kept of each attribute.
BLOCK, BLOCK_BYTES, QUERIES, SLICES = 1 << 16, 64 << 20, 128, 8


def quantise(x: np.ndarray | None, scale: float = 1024.0) -> bytes | None:
    """floor(scale * x) as packed integers, all of 2, 4 or 8 bytes."""
    if x is None:
        return None
    q = np.floor(scale * x)
    most = np.abs(q).max() if len(q) else 0
    if most >= 2.0**62:
        raise ValueError("a component is too large for a score that is a long")
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return q.astype(f"<i{width}").tobytes()


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Packed rows of ``dim`` integers as a matrix, as wide as the widest of them."""
    rows = column.to_pylist()
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), f"<i{len(rows[0]) // dim}").reshape(-1, dim)
    return np.stack([np.frombuffer(r, f"<i{len(r) // dim}") for r in rows])


class Slices:
    """Bitmaps over the candidates: one per attribute and significant bit, from the highest down.

    An attribute is stored as its distance from its smallest value, without the low bits below the
    ``keep`` highest that any attribute of the block needs.
    """

    def __init__(self, values: np.ndarray, keep: int = SLICES):
        self.values, self.rows = values, len(values)
        low, high = ([int(x) for x in f(axis=0)] for f in (values.min, values.max))
        width = max((b - a).bit_length() for a, b in zip(low, high))
        self.dropped, self.bits = max(width - keep, 0), min(width, keep)
        words = (self.rows + 63) // 64
        # Of each bit first the slices of all attributes, then their complements.
        self.planes = np.zeros((self.bits, 2 * len(low), words), np.uint64)
        padded = np.zeros(words * 64, np.uint8)
        for d in range(len(low)):
            above = (values[:, d].astype(np.int64) - low[d]) >> self.dropped
            for b in range(self.bits):
                padded[: self.rows] = above >> b & 1
                self.planes[b, d] = np.packbits(padded, bitorder="little").view(np.uint64)
        np.invert(self.planes[:, : len(low)], out=self.planes[:, len(low) :])
        padded[:] = 0
        padded[: self.rows] = 1
        self.every = np.packbits(padded, bitorder="little").view(np.uint64)
        self.room = [self.planes[:0, 0]] * 3

    def sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum |q| * a, where a is the stored attribute, or its complement where q is negative.

        A slice of weight 2^b enters at 2^(b + c) for each bit c of |q|; slices of one weight are added
        three at a time, two bits out for three bits in, until one of each weight is left. All threes of
        a weight are added at once.
        """
        size, place = np.abs(query), np.arange(len(query)) + len(query) * (query < 0)
        chosen = [place[size >> c & 1 == 1] for c in range(int(size.max()).bit_length())]
        weights = range(max(len(chosen) + self.bits - 1, 0))
        entering = [[(at - c, rows) for c, rows in enumerate(chosen) if 0 <= at - c < self.bits and len(rows)] for at in weights]
        # Half of what a weight has, at most, is carried to the next one.
        most = 2 * max((sum(len(rows) for _, rows in x) for x in entering), default=0) + 2
        if len(self.room[0]) < most:
            self.room = [np.empty((most, len(self.every)), np.uint64) for _ in range(3)]
        here, then, half = self.room
        out, end, at = [], 0, 0
        while end or at < len(entering):
            for b, rows in entering[at] if at < len(entering) else []:
                np.take(self.planes[b], rows, axis=0, out=here[end : end + len(rows)], mode="clip")
                end += len(rows)
            begin = carried = 0
            while end - begin > 2:
                n = (end - begin) // 3
                a, b, c = (here[begin + i * n : begin + i * n + n] for i in range(3))
                np.bitwise_xor(a, b, out=half[:n])
                a &= b
                np.bitwise_and(half[:n], c, out=b)
                np.bitwise_or(a, b, out=then[carried : carried + n])
                c ^= half[:n]
                begin, carried = begin + 2 * n, carried + n
            if end - begin == 2:
                np.bitwise_and(here[begin], here[begin + 1], out=then[carried])
                here[begin] ^= here[begin + 1]
                carried += 1
            out.append(here[begin].copy() if end else np.zeros_like(self.every))
            here, then, end, at = then, here, carried, at + 1
        return out

    def candidates(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows that can be among the ``k`` best allowed ones.

        From the highest slice down, the rows with the k-th largest sum are found (as many rows as
        slices tell apart). Dropped bits can change a score by less than ``slack`` sums, so every row
        within it of the k-th sum is returned, and the boundary is left to exact scores.
        """
        slices = self.sum(query)
        sure, open_, least = np.zeros_like(self.every), allowed.copy(), 0
        for at in reversed(range(len(slices))):
            ones = open_ & slices[at]
            if int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(ones).sum()) >= k:
                open_, least = ones, least | 1 << at
            else:
                sure, open_ = sure | ones, open_ & ~slices[at]
        if int(np.bitwise_count(sure | open_).sum()) < k:
            least = 0
        size = sum(abs(q) for q in query.tolist())
        least = max(least - (-(-size * ((1 << self.dropped) - 1) >> self.dropped) if self.dropped else 0), 0)
        above, equal = np.zeros_like(self.every), allowed.copy()
        for at in reversed(range(max(len(slices), least.bit_length()))):
            plane = slices[at] if at < len(slices) else np.zeros_like(self.every)
            if least >> at & 1:
                equal &= plane
            else:
                above |= equal & plane
                equal &= ~plane
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.rows])


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; an error if they might not fit a long."""
    if len(values) and values.shape[1] and int(np.abs(values).max()) * int(np.abs(query).max()) * values.shape[1] >= 1 << 63:
        scores = values.astype(object) @ query.astype(object)
        if max(abs(s) for s in scores) >= 1 << 63:
            raise ValueError("a score does not fit a long")
        return scores.astype(np.int64)
    return values @ query


def best(slices: Slices, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows but the query's own, ties to the smaller id."""
    bits = np.zeros(len(slices.every) * 64, np.uint8)
    bits[: len(ids)] = ids != own
    allowed = np.packbits(bits, bitorder="little").view(np.uint64)
    at = slices.candidates(query, k, allowed)
    scores = exact_scores(slices.values[at].astype(np.int64), query)
    first = np.lexsort((ids[at], -scores))[:k]
    return ids[at][first], scores[first]


def _search(k: int, keep_slices: int, queries: int):
    """Candidates of a block as they come, then the queries that were sent to it; slices are made once a block."""
    schema = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answers(slices: Slices, ids: np.ndarray, asked: pa.RecordBatch, numbers: np.ndarray) -> pa.RecordBatch:
        found = [best(slices, ids, q, i, k) for q, i in zip(numbers.astype(np.int64), asked.column("vec").to_pylist())]
        sizes = [len(vecs) for vecs, _ in found]
        own = [np.repeat(asked.column(c).to_numpy(), sizes) for c in ("ask", "vec")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, *map(np.concatenate, zip(*found)))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, slices, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            asks = batch.column("ask").is_valid().to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "part", "slot")] + [asks])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = tuple(keys[:3, a].tolist())
                if here != place:
                    place, block, slices = here, [], None
                if not asks[a]:
                    rows = batch.slice(a, b - a)
                    block.append((rows.column("vec").to_numpy(), _unpacked(rows.column("q"), here[0])))
                    continue
                if slices is None:
                    if not block:
                        continue
                    ids, values = (np.concatenate(x) for x in zip(*block))
                    block, slices = [], Slices(values, keep_slices)
                for at in range(a, b, queries):
                    asked = batch.slice(at, min(queries, b - at))
                    yield answers(slices, ids, asked, _unpacked(asked.column("q"), here[0]))

    return run


def top_k(
    vectors: DataFrame, is_query: Column, vec: str = "vec_id", embedding: str = "embedding", k: int = 10,
    scale: float = 1024.0, block: int = BLOCK, queries: int = QUERIES, slices: int = SLICES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: for each query the ``k`` highest scores.

    Components become floor(``scale`` * x); the score is the inner product of the integers. Queries are
    the rows for which ``is_query`` (of ``vec``) holds, candidates all rows but those of the query's
    id; ties go to the smaller id. Candidates lie in blocks that stay where they are dealt, queries travel
    to every block, and only ``k`` rows per query leave one. No row holds a block: a task gathers its
    candidates as they come. Where there are fewer blocks than cores, a block is copied so that several tasks
    share its queries, at least about ``queries`` each.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; vectors of different lengths do not meet; repeated candidates each have a rank, repeated
    queries are asked once; an empty table gives an empty result; other columns are ignored.
    """
    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch.column(2))
            dims = pa.array([None if r is None else len(r) for r in rows], pa.int32())
            packed = pa.array([quantise(r, scale) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, packed], names=["vec", "asks", "dim", "q"])

    named = vectors.where(F.col(vec).isNotNull()).select(
        F.col(vec).cast("long").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(embedding).alias("x"))
    rows = keep(named.mapInArrow(integers, "vec bigint, asks boolean, dim int, q binary").where("dim > 0"), "integers")
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.sum(F.col("dim").cast("bigint") * 8).alias("bytes")).first()
    parts = max(-(-count.n // block), -(-(count.bytes or 0) // BLOCK_BYTES), 1)
    cores = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    copies = max(min(-(-cores // parts), -(-(count.q or 0) // queries)), 1)
    tasks = min(parts * copies, 100_000)
    # Equal rows are dealt to all blocks, too.
    part = F.pmod(F.xxhash64("vec", "q", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec", "dim", "q", part, F.lit(None).cast("bigint").alias("ask")).withColumn("slot", every(copies))
    asked = rows.where("asks").select("vec", "dim", "q").distinct().withColumn("ask", F.monotonically_increasing_id())
    sent = keep(asked, "asked").withColumn("slot", F.pmod(F.xxhash64("ask"), F.lit(copies)).cast("int")).withColumn("part", every(parts))
    task = F.pmod(F.col("part").cast("bigint") * copies + F.col("slot") + F.pmod(F.xxhash64("dim"), F.lit(tasks)), F.lit(tasks)).cast("int")
    dealt = candidates.unionByName(sent).repartitionById(tasks, task)
    dealt = dealt.sortWithinPartitions("dim", "part", "slot", F.col("ask").isNotNull())
    found = dealt.mapInArrow(_search(k, slices, queries), "ask bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
