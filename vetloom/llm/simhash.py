"""Near-duplicate documents by SimHash fingerprints, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, texts
from .components import components

#: Rows of one group that meet in one task; larger groups are dealt out as pairs of blocks.
BLOCK = 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 bits over all word shingles, repeats included; no word: zero."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], seed) for i, j in zip(first, ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc`` and ``fp`` (64 bits as a long) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, fp bigint")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of every fingerprint, 64 fingerprints to a word, one spare word at the end."""
    n = len(fps)
    bits = np.zeros((64, (n + 63) // 64 * 64 + 64), np.uint8)
    bits[:, :n] = (fps[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _ahead(words: np.ndarray, rows: int, n: int) -> np.ndarray:
    """The first ``n`` words of a bitmap read ``rows`` rows further on."""
    skip, bits = divmod(rows, 64)
    out = np.zeros(n, np.uint64)
    part = words[skip : skip + n]
    out[: len(part)] = part >> np.uint64(bits)
    if bits:
        part = words[skip + 1 : skip + 1 + n]
        out[: len(part)] |= part << np.uint64(64 - bits)
    return out


def within(planes: np.ndarray, rows: int, shift: int, radius: int) -> np.ndarray:
    """Rows i < ``rows`` whose distance to row i + ``shift`` is at most ``radius``.

    The differing bits of 64 pairs are added at once by carry-save counters (ones, twos, fours, ...);
    a counter that reaches the first power of two above ``radius`` sticks. Planes are abandoned once
    all pairs exceed it; pairs left over are told from ``radius`` by their counters.
    """
    n = (rows + 63) // 64
    digits = int(radius).bit_length()
    counter = [np.zeros(n, np.uint64) for _ in range(digits)]
    over = np.zeros(n, np.uint64)
    if rows % 64:
        over[-1] = _ALL << np.uint64(rows % 64)
    for b, plane in enumerate(planes):
        carry = plane[:n] ^ _ahead(plane, shift, n)
        for d in range(digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if b % 4 == 3 and (over == _ALL).all():
            return np.empty(0, np.int64)
    above = np.zeros(n, np.uint64)  # counters greater than radius, from the highest digit downward
    equal = ~above
    for d in reversed(range(digits)):
        if radius >> d & 1:
            equal &= counter[d]
        else:
            above |= equal & counter[d]
            equal &= ~counter[d]
    hit = ~(over | above)
    return np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[:rows])


def find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def link_groups(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Index of a linked row that stands for the connected rows, for every row; rows lie group by group.

    ``sizes`` are the group sizes, largest first, so that at shift s the pairs left form a prefix.
    """
    root = np.arange(len(fps))
    group = np.repeat(np.arange(len(sizes)), sizes)
    planes, ends = bit_planes(fps), np.cumsum(sizes)
    for shift in range(1, int(sizes[0]) if len(sizes) else 0):
        rows = int(ends[np.searchsorted(-sizes, -shift, side="left") - 1]) - shift
        hits = within(planes, rows, shift, radius)
        hits = hits[group[hits] == group[hits + shift]]
        for i in hits[root[hits] != root[hits + shift]].tolist():
            a, b = find(root, i), find(root, i + shift)
            root[max(a, b)] = min(a, b)
        if len(hits):
            while (root != root[root]).any():
                root = root[root]
    return root


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group that a batch cuts is carried on to the next."""
        rest: pa.Table | None = None

        def solve(rows: pa.Table) -> pa.RecordBatch:
            key = np.stack([rows.column(i).to_numpy() for i in range(4)])
            fps, rep = rows.column(4).to_numpy().view(np.uint64), rows.column(5).to_numpy()
            start = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            sizes = np.diff(np.r_[start, len(fps)])
            order = np.argsort(-sizes, kind="stable")
            at = np.concatenate([np.arange(start[g], start[g] + sizes[g]) for g in order]) if len(order) else start
            root = link_groups(fps[at], sizes[order], radius)
            a, b = rep[at], rep[at[root]]
            linked = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            rest = rows
            if rows.num_rows >= 2 * BLOCK:
                key = np.stack([rows.column(i).to_numpy() for i in range(4)])
                cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
                if len(cuts):
                    yield solve(rows.slice(0, cuts[-1] + 1))
                    rest = rows.slice(cuts[-1] + 1)
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def tables_for(rows: int, radius: int) -> list[int]:
    """Masks of fingerprint bits; fingerprints within ``radius`` agree under one of them at least.

    The bits are cut into parts, of which ``radius`` may differ; as many parts are kept as give
    each table about as many keys as there are fingerprints.
    """
    parts = radius + 1
    while parts < radius + 3 and 64 * (parts - radius) / parts < np.log2(max(rows, 2)) - 3:
        parts += 1
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(parts)]
    return [sum(m) for m in combinations(masks, parts - radius)]


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between representatives of different fingerprints at most ``radius`` bits apart.

    ``distinct`` has one row per fingerprint (``fp``, ``rep``). Within a group, links are returned as
    one star per connected part, never as all pairs. Groups beyond ``block`` rows are dealt out as
    pairs of blocks.
    """
    masks = tables_for(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp", "rep",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "k"),
    )
    groups = keep(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    rows = keyed.join(groups, ["t", "k"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.col("t").cast("long").alias("t"), "k", F.least("own", "other").cast("long").alias("i"),
        F.greatest("own", "other").cast("long").alias("j"), "fp", "rep",
    )
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(parts, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    kind = distinct.schema["rep"].dataType.simpleString()
    return dealt.mapInArrow(_linker(radius), f"a {kind}, b {kind}")


def simhash_dedup(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, block: int = BLOCK
) -> DataFrame:
    """One row per document: ``doc``, ``fp`` and ``component`` (smallest id reachable by links).

    Fingerprints at most ``radius`` bits apart are linked. Copies share a fingerprint and are compared
    once. Null and empty texts have fingerprint zero and are linked like any other; repeated rows
    stay; rows without an id belong to the component of their fingerprint and never name one;
    an empty table gives an empty result; other columns are ignored.
    """
    prints = keep(fingerprints(docs, doc, text, shingle), "prints")
    distinct = keep(prints.groupBy("fp").agg(F.min("doc").alias("rep")), "distinct")
    joined = components(links(distinct.where("rep IS NOT NULL"), radius, block), "a", "b")
    # A fingerprint that only rows without an id have is linked through no representative.
    labels = distinct.join(joined, distinct.rep == joined.node, "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component")
    )
    labels = keep(labels, "labels")
    return prints.join(labels, prints.fp == labels._fp).select("doc", "fp", "component")


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Of repeated rows of that id one stays; rows without an id cannot stand for a group and all stay.
    """
    found = simhash_dedup(docs, doc, text, shingle, radius)
    first = keep(found.where("doc = component").select(F.col("doc").alias("_doc")).distinct(), "first")
    named = docs.join(first, docs[doc] == first._doc, "left_semi").dropDuplicates([doc])
    return named.unionByName(docs.where(F.col(doc).isNull()))
