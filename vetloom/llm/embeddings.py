"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components
from .simhash import find
from .vectors import rows_of

#: Vectors that the cells are fitted on, vectors a cell is meant to hold, most cells, rows of a block.
SAMPLE, CELL, MOST_CELLS, BLOCK = 8192, 2048, 512, 2048


def unit(x: np.ndarray | None) -> bytes | None:
    """The direction of a vector as packed doubles; None if it has none."""
    if x is None or not len(x) or not (most := np.abs(x).max()):
        return None
    x = x / most  # neither overflows nor vanishes when squared
    return (x / np.sqrt(np.dot(x, x))).astype("<f8").tobytes()


def fit_cells(sample: list[bytes], cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of spherical k-means: rows join the centre of largest cosine, centres are mean directions."""
    x = np.stack([np.frombuffer(s, "<f8") for s in sample])
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centres


def reach(threshold: float) -> float:
    """How far from the border of its cell a vector can lie and still need to be shown to the other side.

    Vectors with a cosine of ``threshold`` or more are at most ``d = sqrt(2 - 2 threshold)`` apart. If
    they have different cells, the plane halfway between the two centres parts them, so one of them is
    within d/2 of it: comparing each cell with all vectors that near to it loses no pair.
    """
    return np.sqrt(max(2 - 2 * threshold, 0.0)) / 2 + 1e-9


def _assign(centres: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = reach(threshold)
        for batch in batches:
            units = batch.column(0).to_pylist()
            dims = np.array([len(u) // 8 for u in units], np.int32)
            home, visits = np.zeros(len(units), np.int32), [b""] * len(units)
            for dim in np.unique(dims):
                if dim not in centres:
                    continue
                at, c = np.flatnonzero(dims == dim), centres[dim]
                x = np.stack([np.frombuffer(units[i], "<f8") for i in at])
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
                same = x @ c.T
                own = same.argmax(axis=1)
                margin = same[np.arange(len(at)), own][:, None] - same
                shown = margin <= near * apart[own] + 1e-9
                packed = np.packbits(shown, axis=1, bitorder="little")
                for k, i in enumerate(at.tolist()):
                    home[i], visits[i] = own[k], packed[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(home), pa.array(visits, pa.binary())],
                                             names=["unit", "rep", "copies", "dim", "home", "visits"])

    return run


def _cells(visits: bytes, home: int) -> list[int]:
    """Cells other than its own that a vector is shown to."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(visits, np.uint8), bitorder="little"))
    return [c for c in at.tolist() if c != home]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own and shown vectors per cell, summed over a task."""
    counts: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        for dim, home, visits in zip(*(batch.column(i).to_pylist() for i in range(3))):
            counts.setdefault((dim, home), [0, 0])[0] += 1
            for c in _cells(visits, home):
                counts.setdefault((dim, c), [0, 0])[1] += 1
    rows = [(*k, *v) for k, v in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["dim", "cell", "own", "shown"])


def _deal(blocks: dict[tuple[int, int], tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of each vector for every pair of blocks it takes part in."""
        for batch in batches:
            out = []
            for u, rep, copies, dim, home, visits in zip(*(batch.column(i).to_pylist() for i in range(6))):
                turn = rep * 0x9E3779B97F4A7C15 >> 20
                row = (u, rep, copies, home, visits)
                own, shown = blocks[dim, home]
                mine = turn % own
                for other in range(own):
                    out.append((dim, home, 0, min(mine, other), max(mine, other), int(mine > other), *row))
                for other in range(shown):
                    out.append((dim, home, 1, mine, other, 0, *row))
                for cell in _cells(visits, home):
                    own, shown = blocks[dim, cell]
                    for other in range(own):
                        out.append((dim, cell, 1, other, turn % shown, 1, *row))
            for i in range(0, len(out), 8192):
                yield _batch(out[i : i + 8192])

    return run


_DEALT = pa.schema([(n, pa.int64()) for n in ("dim", "cell", "kind", "i", "j", "side")]
                   + [("unit", pa.binary()), ("rep", pa.int64()), ("copies", pa.int64()), ("home", pa.int64()), ("visits", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _DEALT)], schema=_DEALT)


def _compare(left: pa.Table, right: pa.Table | None, cell: int, threshold: float):
    """Links between two blocks (or within one): count per representative, and one star per linked part."""
    def matrix(t):
        return np.stack([np.frombuffer(u, "<f8") for u in t.column("unit").to_pylist()])

    a, rep_a, n_a = matrix(left), left.column("rep").to_numpy(), left.column("copies").to_numpy()
    within = right is None
    b, rep_b, n_b = (a, rep_a, n_a) if within else (matrix(right), right.column("rep").to_numpy(), right.column("copies").to_numpy())
    if not within:
        home_a, home_b = left.column("home").to_numpy(), right.column("home").to_numpy()
        seen = np.stack([np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little") for v in left.column("visits").to_pylist()]) \
            if left.column("visits")[0].as_py() else None
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    root = np.arange(len(a) + (0 if within else len(b)))
    shift = 0 if within else len(a)
    for start in range(0, len(a), 256):
        part = slice(start, start + 256)
        linked = a[part] @ b.T >= threshold
        rows = np.arange(start, start + len(linked))
        if within:
            linked[np.arange(len(rows)), rows] = False
        elif seen is not None and (home_b != cell).any():
            # A pair that both cells see counts in the smaller one.
            both = (home_b != cell)[None, :] & seen[part][:, home_b].astype(bool) & (home_b[None, :] < cell)
            linked &= ~both
        count_a[part] += linked @ n_b
        if not within:
            count_b += n_a[part] @ linked
        i, j = np.nonzero(linked)
        i, j = i + start, j + shift
        for first_only in (True, False):  # one link a row first: most others are then joined already
            apart = root[i] != root[j]
            p, q = i[apart], j[apart]
            if first_only:
                p, at = np.unique(p, return_index=True)
                q = q[at]
            for x, y in zip(p.tolist(), q.tolist()):
                x, y = find(root, x), find(root, y)
                root[max(x, y)] = min(x, y)
            while (root != root[root]).any():
                root = root[root]
    reps = rep_a if within else np.r_[rep_a, rep_b]
    star = np.flatnonzero(reps != reps[root])
    counts = [(rep_a[count_a > 0], count_a[count_a > 0])] + ([] if within else [(rep_b[count_b > 0], count_b[count_b > 0])])
    return (np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])), (reps[star], reps[root[star]])


def _links(threshold: float):
    keys = ("dim", "cell", "kind", "i", "j")

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([rows.column(k).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        side = rows.column("side").to_numpy()
        for s, e in zip(edges, edges[1:]):
            group, part = rows.slice(s, e - s), side[s:e]
            _, cell, kind, i, j = key[:, s].tolist()
            left = group.filter(pa.array(part == 0))
            right = None if kind == 0 and i == j else group.filter(pa.array(part == 1))
            if not left.num_rows or (right is not None and not right.num_rows):
                continue
            (rep, n), (a, b) = _compare(left, right, cell, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[rep, a]), pa.array([None] * len(rep) + b.tolist(), pa.int64()), pa.array(n.tolist() + [None] * len(a), pa.int64())],
                names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows < BLOCK:
                continue
            key = np.stack([rest.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield from solve(rest.slice(0, cuts[-1]))
                rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    return run


def embedding_dedup(
    vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
    sample: int = SAMPLE, cell: int = CELL, most_cells: int = MOST_CELLS, block: int = BLOCK,
) -> DataFrame:
    """``vec``, ``n_links``, ``component`` and ``kept`` per row; links are cosines of ``threshold`` or more.

    Equal directions are compared once and count with their copies. The cells' centres are fitted on a
    bounded sample (the ``sample`` directions of smallest hash) and are at most ``most_cells``; all
    directions are assigned, and ``reach`` makes the comparison exact whatever the cells. Cells larger
    than ``block`` rows are compared block by block. Of a group the smallest id is kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows
    without an id (their component is null) or vectors of different lengths. Repeated rows link with
    each other; an empty table gives an empty result; other columns are ignored.
    """
    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            units = [None if i is None else unit(x) for i, x in zip(ids, rows_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=["vec", "unit"])

    spark = vectors.sparkSession
    raw = vectors.select(F.col(vec).cast("long").alias("vec"), F.col(embedding).alias("embedding"))
    all_rows = keep(raw.mapInArrow(directions, "vec bigint, unit binary"), "directions")
    distinct = all_rows.where("unit IS NOT NULL").groupBy("unit").agg(F.min("vec").alias("rep"), F.count("*").alias("copies"))
    distinct = keep(distinct, "distinct")
    by_dim: dict[int, list[bytes]] = {}
    for row in distinct.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(sample).collect():
        by_dim.setdefault(len(row.unit) // 8, []).append(bytes(row.unit))
    wanted = int(np.ceil(distinct.count() / cell))
    centres = {d: fit_cells(s, max(1, min(wanted, most_cells, len(s) // 8))) for d, s in by_dim.items()}
    assigned = keep(distinct.mapInArrow(_assign(centres, threshold), "unit binary, rep bigint, copies bigint, dim int, home int, visits binary"), "cells")
    sizes = assigned.select("dim", "home", "visits").mapInArrow(_sizes, "dim bigint, cell bigint, own bigint, shown bigint")
    # One row per cell; the number of cells is bounded.
    blocks = {(r.dim, r.cell): (-(-r.own // block), -(-r.shown // block))
              for r in sizes.groupBy("dim", "cell").agg(F.sum("own").alias("own"), F.sum("shown").alias("shown")).collect()}
    dealt = assigned.mapInArrow(_deal(blocks), ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'bigint'}" for f in _DEALT))
    keys = ("dim", "cell", "kind", "i", "j")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = keep(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_links(threshold), "a bigint, b bigint, n bigint"), "links")
    joined = components(found.where("b IS NOT NULL"), "a", "b")
    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    labels = distinct.join(joined, distinct.rep == joined.node, "left").join(counts, distinct.rep == counts.a, "left")
    labels = labels.select(
        F.col("unit").alias("_unit"), F.coalesce("component", "rep").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    labels = keep(labels, "labels")
    linked = all_rows.where("unit IS NOT NULL").join(labels, all_rows.unit == labels._unit).select("vec", "n_links", "component")
    alone = all_rows.where("unit IS NULL").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec") == F.col("component"), F.lit(True)))
