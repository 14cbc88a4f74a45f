"""Packing of training examples into sequences: vector bin packing with the dot-product heuristic.

A sequence is a bin with three limits at once: tokens, segments (pieces of examples) and loss-bearing
tokens. Among the examples at hand that fit, the one whose demand points most in the direction of
what is left of the bin goes in next; when nothing fits any more, one example is cut to close it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import slices, texts

#: Examples and tokens among which a task chooses; a single longer example is held besides.
POOL, POOL_TOKENS = 1024, 1 << 22


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


class Example:
    """Ids of one example and where its loss-bearing tokens lie; pieces share the arrays."""

    def __init__(self, key, ids: np.ndarray, mask: np.ndarray | None):
        self.key, self.ids = key, ids
        #: Loss-bearing tokens before each place; None if all tokens bear loss.
        self.before = None if mask is None else np.r_[0, np.cumsum(mask != 0)]

    def loss(self, start: int, end: int) -> int:
        return end - start if self.before is None else int(self.before[end] - self.before[start])

    def fitting(self, start: int, end: int, tokens: int, loss: int) -> int:
        """End of the longest piece from ``start`` within the given tokens and loss."""
        end = min(end, start + tokens)
        if self.before is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(self.before, self.before[start] + loss, "right")) - 1)


class Packer:
    """Open examples of one task and the sequences made of them."""

    def __init__(self, limits: Limits, pool: int = POOL, pool_tokens: int = POOL_TOKENS):
        self.limits, self.pool, self.pool_tokens = limits, pool, pool_tokens
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        #: Pieces at hand and, in the same places, their demand of each limit.
        self.items: list[tuple[Example, int, int]] = []
        self.demand = np.zeros((pool + 64, 3))
        self.held = 0

    def add(self, example: Example) -> Iterator[list[tuple[Example, int, int]]]:
        """Take in an example; sequences that are full meanwhile."""
        start, n = 0, len(example.ids)
        while n - start >= self.limits.tokens:
            end = example.fitting(start, n, self.limits.tokens, self.limits.loss)
            if end - start < self.limits.tokens:
                break
            yield [(example, start, end)]
            start = end
        while start < n:
            end = example.fitting(start, n, self.limits.tokens, self.limits.loss)
            self._put(example, start, end)
            start = end
        while len(self.items) >= self.pool or self.held > self.pool_tokens:
            yield self._sequence()

    def rest(self) -> Iterator[list[tuple[Example, int, int]]]:
        while self.items:
            yield self._sequence()

    def _put(self, example: Example, start: int, end: int) -> None:
        at = len(self.items)
        if at == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.items.append((example, start, end))
        self.demand[at] = end - start, 1, example.loss(start, end)
        self.held += end - start

    def _take(self, at: int) -> tuple[Example, int, int]:
        """The piece at a place; the last one moves there."""
        item, last = self.items[at], self.items.pop()
        if at < len(self.items):
            self.items[at] = last
            self.demand[at] = self.demand[len(self.items)]
        self.held -= item[2] - item[1]
        return item

    def _sequence(self) -> list[tuple[Example, int, int]]:
        left, out = self.caps.copy(), []
        while self.items and left[0] and left[1]:
            demand = self.demand[: len(self.items)]
            # The dot product of demand and what is left, both as shares of the limits.
            score = demand @ (left / self.caps**2)
            fits = (demand <= left).all(axis=1)
            if fits.any():
                piece = self._take(int(np.where(fits, score, -1.0).argmax()))
            else:
                piece = self._cut(score, int(left[0]), int(left[2]))
                if piece is None:
                    break
            out.append(piece)
            left -= piece[2] - piece[1], 1, piece[0].loss(*piece[1:])
        self._trim(out, int(self.limits.tokens - left[0]))
        return out

    def _cut(self, score: np.ndarray, tokens: int, loss: int) -> tuple[Example, int, int] | None:
        """The start of the best example of which something fits; its rest stays at hand."""
        for at in np.argsort(-score, kind="stable").tolist():
            example, start, end = self.items[at]
            middle = example.fitting(start, end, tokens, loss)
            if middle > start:
                self._take(at)
                if middle < end:
                    self._put(example, middle, end)
                return example, start, middle
        return None

    def _trim(self, out: list[tuple[Example, int, int]], size: int) -> None:
        """A sequence that a limit or the end keeps short goes back to a power of two, which needs no padding."""
        spare = 0 if size == self.limits.tokens else size - (1 << size.bit_length() - 1)
        while spare:
            example, start, end = out.pop()
            middle = max(end - spare, start)
            spare -= end - middle
            self._put(example, middle, end)
            if middle > start:
                out.append((example, start, middle))


class Tokens:
    """Ids of whole texts by the vocabulary at ``path``, with ``end`` after each text."""

    def __init__(self, path: str, end: int | None):
        from public_tokenizers import PATTERN

        merges, self.exact = load(path)
        self.end = [] if end is None else [end]
        marks = merges.special
        ranks = {piece: i for i, piece in merges.pieces.items() if i not in marks.values()}
        # The library merges by id, so ids must be in the order of the merges.
        ordered = all(a < b for a, b in zip(merges.results, merges.results[1:]))
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks) if ordered else None

    def __call__(self, text: str) -> np.ndarray:
        try:
            ids = self.fast.encode_to_numpy(text, allowed_special="all") if self.fast else None
        except ValueError:  # runs of blanks too long for the library's patterns
            ids = None
        if ids is None:
            ids = np.frombuffer(self.exact.encode(text), "<u4")
        return np.concatenate([ids, self.end]).astype("<u4")


_LOADED: dict[tuple[str, int | None], Tokens] = {}


def _packed(limits: Limits, examples, key_type: pa.DataType, pool: int):
    """Rows of the pieces; ``examples`` turns a batch into examples."""
    names = ["example", "start", "length", "ids", "loss_tokens", "example_tokens", "sequence_id", "offset", "sequence_tokens"]
    types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, size = Packer(limits, pool), [], 0
        number = TaskContext.get().partitionId() << 32

        def written(sequence):
            nonlocal number, size
            offset, total = 0, sum(end - start for _, start, end in sequence)
            for example, start, end in sequence:
                rows.append((example.key, start, end - start, example.ids[start:end].tobytes(), example.loss(start, end),
                             len(example.ids), number, offset, total))
                offset += end - start
            number, size = number + 1, size + total

        def flushed():
            nonlocal size
            columns = list(zip(*rows)) if rows else [()] * len(names)
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for example in examples(batch):
                for sequence in packer.add(example):
                    written(sequence)
                if size > 1 << 19:
                    yield flushed()
        for sequence in packer.rest():
            written(sequence)
            if size > 1 << 19:
                yield flushed()
        if rows:
            yield flushed()

    return run


_PIECES = ("start bigint, length bigint, ids binary, loss_tokens bigint, example_tokens bigint, sequence_id bigint, "
           "offset bigint, sequence_tokens bigint")


def pack_examples(
    examples: DataFrame, example: str = "example", ids: str = "ids", mask: str | None = "mask",
    limits: Limits = Limits(), pool: int = POOL,
) -> DataFrame:
    """Pieces of tokenised examples and the sequences they lie in, one row a piece.

    ``ids`` are little-endian unsigned 32-bit integers, ``mask`` has a byte per token, not 0 where the
    token bears loss; without a mask, or where it is null, all tokens do. Columns: ``example``,
    ``start`` (ids of the example before the piece), ``length``, ``ids``, ``loss_tokens``,
    ``example_tokens``, ``sequence_id``, ``offset`` (gapless from 0) and ``sequence_tokens``.

    Every id lies in exactly one piece. No sequence exceeds a limit; each has ``limits.tokens`` tokens
    or a power of two of them, so nothing is padded. Sequences are made within the tasks that read the
    examples, from ``pool`` examples at a time, so there is no shuffle and nothing is gathered; a task
    that is run again numbers its sequences alike as its rows come in the same order.

    Null or empty ids have no piece and no row; a null example is a key like others; repeated rows are packed
    each on its own; an empty table gives an empty result; other columns are ignored. A mask of another
    length than the ids is an error.
    """
    kind = examples.schema[example].dataType.simpleString()
    key_type = pa.schema(examples.select(example).limit(0).toArrow().schema).field(0).type

    def rows(batch: pa.RecordBatch) -> Iterator[Example]:
        for part in slices(iter([batch]), 1):
            masks = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
            for key, packed, marked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), masks):
                found = np.frombuffer(packed or b"", "<u4")
                loss = None if marked is None else np.frombuffer(marked, np.uint8)
                if loss is not None and len(loss) != len(found):
                    raise ValueError(f"example {key}: {len(found)} ids and a mask of {len(loss)}")
                yield Example(key, found, loss)

    columns = [F.col(f"`{example}`").alias("example"), F.col(f"`{ids}`").alias("ids")] + ([F.col(f"`{mask}`").alias("mask")] if mask else [])
    return examples.select(*columns).mapInArrow(_packed(limits, rows, key_type, pool), f"example {kind}, {_PIECES}")


def pack_texts(
    docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", end: int | None = 1,
    limits: Limits = Limits(), pool: int = POOL,
) -> DataFrame:
    """``pack_examples`` of whole texts, tokenised in the same task by the vocabulary at ``path``.

    ``end`` is an id put after every text. Null counts as empty, so it is ``end`` alone. All tokens bear
    loss. Executors read the vocabulary from ``path``.
    """
    kind = docs.schema[doc].dataType.simpleString()
    key_type = pa.schema(docs.select(doc).limit(0).toArrow().schema).field(0).type

    def rows(batch: pa.RecordBatch) -> Iterator[Example]:
        if (path, end) not in _LOADED:
            _LOADED[path, end] = Tokens(path, end)
        tokens = _LOADED[path, end]
        for part in slices(iter([batch]), 1):
            for key, raw in zip(part.column(0).to_pylist(), texts(part.column(1))):
                yield Example(key, tokens(raw.decode()), None)

    slim = docs.select(F.col(f"`{doc}`").alias("example"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(_packed(limits, rows, key_type, pool), f"example {kind}, {_PIECES}")
