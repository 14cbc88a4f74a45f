"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

The vocabulary is a file of the ``tokenizers`` library whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Characters fed at once, and words whose ids a task remembers.
CHUNK, MEMO = 1 << 16, 300_000

# The format of the file (blanks, and the pattern that parts a text before merging).
BLANK = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % ((BLANK,) * 4)
)

_WORDS = regex.compile(PATTERN)
#: The same for texts in which ``re`` has the same letters, digits and blanks; it is faster.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\xff]")
#: How a run goes on once it is too long to wait for its end.
_RUNS = [regex.compile(p % BLANK if "%s" in p else p) for p in (r"\p{L}*", r"\p{N}*", r"[%s]*", r"[^%s\p{L}\p{N}]*")]
_BLANKS = 2


def split_words(text: str) -> list[str]:
    """Parts of a text that merges never cross; together they are the text."""
    return (_WORDS if _NOT_PLAIN.search(text) else _PLAIN_WORDS).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list, with the lookahead that makes a token final."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: Rank of the merge of two ids, and what it results in.
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.results = [ids[a + b] for a, b in pairs]

    @cached_property
    def lookahead(self) -> int:
        """Bytes after a token end that decide whether it is final.

        Text that is added later can move the end of the undisturbed part only by merges that cross it,
        one after the other, each of a higher rank than the one before: (x, y) moves it left by x if y
        begins where the undisturbed part ended, that is, if y is what an earlier crossing merge left
        there, made there, or began. In rank order, ``reach`` holds for each token how far right of its
        start the added text can lie; the longest such chain bounds all.
        """
        reach = dict.fromkeys(self.pieces, 0)
        most = max(map(len, self.pieces.values()))
        for (x, y), rank in self.ranks.items():
            xy = self.results[rank]
            moved = len(self.pieces[x]) + reach[y]
            most = max(most, moved)
            reach[xy] = max(reach[xy], reach[x], moved)
            reach[x] = max(reach[x], moved)
        return most

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a part: always the merge of lowest rank, leftmost first."""
        ids = [self.single[b] for b in piece]
        if len(ids) > 48:
            return self._encode_long(ids)
        get, none = self.ranks.get, len(self.results)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i] = self.results[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of the possible merges and links to the neighbours."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.results[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Encodes one part that arrives in pieces; holds back what later bytes may still change."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        """Ids that have become final."""
        self.held += data
        if len(self.held) < 4 * self.merges.lookahead:
            return []
        out, end, last = [], 0, len(self.held) - self.merges.lookahead
        for i in self.merges.encode(self.held):
            n = len(self.merges.pieces[i])
            if end + n > last:
                break
            out.append(i)
            end += n
        # No merge crosses a token end, so the rest is encoded alike without what lies before it.
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.encode(self.held), b""
        return out


class _Memo(dict):
    """Ids of a word as little-endian unsigned 32-bit integers; words not met for long are forgotten."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.older = merges, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        self[word] = out = self.older.get(word) or _packed(self.merges.encode(word.encode()))
        return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Text in chunks to ids in chunks; memory is bounded by the chunk, also for endless words."""

    def __init__(self, merges: Merges):
        self.merges, self.memo = merges, _Memo(merges)
        marks = sorted(merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.hold = max([3, *map(len, marks)])

    def encode(self, text: str) -> bytes:
        """Packed ids of a text at hand."""
        if len(text) <= CHUNK and (not self.special or not self.special.search(text)):
            return b"".join(map(self.memo.__getitem__, split_words(text)))
        return b"".join(self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)))

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        self.text, self.run, self.part = "", None, None
        for chunk in chunks:
            self.text += chunk
            yield from self._drain(False)
        yield from self._drain(True)

    def _drain(self, last: bool) -> Iterator[bytes]:
        """Everything up to the last special token in the buffer, then what is final of the rest."""
        while self.special and (hit := self.special.search(self.text)):
            rest, self.text = self.text[hit.end() :], self.text[: hit.start()]
            yield from self._words(True)
            yield _packed([self.merges.special[hit[0]]])
            self.text = rest
        yield from self._words(last)

    def _words(self, last: bool) -> Iterator[bytes]:
        while self.text or (last and self.run is not None):
            if self.run is not None:
                end = _RUNS[self.run].match(self.text).end()
                if not last and len(self.text) - end < self.hold:
                    # Its end, or a special token behind it, is not known yet; a last blank may go with what follows.
                    end = max(0, min(end - (self.run == _BLANKS), len(self.text) - self.hold))
                    yield _packed(self.part.feed(self.text[:end].encode()))
                    self.text = self.text[end:]
                    return
                if self.run == _BLANKS and end < len(self.text):
                    end -= 1
                yield _packed(self.part.feed(self.text[: max(end, 0)].encode()))
                yield _packed(self.part.finish())
                self.text, self.run, self.part = self.text[max(end, 0) :], None, None
                continue
            words = split_words(self.text)
            tail = 0
            # Blanks before a special token that is not complete yet are parted otherwise.
            while not last and words and (tail < self.hold or words[-1].isspace()):
                tail += len(words.pop())
            yield b"".join(map(self.memo.__getitem__, words))
            self.text = self.text[len(self.text) - tail :] if not last else ""
            if last or tail < CHUNK:
                return
            long = split_words(self.text)[0]
            if len(long) <= self.hold + 1:
                return
            # One word as long as a chunk: go on with it as an open run, without waiting for its end.
            kind = next(k for k in range(4) if _RUNS[k].fullmatch(long[1:]))
            self.run, self.part = kind, Transducer(self.merges)
            yield _packed(self.part.feed(long[:1].encode()))
            self.text = self.text[1:]


class Decoder:
    """Ids in chunks to text in chunks: bytes of a character that is cut wait for the rest."""

    def __init__(self, merges: Merges):
        self.pieces = merges.pieces
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.pieces.__getitem__, ids)), last)


_LOADED: dict[str, tuple[Merges, Encoder]] = {}


def load(path: str) -> tuple[Merges, Encoder]:
    """Merge list and encoder of a file, once per Python process."""
    if path not in _LOADED:
        merges = Merges(path)
        _LOADED[path] = merges, Encoder(merges)
    return _LOADED[path]


def encode_table(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``ids``, ``n_tokens`` and the SHA-256 of the ids and of the text decoded from them, as hex.

    ``ids`` are packed as little-endian unsigned 32-bit integers, which is also what is hashed. Whole
    texts are encoded, long ones in chunks; null counts as empty, which has no ids; repeated rows
    stay; other columns are ignored. Special tokens in a text become their ids, as in the library.
    Executors read the vocabulary from ``path``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, encoder = load(path)
        for batch in slices(batches, 1):
            packed, counts, of_ids, of_text = [], [], [], []
            for t in texts(batch.column(1)):
                whole, parts = t.decode(), []
                made, decoder = hashlib.sha256(), Decoder(merges)
                chunks = encoder.stream(whole[i : i + CHUNK] for i in range(0, len(whole), CHUNK))
                for part in [encoder.encode(whole)] if len(whole) <= CHUNK else chunks:
                    parts.append(part)
                    made.update(decoder.feed(np.frombuffer(part, "<u4").tolist()).encode())
                made.update(decoder.feed([], True).encode())
                packed.append(b"".join(parts))
                counts.append(len(packed[-1]) // 4)
                of_ids.append(hashlib.sha256(packed[-1]).hexdigest())
                of_text.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, f"doc {kind}, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_table(tokens: DataFrame, path: str, doc: str = "doc", ids: str = "ids", chunk: int = 1 << 14) -> DataFrame:
    """``doc`` and ``text`` decoded from packed ``ids``; null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = load(path)
        for batch in slices(batches, 1):
            out = []
            for packed in batch.column(1).to_pylist():
                decoder, all_ids = Decoder(merges), np.frombuffer(packed or b"", "<u4")
                parts = [decoder.feed(all_ids[i : i + chunk].tolist()) for i in range(0, len(all_ids), chunk)]
                out.append("".join(parts) + decoder.feed([], True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc", "text"])

    kind = tokens.schema[doc].dataType.simpleString()
    return tokens.select(F.col(doc).alias("doc"), F.col(ids).alias("ids")).mapInArrow(run, f"doc {kind}, text string")
