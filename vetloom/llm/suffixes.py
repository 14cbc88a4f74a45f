"""Removal of repeated byte strings with suffix arrays.

Every string of ``match`` bytes (a window) holds an anchor: the k-gram in it whose hash is smallest.
Equal windows have equal anchors, so

1. anchors are counted by hash; one that a single document has cannot lie in a repeated window, and
   most of the text takes no further part;
2. windows in a row that share an anchor are sent, as one string, to the shard of that anchor, where
   they meet all windows they can be equal to. Windows of an anchor that very many places have go each
   to the shard of its own hash, so that no anchor fills a shard;
3. each shard builds a suffix array over its different strings by refinement in the manner of Larsson
   and Sadakane, takes common prefixes in the manner of Kasai, and finds for each window the smallest
   document that has it. A shard of more than ``SHARD_BYTES`` is built in parts, whose sorted runs of
   windows are merged by binary search;
4. documents meet the spans found in them and drop the covered bytes.

The text itself is shuffled once, by groups of documents; both passes over it use the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

GRAM = 20
#: Text per document group and per shard, text that one suffix array covers, longest piece of a text.
GROUP_BYTES, SHARD_BYTES, PIECE = 4 << 20, 4 << 20, 1 << 20
#: Places beyond which an anchor's windows are dealt out one by one.
HOT = 2000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY_BITS, _PLACE_BITS = 32, 22
_HOT_BIT = np.uint64(1) << np.uint64(63)


# ---- anchors -------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed rolling hash of the ``size`` bytes from each position on."""
    whole, power, length = data.astype(np.uint64), _BASE, 1
    out, out_length = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                if out is None:
                    out, out_length = whole, length
                else:  # the longer half first
                    n = len(out) - length
                    out, out_length = whole[:n] * pow_of(out_length) + out[length : length + n], out_length + length
            length *= 2
            if length > size:
                break
            n = len(whole) - length // 2
            whole = whole[:n] * power + whole[length // 2 : length // 2 + n]
            power = power * power
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def pow_of(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def windows(pieces: list[bytes], match: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: piece, first window, number of windows, anchor hash.

    The pieces together may hold 2^22 bytes.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(pieces), np.uint8)
    none = np.empty(0, np.int64)
    if not len(lengths) or lengths.max() < match:
        return none, none, none, none.astype(np.uint64)
    hashes = _gram_hashes(data, gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, have = match - gram + 1, 1
    while have < width:  # smallest of ever more neighbours
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    edge = np.zeros(len(data) + 1, np.int8)
    long = lengths >= match
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + lengths[long] - match + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[: len(least)]))
    anchor = (least[at] & low).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    piece = np.searchsorted(starts, first, side="right") - 1
    return piece, first - starts[piece], count, hashes[anchor[new]]


def _keys(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and bucket with 32 more bits. The low bits have no part in the choice of anchors."""
    bits = np.uint64(buckets.bit_length() - 1)
    bucket = hashes & np.uint64(buckets - 1)
    return bucket, (bucket << np.uint64(_KEY_BITS)) | ((hashes >> bits) & np.uint64((1 << _KEY_BITS) - 1))


def _pieces(rows: list[bytes], match: int):
    """Texts cut so that every window lies in one piece: lists of (row, offset, bytes) of about ``PIECE``."""
    some, size = [], 0
    for row, text in enumerate(rows):
        for at in range(0, max(len(text) - match + 1, 0), PIECE):
            part = text[at : at + PIECE + match - 1]
            if some and size + len(part) > 2 * PIECE:
                yield some
                some, size = [], 0
            some.append((row, at, part))
            size += len(part)
    if some:
        yield some


def _bytes(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _turns(docs: list[int | None], tags: np.ndarray) -> np.ndarray:
    """0 for the first text of an id in order of its hash, 1 for the second, ...; rows of one id share a group."""
    by_doc: dict[int | None, set[int]] = {}
    for d, t in zip(docs, tags.tolist()):
        by_doc.setdefault(d, set()).add(t)
    several = {d: sorted(t) for d, t in by_doc.items() if d is not None and len(t) > 1}
    return np.array([several[d].index(t) if d in several else 0 for d, t in zip(docs, tags.tolist())], np.int64)


def _array(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _split(order: np.ndarray, keys: np.ndarray):
    """(key, positions) for each different key; ``order`` sorts ``keys``."""
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(keys[part[0]]), part


def _count_anchors(match: int, buckets: int):
    def run(batches):
        for batch in slices(batches, 2):
            groups, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for some in _pieces(texts(batch.column(2)), match):
                piece, _, _, hashes = windows([p for _, _, p in some], match)
                row = np.array([r for r, _, _ in some], np.int64)[piece]
                bucket, key = _keys(hashes, buckets)
                for b, at in _split(np.argsort(bucket, kind="stable"), bucket):
                    rows, inverse = np.unique(row[at], return_inverse=True)
                    short = key[at].view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8]
                    out.append((b, docs[rows].astype("<i8").tobytes(), groups[rows].astype("<i4").tobytes(),
                                _bytes(inverse.astype("<u2" if len(rows) < 1 << 16 else "<u4")), len(rows) < 1 << 16, short.tobytes()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("bucket", "docs", "groups", "rows", "narrow", "keys"), o)) for o in out],
                schema=pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("groups", pa.binary()), ("rows", pa.binary()),
                                  ("narrow", pa.bool_()), ("keys", pa.binary())]))

    return run


def _shared_anchors(hot: int):
    schema = pa.schema([("g", pa.int32()), ("keys", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        """Anchors of a bucket that two documents have, for every group of documents that has them."""
        docs, groups, keys = [], [], []
        for r in rows.to_pylist():
            at = _array(r["rows"], "<u2" if r["narrow"] else "<u4")
            docs.append(np.frombuffer(r["docs"], "<i8")[at])
            groups.append(np.frombuffer(r["groups"], "<i4")[at])
            wide = np.zeros((len(at), 8), np.uint8)
            wide[:, : _KEY_BITS // 8] = np.frombuffer(r["keys"], np.uint8).reshape(len(at), -1)
            keys.append(wide.view("<u8").ravel())
        doc, group, key = np.concatenate(docs), np.concatenate(groups), np.concatenate(keys)
        order = np.argsort(key)
        doc, group, key = doc[order], group[order], key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[start, len(key)])
        shared = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        bucket = np.uint64(rows.column("bucket")[0].as_py())
        full = key | (bucket << np.uint64(_KEY_BITS))
        full = np.where(np.repeat(sizes > hot, sizes), full | _HOT_BIT, full)
        at = np.flatnonzero(np.repeat(shared, sizes))
        out = [(g, np.unique(full[at[i]]).tobytes()) for g, i in _split(np.argsort(group[at], kind="stable"), group[at])]
        return pa.Table.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)

    return run


# ---- strings for the shards ----------------------------------------------------------------------


def _send(match: int, buckets: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("strings", pa.binary()), ("lengths", pa.binary()), ("string", pa.binary()),
                        ("g", pa.int32()), ("doc", pa.binary()), ("turn", pa.binary()), ("place", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Windows of a document group that have a shared anchor, packed by shard."""
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        wanted = np.concatenate([np.frombuffer(k, "<u8") for k in right.column("keys").to_pylist()])
        wanted.sort()
        hot = wanted[wanted >= _HOT_BIT] ^ _HOT_BIT
        wanted = np.sort(wanted & ~_HOT_BIT)
        docs = left.column("doc").to_pylist()
        turns = _turns(docs, left.column("tag").to_numpy())
        found: dict[int, tuple[dict[bytes, int], list[tuple[int, int, int]]]] = {}
        raw = texts(left.column("text").combine_chunks())
        known = [b"" if d is None else t for d, t in zip(docs, raw)]
        for some in _pieces(known, match):
            piece, first, count, hashes = windows([p for _, _, p in some], match)
            _, key = _keys(hashes, buckets)
            at = np.flatnonzero(_in(key, wanted))
            single = _in(key[at], hot)
            shard = (key[at] % np.uint64(shards)).astype(np.int64)
            for k, w, n, s, one in zip(piece[at].tolist(), first[at].tolist(), count[at].tolist(), shard.tolist(), single.tolist()):
                row, offset, text = some[k]
                for a, b in ((i, i + 1) for i in range(w, w + n)) if one else ((w, w + n),):
                    string = text[a : b + match - 1]
                    if one:
                        s = xxhash.xxh64_intdigest(string) % shards
                    strings, entries = found.setdefault(s, ({}, []))
                    entries.append((strings.setdefault(string, len(strings)), row, offset + a))
        out = []
        g = left.column("g")[0].as_py()
        for s, (strings, entries) in found.items():
            e = np.array(entries, np.int64)
            out.append((s, _bytes(b"".join(strings)), _bytes(np.array([*map(len, strings)], "<u4")),
                        _bytes(e[:, 0].astype("<u4")), g, _bytes(np.array([docs[r] for r in e[:, 1]], "<i8")), _bytes(turns[e[:, 1]]), _bytes(e[:, 2])))
        return pa.Table.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)

    return run


def _in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


# ---- suffix arrays -------------------------------------------------------------------------------

_SYMBOL, _PACKED = np.uint64(9), 7  # bits of a symbol, symbols in a word


def _words(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols from each position on, as one number that sorts like them."""
    n = len(symbols)
    one = np.zeros(n + 8, np.uint64)
    one[:n] = symbols
    two = one[: n + 7] << _SYMBOL | one[1 : n + 8]
    four = two[: n + 5] << (_SYMBOL * np.uint64(2)) | two[2 : n + 7]
    return four[:n] << (_SYMBOL * np.uint64(3)) | four[4 : n + 4] >> _SYMBOL


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Suffix order by refinement after Larsson and Sadakane.

    Suffixes are sorted by their first seven symbols; then, round by round, only groups that are not
    yet told apart are sorted by the rank of what follows, which doubles the depth.
    """
    n = len(words)
    order = np.argsort(words)
    sorted_words = words[order]
    start = np.r_[True, sorted_words[1:] != sorted_words[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(start, at, 0))
    rank[order] = group
    alone = start & np.r_[start[1:], True]
    open_at = np.flatnonzero(~alone)
    depth = _PACKED
    while len(open_at):
        suffix = order[open_at]
        key = (rank[suffix] << np.int64(32)) + rank[np.minimum(suffix + depth, n)] + 1
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[open_at] = suffix
        start = np.r_[True, key[1:] != key[:-1]]
        rank[suffix] = np.maximum.accumulate(np.where(start, open_at, 0))
        open_at = open_at[~(start & np.r_[start[1:], True])]
        depth *= 2
    return order


def repeats_previous(words: np.ndarray, order: np.ndarray, match: int) -> np.ndarray:
    """Per position of the suffix array: does the suffix share ``match`` symbols with the one before?

    Kasai: the common prefix of a suffix with its predecessor is at most one shorter than that of the
    suffix that starts one symbol earlier. Positions are taken 32 apart first, then halfway between
    those known, so that each has a bound from its left (at least) and from its right (at most);
    symbols are compared only where the bounds leave the answer open, from the lower bound on.
    """
    n = len(order)
    previous = np.empty(n, np.int64)
    previous[order[1:]] = order[:-1]
    previous[order[0]] = n
    padded = np.concatenate([words, np.zeros(match + 2 * _PACKED, np.uint64)])
    least, most = np.zeros(n, np.int32), np.full(n, match, np.int32)
    step = 32
    todo = np.arange(0, n, step)
    while True:
        left, right = todo - step, np.minimum(todo + step, n - 1)
        if step < 32:
            known = left >= 0
            least[todo[known]] = np.maximum(least[left[known]] - step, 0)
            known = todo + step < n
            most[todo[known]] = np.minimum(most[right[known]] + step, match)
        at = todo[(least[todo] < match) & (most[todo] >= match) & (previous[todo] < n)]
        most[todo[previous[todo] >= n]] = 0
        length = least[at].astype(np.int64)
        while len(at):
            differ = padded[at + length] ^ padded[previous[at] + length]
            same = np.zeros(len(at), np.int64)
            for k in range(1, _PACKED + 1):
                same += (differ >> (_SYMBOL * np.uint64(_PACKED - k))) == 0
            length += same
            over = (same < _PACKED) | (length >= match)
            done = at[over]
            least[done] = most[done] = np.minimum(length[over], match)
            at, length = at[~over], length[~over]
        if step == 1:
            break
        step //= 2
        todo = np.arange(step, n, 2 * step)
    return (least >= match)[order]


def first_holders(strings: list[bytes], holder: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest holder of every window of some strings.

    Returns string and offset of each window, its smallest holder among these strings, and a number
    that equal windows share and that orders the others.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    symbols[starts + lengths] = 0  # the end of a string sorts before every byte
    words = _words(symbols)
    order = suffix_array(words)
    apart = ~repeats_previous(words, order, match)
    string = np.repeat(np.arange(len(strings)), lengths + 1)
    smallest = np.minimum.reduceat(holder[string[order]], np.flatnonzero(apart))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(apart) - 1
    offset = np.arange(len(symbols)) - starts[string]
    at = np.flatnonzero(offset <= lengths[string] - match)
    return string[at], offset[at], smallest[group[at]], group[at]


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of windows with their smallest holder from several, by binary search."""
    keys, least = runs[0]
    for other, held in runs[1:]:
        at = np.searchsorted(keys, other)
        here = np.minimum(at, len(keys) - 1)
        both = keys[here] == other
        least = least.copy()
        least[here[both]] = np.minimum(least[here[both]], held[both])
        keys, least = np.insert(keys, at[~both], other[~both]), np.insert(least, at[~both], held[~both])
    return keys, least


def smallest_holders(strings: list[bytes], holder: np.ndarray, match: int, part_bytes: int = SHARD_BYTES):
    """String, offset and smallest holder of every window; strings beyond ``part_bytes`` in parts."""
    sizes = np.cumsum([len(s) + 1 for s in strings])
    cuts = [0, *np.searchsorted(sizes, np.arange(part_bytes, sizes[-1], part_bytes)).tolist(), len(strings)]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            string, offset, least, place = first_holders(strings[a:b], holder[a:b], match)
            parts.append([string + a, offset, least, place])
    if len(parts) > 1:
        runs = []
        for string, offset, least, place in parts:
            _, first, inverse = np.unique(place, return_index=True, return_inverse=True)
            keys = np.array([strings[s][o : o + match] for s, o in zip(string[first].tolist(), offset[first].tolist())], f"S{match}")
            runs.append((keys, least[first], inverse))
        keys, least = merge_runs([r[:2] for r in runs])
        for part, (own, _, inverse) in zip(parts, runs):
            part[2] = least[np.searchsorted(keys, own)][inverse]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _resolve(match: int):
    schema = pa.schema([("g", pa.int32()), ("doc", pa.binary()), ("turn", pa.binary()), ("start", pa.binary()), ("end", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        """Covered spans of the documents that sent windows to a shard."""
        known: dict[bytes, int] = {}
        string, group, doc, turn, place = [], [], [], [], []
        for r in rows.to_pylist():
            data, ids, at = zstandard.ZstdDecompressor().decompress(r["strings"]), [], 0
            for n in _array(r["lengths"], "<u4").tolist():
                ids.append(known.setdefault(data[at : at + n], len(known)))
                at += n
            string.append(np.array(ids, np.int64)[_array(r["string"], "<u4")])
            group.append(np.full(len(string[-1]), r["g"], np.int32))
            doc.append(_array(r["doc"], "<i8"))
            turn.append(_array(r["turn"], "<i8"))
            place.append(_array(r["place"], "<i8"))
        string, group, doc, turn, place = map(np.concatenate, (string, group, doc, turn, place))
        strings = list(known)
        lengths = np.array([len(s) for s in strings], np.int64)
        holder = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(holder, string, doc)
        of, offset, least = smallest_holders(strings, holder, match)
        # In the smallest document of a string, windows are covered that a smaller one has elsewhere.
        covered = np.flatnonzero(least < holder[of])
        of, offset = of[covered], offset[covered]
        new = np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(of) else np.empty(0, bool)
        at = np.flatnonzero(new)
        run_of, run_start, run_end = of[at], offset[at], offset[np.r_[at[1:], len(of)] - 1] + match if len(of) else offset
        count = np.bincount(run_of, minlength=len(strings))
        first = np.cumsum(count) - count
        own = np.flatnonzero(doc == holder[string])
        times = count[string[own]]
        entry = np.repeat(own, times)
        run = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times) + first[string[entry]]
        # In every other document the whole string is covered.
        later = np.flatnonzero(doc > holder[string])
        entries = np.r_[later, entry]
        start = np.r_[place[later], place[entry] + run_start[run]] if len(entries) else place[:0]
        end = np.r_[place[later] + lengths[string[later]], place[entry] + run_end[run]] if len(entries) else place[:0]
        out = []
        for g, i in _split(np.argsort(group[entries], kind="stable"), group[entries]):
            e = entries[i]
            out.append((g, _bytes(doc[e]), _bytes(turn[e]), _bytes(start[i]), _bytes(end[i])))
        return pa.Table.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)

    return run


# ---- removal -------------------------------------------------------------------------------------


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of spans that overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:], len(start)] - 1]


def whole_characters(part: bytes) -> bytes:
    """The part without the bytes of characters that were cut at its edges."""
    return part.decode("utf-8", "ignore").encode()


def _remove(row_type: pa.DataType, whole: bool):
    schema = pa.schema([("row", row_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if right.num_rows:
            rows = right.to_pylist()
            doc, turn, start, end = (np.concatenate([_array(r[c], "<i8") for r in rows]) for c in ("doc", "turn", "start", "end"))
            order = np.lexsort((turn, doc))
            cuts = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(turn[order]) != 0)) + 1
            for at in np.split(order, cuts):
                spans[int(doc[at[0]]), int(turn[at[0]])] = merge_spans(start[at], end[at])
        raw = texts(left.column("text").combine_chunks())
        removed, count, kept = [], [], []
        docs = left.column("doc").to_pylist()
        for d, t, text in zip(docs, _turns(docs, left.column("tag").to_numpy()).tolist(), raw):
            start, end = spans.get((d, t), ((), ()))
            edges = [0, *np.c_[start, end].ravel().tolist(), len(text)] if len(start) else [0, len(text)]
            parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
            removed.append(len(text) - sum(map(len, parts)))
            kept.append(b"".join(map(whole_characters, parts) if whole and len(start) else parts))
            count.append(len(start))
        columns = [left.column("row"), pa.array([*map(len, raw)], pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(count, pa.int64()), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _power(n: float, most: int) -> int:
    return min(1 << max(int(np.ceil(np.log2(max(n, 1)))), 0), most)


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", match: int = 50, hot: int = HOT,
                   whole: bool = False) -> DataFrame:
    """``row`` (all columns but the text), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` per row.

    Removed is every byte covered by a string of ``match`` bytes (UTF-8, null is empty) that also
    starts in a row with a smaller integer id; strings are judged on the input. Repeated rows of one
    id never remove each other, rows without an id neither remove nor lose anything, texts shorter
    than ``match`` stay as they are, and an empty table gives an empty result. Bytes that remain may
    cut a character, so ``kept`` is binary; with ``whole``, what is left of such characters goes too.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    sizes = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    total = sizes["bytes"] or 0
    groups = max(int(np.ceil(total / GROUP_BYTES)), 8)
    buckets, shards = _power(total / 8 / GROUP_BYTES * 4, 1 << 20), max(int(np.ceil(total / GROUP_BYTES)), 8)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    tag: Column = F.xxhash64(text)
    base = docs.select(
        F.pmod(F.xxhash64(F.coalesce(F.col(doc).cast("long"), tag)), F.lit(groups)).cast("int").alias("g"),
        F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), tag.alias("tag"), F.struct(*rest).alias("row"),
    )
    counted = base.where("doc IS NOT NULL").select("g", "doc", "text").mapInArrow(
        _count_anchors(match, buckets), "bucket int, docs binary, groups binary, rows binary, narrow boolean, keys binary")
    shared = counted.groupBy("bucket").applyInArrow(_shared_anchors(hot), "g int, keys binary")
    grouped = base.groupBy("g")
    sent = grouped.cogroup(shared.groupBy("g")).applyInArrow(
        _send(match, buckets, shards),
        "shard int, strings binary, lengths binary, string binary, g int, doc binary, turn binary, place binary")
    spans = sent.groupBy("shard").applyInArrow(_resolve(match), "g int, doc binary, turn binary, start binary, end binary")
    kind = base.schema["row"].dataType
    return grouped.cogroup(spans.groupBy("g")).applyInArrow(
        _remove(to_arrow_type(kind), whole),
        f"row {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", match: int = 50) -> DataFrame:
    """``docs`` with the remaining text; rows that lose all of it go, untouched rows stay as they are."""
    found = remove_repeats(docs, doc, text, match, whole=True).where("n_removed = 0 OR octet_length(kept) > 0")
    left = F.col("kept").cast("string")
    return found.select(*[left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
