"""Phrase collocations by counts of neighbouring ids in direct-address tiles.

Words get ids by frequency, so pairs of frequent words crowd into a few square tiles of the id plane,
which are counted with ``bincount``; the thin rest is counted as sorted coordinates. Frequent pairs are
ranked and become the ids of the next level: two neighbouring pairs are a phrase of three words, and so
on. Ids are never sent to every task: a block sends its words or pairs, packed, to the buckets that count
them, and each bucket replies to the block which of them are frequent and what their ids are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, slices, texts

#: Bits of a tile's side, occurrences from which a tile is counted densely, words of a block, bytes folded at once.
TILE_BITS, DENSE, BLOCK, CHUNK = 8, 4096, 1 << 21, 1 << 20
#: Distinct words of a block, pairs of a bucket, pairs that wait to be added up, blocks whose counts one task adds up.
DISTINCT, BUCKET, WAITING, ADDED = 1 << 19, 1 << 22, 1 << 21, 1024
#: A separator; the byte is not part of any UTF-8 text.
STOP = b"\xff"
#: Between words that are packed; not part of any UTF-8 text either.
NEXT = b"\xfe"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_GAP = re.compile(b"[ \xff]")
_FOLD = bytes.maketrans(_CAPITALS + b".,;:!?\n\v\f\r\t", _CAPITALS.lower() + STOP * 10 + b" ")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words with ``STOP`` between pieces, about ``CHUNK`` bytes at a time; no word is cut."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = len(folded)
        if end - start > CHUNK:
            end = folded.rfind(STOP, start, start + CHUNK) + 1 or folded.rfind(b" ", start, start + CHUNK) + 1
            if not end:  # a word longer than that
                after = _GAP.search(folded, start + CHUNK)
                end = after.end() if after else len(folded)
        yield folded[start:end].replace(STOP, b" " + STOP + b" ").split()
        start = end


class _Words(dict):
    """Ids of the words of one language in the block, given as words come."""

    def __init__(self, every: list[bytes]):
        super().__init__({STOP: 0})
        self.every = every

    def __missing__(self, word: bytes) -> int:
        self.every.append(word)
        self[word] = found = len(self.every)
        return found


def squeeze(ids: np.ndarray) -> bytes:
    data = ids.astype("<u4").tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), "<u4")


def pack_words(keys: list[bytes], at: list[int], counts: list[int]) -> bytes:
    """Words in order, their ids in the block and how often they occur."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    numbers = np.array([[at[i] for i in order], [counts[i] for i in order]], "<i8").tobytes()
    data = numbers + NEXT.join(keys[i] for i in order)
    return b"".join(n.to_bytes(8, "little") for n in (len(keys), len(data))) + pa.compress(data, codec="zstd", asbytes=True)


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n, size = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    raw = pa.decompress(data[16:], size, codec="zstd", asbytes=True)
    at, counts = np.frombuffer(raw[: 16 * n], "<i8").reshape(2, n)
    return raw[16 * n :].split(NEXT), at, counts


_BLOCKS = "block bigint, seq binary, langs array<string>, words array<bigint>, bucket bigint, data binary"


def _blocks(buckets: int, block: int):
    """Blocks of whole pieces: ids from 1 in order of appearance, 0 between pieces and texts; and their words by bucket."""
    schema = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.int64())),
                        ("bucket", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        every: list[bytes] = []
        by_lang: dict[str, _Words] = {}
        parts, size = [], 0

        def closed() -> pa.RecordBatch:
            nonlocal number, size
            seq = np.concatenate(parts)
            counts = np.bincount(seq, minlength=len(every) + 1).tolist()
            homes: dict[int, tuple[list, list, list]] = {}
            totals: dict[str, int] = {}
            for lang, words in by_lang.items():
                begin = lang.encode() + STOP
                for word, at in words.items():
                    if at:
                        key = begin + word
                        own = homes.setdefault(zlib.crc32(key) % buckets, ([], [], []))
                        own[0].append(key)
                        own[1].append(at)
                        own[2].append(counts[at])
                        totals[lang] = totals.get(lang, 0) + counts[at]
            rows = [(number, squeeze(seq), list(totals), list(totals.values()), None, None)]
            rows += [(number, None, None, None, home, pack_words(*own)) for home, own in homes.items()]
            number, size = number + 1, 0
            for held in (every, by_lang, parts):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part in slices(iter([batch]), 1):
                for lang, text in zip(part.column(0).to_pylist(), texts(part.column(1))):
                    for words in words_of(text):
                        if lang not in by_lang:
                            by_lang[lang] = _Words(every)
                        ids = list(map(by_lang[lang].__getitem__, words))
                        parts.append(np.array(ids, "<u4"))
                        size += len(ids)
                        if words and words[-1] == STOP and (size >= block or len(every) >= min(DISTINCT, block)):
                            yield closed()
                    parts.append(np.zeros(1, "<u4"))
                    if size >= block or len(every) >= min(DISTINCT, block):
                        yield closed()
        if size:
            yield closed()

    return run


def _frequent_words(least: int):
    """Words of a bucket that occur ``least`` times or more; blocks' counts are added as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, size = None, [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(waiting).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])

        def made() -> pa.RecordBatch:
            found = summed()
            found = found.filter(pc.greater_equal(found.column("n"), least)).combine_chunks()
            keys = found.column("key").to_pylist()
            parted = [k.split(STOP, 1) for k in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array([here] * len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array([a.decode() for a, _ in parted], pa.string()),
                 pa.array([b for _, b in parted], pa.binary()), pa.array(found.column("n").to_pylist(), pa.int64())],
                names=["bucket", "key", "lang", "word", "f"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != bucket:
                    if waiting:
                        yield made()
                    here, waiting, size = bucket, [], 0
                keys, _, counts = unpack_words(data)
                waiting.append(pa.table({"key": pa.array(keys, pa.binary()), "n": pa.array(counts)}))
                size += len(keys)
                if size > WAITING // 4 + 2 * waiting[0].num_rows:
                    waiting = [summed()]
                    size = waiting[0].num_rows
        if waiting:
            yield made()

    return run


def _word_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block that counted into a bucket, its words that are frequent; a bucket's ids come first."""
    here, keys, ids = None, [], []
    known = None
    for batch in batches:
        for bucket, asks, key, number, block, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if here != bucket:
                here, keys, ids, known = bucket, [], [], None
            if not asks:
                keys.append(key)
                ids.append(number)
                continue
            if known is None:
                known, numbers = pa.array(keys, pa.binary()), np.array(ids, np.int64)
            own, at, _ = unpack_words(data)
            found = pc.index_in(pa.array(own, pa.binary()), value_set=known)
            mine = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(mine):
                mine = mine[np.argsort(at[mine])]
                theirs = numbers[found.take(pa.array(mine)).to_numpy()]
                yield _reply(block, at[mine], np.zeros(len(mine), np.int64), theirs)


def _reply(block: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(a, b, ids)], pa.binary())], names=["block", "data"])


def count_pairs(a: np.ndarray, b: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs (or the sum of its ``counts``)."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    order = np.argsort(a >> TILE_BITS << 32 | b >> TILE_BITS, kind="stable")
    a, b = a[order], b[order]
    counts = None if counts is None else counts[order]
    tile = a >> TILE_BITS << 32 | b >> TILE_BITS
    edges = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)]
    thin, found = np.ones(len(a), bool), []
    side, low = 1 << TILE_BITS, (1 << TILE_BITS) - 1
    for at in np.flatnonzero(np.diff(edges) >= DENSE).tolist():
        here = slice(edges[at], edges[at + 1])
        thin[here] = False
        cell = (a[here] & low) << TILE_BITS | b[here] & low
        sums = np.bincount(cell, None if counts is None else counts[here], side * side).astype(np.int64)
        full = np.flatnonzero(sums)
        corner = int(tile[edges[at]])
        found.append((((corner >> 32) << TILE_BITS | full >> TILE_BITS) << 32 | (corner & 0xFFFFFFFF) << TILE_BITS | full & low, sums[full]))
    code = a[thin] << 32 | b[thin]
    own = np.ones(len(code), np.int64) if counts is None else counts[thin]
    order = np.argsort(code, kind="stable")
    code, own = code[order], own[order]
    starts = np.r_[0, np.flatnonzero(np.diff(code)) + 1] if len(code) else np.zeros(0, np.int64)
    found.append((code[starts], np.add.reduceat(own, starts) if len(code) else own))
    code, sums = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(code, kind="stable")
    return code[order] >> 32, code[order] & 0xFFFFFFFF, sums[order]


def pack(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered pairs with counts, column by column and byte by byte, so that they compress."""
    columns = [np.diff(a, prepend=0), b, counts]
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return np.int64(len(a)).tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    raw = np.frombuffer(pa.decompress(data[8:], 24 * n, codec="zstd", asbytes=True), np.uint8)
    a, b, counts = (np.ascontiguousarray(x.reshape(8, n).T).view("<i8")[:, 0] for x in np.split(raw, 3))
    return np.cumsum(a), b, counts


def _bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """A tile lies in one bucket; tiles are scattered over all."""
    mixed = (a >> TILE_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b >> TILE_BITS).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which two ids stand side by side, and both ids."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, ids[at], ids[at + 1]


def _pairs(buckets: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, a, b = _neighbours(expand(seq))
                if not len(a):
                    continue
                a, b, counts = count_pairs(a, b)
                home = _bucket(a, b, buckets)
                order = np.argsort(home, kind="stable")
                edges = np.r_[0, np.flatnonzero(np.diff(home[order])) + 1, len(order)]
                runs = [order[s:e] for s, e in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(home[r[0]]) for r in runs], pa.int64()), pa.array([(block ^ block >> 32) % salts] * len(runs), pa.int64()),
                     pa.array([block] * len(runs), pa.int64()), pa.array([pack(a[r], b[r], counts[r]) for r in runs], pa.binary())],
                    names=["bucket", "salt", "block", "data"])

    return run


def _sums(least: int | None):
    """Counts of a bucket from packed ones: packed again, or, given ``least``, a row for every frequent pair."""
    names = ["bucket", "data"] if least is None else ["bucket", "a", "b", "f"]

    def made(bucket: int, waiting: list) -> Iterator[pa.RecordBatch]:
        a, b, counts = count_pairs(*(np.concatenate(x) for x in zip(*waiting)))
        if least is None:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack(a, b, counts)], pa.binary())], names=names)
        else:
            often = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum(), bucket)), pa.array(a[often]), pa.array(b[often]), pa.array(counts[often])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, size = None, [], 0
        for batch in batches:
            for bucket, salt, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if here != (bucket, salt):
                    if waiting:
                        yield from made(here[0], waiting)
                    here, waiting, size = (bucket, salt), [], 0
                waiting.append(unpack(data))
                size += len(waiting[-1][0])
                if size > WAITING + 2 * len(waiting[0][0]):
                    waiting = [count_pairs(*(np.concatenate(x) for x in zip(*waiting)))]
                    size = len(waiting[0][0])
        if waiting:
            yield from made(here[0], waiting)

    return run


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block that counted into a bucket, its pairs that are frequent; a bucket's ids come first."""
    here, codes, ids, parts = None, None, None, []
    for batch in batches:
        buckets, first = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(buckets) | np.diff(first)) + 1, len(buckets)] if len(buckets) else [0]
        for s, e in zip(edges[:-1], edges[1:]):
            if here != buckets[s]:
                here, codes, parts = buckets[s], None, []
            rows = batch.slice(s, e - s)
            if not first[s]:
                parts.append((rows.column(2).to_numpy() << 32 | rows.column(3).to_numpy(), rows.column(4).to_numpy()))
                continue
            if codes is None:
                codes, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
                order = np.argsort(codes)
                codes, ids = codes[order], ids[order]
            for block, data in zip(rows.column(5).to_pylist(), rows.column(6).to_pylist()):
                a, b, _ = unpack(data)
                known, mine, theirs = np.intersect1d(a << 32 | b, codes, assume_unique=True, return_indices=True)
                if len(known):
                    yield _reply(block, a[mine], b[mine], ids[theirs])


def _renamed(single: bool):
    """A block with its ids replaced by those of the replies, which come first; 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, []
        for batch in batches:
            for block, reply, seq in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if here != block:
                    here, known = block, []
                if seq is None:
                    known.append(unpack(reply))
                    continue
                old = expand(seq)
                new = np.zeros(len(old), "<u4")
                if known:
                    a, b, ids = (np.concatenate(x) for x in zip(*known))
                    codes = a if single else a << 32 | b
                    order = np.argsort(codes)
                    codes, ids = codes[order], ids[order]
                    at, a, b = (np.arange(len(old)), old, None) if single else _neighbours(old)
                    asked = a.astype(np.int64) if single else a.astype(np.int64) << 32 | b
                    place = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                    new[at] = np.where(codes[place] == asked, ids[place], 0)
                known = []
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeeze(new)], pa.binary())], names=["block", "seq"])

    return run


def ranked(rows: DataFrame, *key: str) -> DataFrame:
    """``id`` from 1 by falling ``f``, ties by a hash; no task sorts all rows.

    Rows are counted per class of nearly equal ``f`` (equal below 1024, equal in ten leading bits beyond)
    and hash bucket; a running sum over these at most some hundred thousand counts gives each bucket its first id. More than 2^32 - 1
    rows are an error.
    """
    rows = rows.withColumn("_class", _class(F.col("f")))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(16)))
    sizes = rows.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("_class").desc(), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_bucket").orderBy(F.col("f").desc(), *key)
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    found = numbered.join(sizes, (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    found = found.withColumn("id", F.col("_before") + F.col("_at"))
    checked = F.when(F.col("id") < 1 << 32, F.col("id")).otherwise(F.raise_error(F.lit("more frequent phrases than 32 bits can name")).cast("long"))
    return found.withColumn("id", checked).drop("_class", "_bucket", "_at", "_c", "_b", "_before")


def _class(f: Column) -> Column:
    """Exact below 1024; beyond, the highest ten bits and how many follow."""
    bits = F.bin(f)
    return F.when(f < 1024, f).otherwise(F.length(bits) * 1024 + F.conv(F.substring(bits, 1, 10), 2, 10).cast("long")).cast("long")


def _level(seqs: DataFrame, words: int, blocks: int, least: int, added: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Frequent pairs (``id``, ``a``, ``b``, ``f``) of neighbouring ids, and the blocks written with their ids."""
    spark = seqs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET), 1)
    salts = max(-(-blocks // added), 1)
    packed = keep(seqs.mapInArrow(_pairs(buckets, salts), "bucket bigint, salt bigint, block bigint, data binary"), f"{name}-pairs")
    some = packed.select("bucket", "salt", "data")
    if salts > 1:  # the counts of very many blocks are added up in two steps, so that no task sees them all
        some = some.repartition(buckets, "bucket", "salt").sortWithinPartitions("bucket", "salt")
        some = some.mapInArrow(_sums(None), "bucket bigint, data binary").select("bucket", F.lit(0).alias("salt"), "data")
    all_ = some.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_sums(least), "bucket bigint, a bigint, b bigint, f bigint")
    found = keep(ranked(keep(all_, f"{name}-sums"), "a", "b"), name)
    told = found.select("bucket", F.lit(0).alias("asks"), "a", "b", "id").unionByName(
        packed.select("bucket", F.lit(1).alias("asks"), "block", "data"), allowMissingColumns=True)
    told = told.repartition(buckets, "bucket").sortWithinPartitions("bucket", "asks")
    replies = told.mapInArrow(_replies, "block bigint, data binary")
    return found, _applied(replies, seqs, blocks, False, f"{name}-blocks")


def _applied(replies: DataFrame, seqs: DataFrame, blocks: int, single: bool, name: str) -> DataFrame:
    parts = max(min(blocks, max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 8)), 1)
    both = replies.unionByName(seqs.select("block", "seq"), allowMissingColumns=True)
    both = both.repartition(parts, "block").sortWithinPartitions("block", F.col("seq").isNotNull())
    return keep(both.mapInArrow(_renamed(single), "block bigint, seq binary"), name)


def _joined(level: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of a level from the two phrases, one word shorter, that they begin and end with."""
    ends = shorter.select(F.col("id").alias("_b"), F.col("last").alias("_last"), F.col("after").alias("_after"))
    starts = shorter.select(F.col("id").alias("_a"), "lang", F.col("phrase").alias("_phrase"), F.col("before").alias("_before"))
    met = level.join(starts, F.col("a") == F.col("_a")).join(ends, F.col("b") == F.col("_b"))
    return met.select(
        "id", "lang", F.concat("_phrase", F.lit(b" "), "_last").alias("phrase"), F.col("_last").alias("last"), "f",
        F.concat("_before", F.array("f")).alias("before"), F.concat("_after", F.array("f")).alias("after"))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = [x.cast("decimal(20,0)") for x in (a * 1000, n, left, right)]
    return F.call_function("div", wide[0] * wide[1], wide[2] * wide[3])


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, first: int = 2000,
    block: int = BLOCK, added: int = ADDED,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``: the best phrases of each language.

    A-Z become lower case; texts are split at ``.,;:!?`` and line breaks into pieces and those at blanks
    and tabs into words. Phrases of 2 to ``longest`` words that occur ``least`` times or more within
    pieces (overlaps count) are candidates. A cut into two parts that occur l and r times scores
    floor(1000 a n / (l r)), where n are the language's words; the lowest cut counts, ties to the first.
    A candidate goes if a longer candidate that contains it is as frequent. The ``first`` of each
    language by score, frequency and phrase (in byte order) are returned.

    Both parts of a frequent phrase are frequent, so every level needs only the one before; and a phrase
    that a longer one covers is also covered by one that is a single word longer.

    Null and blank texts have no words; a null language is ``und``; repeated rows count again; a text
    without any separator stays in one block, others are cut into blocks of about ``block`` words between
    pieces; the counts of more than ``added`` blocks are added up in two steps; an empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = keep(named.where("text IS NOT NULL").mapInArrow(_blocks(buckets, block), _BLOCKS), "blocks")
    every, asked = blocks.where("seq IS NOT NULL").select("block", "seq", "langs", "words"), blocks.where("data IS NOT NULL").select("bucket", "block", "data")
    size = every.agg(F.count("*").alias("blocks"), F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda x, y: x + y)).alias("words")).first()
    total = every.select(F.explode(F.arrays_zip("langs", "words")).alias("t")).groupBy(F.col("t.langs").alias("_lang")).agg(F.sum("t.words").alias("n"))
    total = keep(total, "totals")
    often = asked.select("bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _frequent_words(least), "bucket bigint, key binary, lang string, word binary, f bigint")
    words = keep(ranked(keep(often, "often"), "lang", "word"), "words")
    told = words.select("bucket", F.lit(0).alias("asks"), "key", "id").unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    told = told.repartition(buckets, "bucket").sortWithinPartitions("bucket", "asks").select("bucket", "asks", "key", "id", "block", "data")
    seqs = _applied(told.mapInArrow(_word_replies, "block bigint, data binary"), every, size.blocks, True, "ids")

    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("before"), F.array("f").alias("after"))]
    covers = []
    for k in range(2, longest + 1):
        pairs, seqs = _level(seqs, size.words or 0, size.blocks, least, added, f"phrases{k}")
        levels.append(keep(_joined(pairs, levels[-1]), f"level{k}"))
        covers.append(pairs.select(F.col("a").alias("_id"), "f").unionByName(pairs.select(F.col("b").alias("_id"), "f")).groupBy("_id").agg(F.max("f").alias("_most")))
    kept = []
    for k, level in enumerate(levels[1:], 2):
        cuts = F.array(*[
            F.struct(_score(F.col("f"), F.col("n"), F.col("before")[j - 1], F.col("after")[k - j - 1]).alias("score"), F.lit(j).alias("cut"),
                     F.col("before")[j - 1].alias("l"), F.col("after")[k - j - 1].alias("r")) for j in range(1, k)])
        if k < longest:
            level = level.join(covers[k - 1], F.col("id") == F.col("_id"), "left").where("_most IS NULL OR _most < f")
        scored = level.join(total, F.col("lang") == F.col("_lang")).withColumn("best", F.array_min(cuts))
        kept.append(scored.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score"))
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
