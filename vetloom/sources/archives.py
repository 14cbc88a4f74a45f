"""ZIP archives of any size, read member by member.

One job reads the archives' central directories, a few bytes a member. The members are then dealt to
tasks by the range of the archive in which they lie, and each task reads only its members' bytes, in
their order. No task ever holds an archive, so neither its size nor the 2 GB of a row bound it.
"""

from __future__ import annotations

import bz2
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import RANGE, create_file, open_file, replace_file, store

# What reading a damaged or unsupported archive member raises.
DAMAGE = (
    zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError, struct.error
)
#: Bytes of members that leave a task at once, bytes read at once, and the largest member a row can hold.
BATCH, CHUNK, MOST = 16 << 20, 1 << 20, 1 << 30

_DIRECTORY = pa.schema([
    ("archive", pa.string()), ("location", pa.string()), ("path", pa.string()), ("start", pa.int64()),
    ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("method", pa.int32()),
    ("flags", pa.int32()), ("error", pa.string()),
])
_MEMBERS = pa.schema([("archive", pa.string()), ("path", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _directories(fail: bool, unreadable: bool, suffix: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, location in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    with open_file(location) as source, zipfile.ZipFile(source) as opened:
                        infos = opened.infolist()
                except DAMAGE as e:
                    if fail:
                        raise
                    if unreadable:
                        yield _batch([(archive, location, None, 0, 0, 0, 0, 0, 0, _said(e))], _DIRECTORY)
                    continue
                for x in infos:
                    if x.is_dir() or not x.filename.lower().endswith(suffix):
                        continue
                    rows.append((archive, location, x.filename, x.header_offset, x.compress_size, x.file_size, x.CRC, x.compress_type, x.flag_bits, None))
                    if len(rows) == 10_000:
                        yield _batch(rows, _DIRECTORY)
                        rows = []
                if rows:
                    yield _batch(rows, _DIRECTORY)

    return run


def read_member(source, start: int, packed: int, size: int, crc: int, method: int, flags: int) -> bytes:
    """One member whose local header begins at ``start``; never more than ``size`` bytes are unpacked."""
    if flags & 1:
        raise RuntimeError("the member is encrypted")
    if size > MOST:
        raise ValueError(f"a member of {size} bytes does not fit a row")
    source.seek(start)
    head = source.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member begins there")
    source.seek(start + 30 + sum(struct.unpack("<HH", head[26:30])))
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        raise NotImplementedError(f"compression method {method}")
    unpacker = None if method == zipfile.ZIP_STORED else zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else bz2.BZ2Decompressor()
    parts, held, left = [], 0, packed
    while left:
        chunk = source.read(min(left, CHUNK))
        if not chunk:
            raise EOFError("the archive ends within the member")
        left -= len(chunk)
        parts.append(unpacker.decompress(chunk, size + 1 - held) if unpacker else chunk)
        held += len(parts[-1])
        if held > size:
            break
    data = b"".join(parts)
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("length or CRC-32 differ from the directory")
    return data


def _read(fail: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, source, rows, held = None, None, [], 0
        for batch in batches:
            for x in batch.to_pylist():
                data, error = None, x["error"]
                if error is None:
                    try:
                        if here != x["location"]:
                            if source is not None:
                                source.close()
                            here, source = None, None
                            source = open_file(x["location"])
                            here = x["location"]
                        data = read_member(source, x["start"], x["packed"], x["size"], x["crc"], x["method"], x["flags"])
                    except DAMAGE as e:
                        # This member only; the others of the archive are read.
                        if fail:
                            raise
                        error = _said(e)
                rows.append((x["archive"], x["path"], data, error))
                held += len(data or b"")
                if held > BATCH or len(rows) == 10_000:
                    yield _batch(rows, _MEMBERS)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _MEMBERS)
        if source is not None:
            source.close()

    return run


def _columns(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def read_members(
    archives: DataFrame, wanted: Callable, fail: bool = False, unreadable: bool = False, suffix: str = ".py",
    span: int = RANGE, parts: int | None = None,
) -> DataFrame:
    """``(archive, location)`` to ``(archive, path, bytes, error)``, a row for each member with ``suffix``.

    ``wanted`` is a condition on the column ``path``; other members are never read. Members that lie in the same ``span`` bytes of an
    archive are read by one of ``parts`` tasks, in order. Damaged members have null bytes and an ``error``,
    and so have archives without a directory if ``unreadable`` (their path is null); ``fail`` raises instead.
    """
    parts = parts or max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), archives.sparkSession.sparkContext.defaultParallelism)
    listed = archives.select("archive", "location").repartition(parts, "location")
    directory = listed.mapInArrow(_directories(fail, unreadable, suffix), _columns(_DIRECTORY)).filter(F.col("path").isNull() | wanted(F.col("path")))
    dealt = directory.withColumn("_span", F.floor(F.col("start") / span)).repartition(parts, "location", "_span")
    return dealt.sortWithinPartitions("location", "start").drop("_span").mapInArrow(_read(fail), _columns(_MEMBERS))


def write_archives(files: DataFrame, root: str) -> DataFrame:
    """Files ``(path, content)`` into one ZIP archive per partition below ``root``; gives their locations.

    A member is written as it comes, so no archive is held. An archive takes its name only when it is
    whole, and a task that runs again replaces its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():05d}"
        draft = f"{root}/_draft-{context.taskAttemptId()}"
        with create_file(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    made.writestr(zipfile.ZipInfo(path), content if isinstance(content, bytes) else (content or "").encode(), zipfile.ZIP_DEFLATED)
        replace_file(draft, f"{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.zip"])], names=["location"])

    return files.select("path", "content").mapInArrow(run, "location string")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Files ``(path, content)`` as single files below ``root``; gives their locations. A task makes a folder once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = store(root)
        folders = set()
        for batch in batches:
            made = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made.append(f"{root}/{path}")
                place = f"{base}/{path}"
                folder = place.rsplit("/", 1)[0]
                if folder not in folders:
                    at.create_dir(folder, recursive=True)
                    folders.add(folder)
                with at.open_output_stream(place) as out:
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["location"])

    return files.select("path", "content").mapInArrow(run, "location string")
