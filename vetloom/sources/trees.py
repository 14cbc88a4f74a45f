"""Folders of many single files, listed and read by tasks.

The driver only looks whether the folder is there. One task lists the upper folders, until there are enough of them
to deal out; tasks walk the others. Then the files' names, not their bytes, are dealt to the tasks that read them.
The rows are those of Spark's ``binaryFile`` source, which lists on the driver and reads 32 small files a task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import BATCH
from .ranges import can_range, store

#: Rows that leave a task at once.
ROWS = 10_000
_FOUND = pa.schema([("path", pa.string()), ("folder", pa.bool_())])
_FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's file sources leave out."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(root: str) -> Callable[[str], Iterator[tuple[str, bool]]]:
    """Gives ``(path, is a folder)`` of what lies in a folder below ``root``."""
    at, base = store(root)

    def local(place: str) -> Iterator[tuple[str, bool]]:
        with os.scandir(place) as found:
            for x in found:
                # A link to nothing is no file.
                if not x.is_symlink() or os.path.exists(x.path):
                    yield x.name, x.is_dir()

    def remote(place: str) -> Iterator[tuple[str, bool]]:
        for x in at.get_file_info(fs.FileSelector(place)):
            yield x.base_name, x.type == fs.FileType.Directory

    listed = local if isinstance(at, fs.LocalFileSystem) else remote

    def inside(folder: str) -> Iterator[tuple[str, bool]]:
        for name, is_folder in listed(base + folder[len(root) :]):
            if not _hidden(name, is_folder):
                yield f"{folder}/{name}", is_folder

    return inside


def _batches(rows: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    paths, folders = [], []
    for path, folder in rows:
        paths.append(path)
        folders.append(folder)
        if len(paths) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(folders)], schema=_FOUND)
            paths, folders = [], []
    if paths:
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(folders)], schema=_FOUND)


def _list(root: str, enough: int | None) -> Callable:
    """Files of the folders given and of those below; ``enough`` open folders are handed on as they are."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool]]:
        inside = _entries(root)
        for batch in batches:
            for path, folder in zip(*(c.to_pylist() for c in batch.columns)):
                if not folder:
                    yield path, False
                    continue
                # Level by level until there are enough, else into the depth, which holds fewer folders open.
                left = [path]
                while left and (enough is None or len(left) < enough):
                    for found, is_folder in inside(left.pop(-1 if enough is None else 0)):
                        if is_folder:
                            left.append(found)
                        else:
                            yield found, False
                for found in left:
                    yield found, True

    return lambda batches: _batches(walk(batches))


def _read(root: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = store(root)
        paths, data, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with at.open_input_file(base + path[len(root) :]) as source:
                    content = source.read()
                if not content:
                    continue
                paths.append(path)
                data.append(content)
                held += len(content)
                if held > BATCH or len(paths) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(data, pa.binary())], schema=_FILES)
                    paths, data, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(data, pa.binary())], schema=_FILES)

    return run


def _folder(spark: SparkSession, path: str) -> str | None:
    """The folder as Spark names it, if tasks can list it by themselves."""
    if not can_range(path) or any(c in path for c in "*?[{\\"):
        return None
    scheme, mark, rest = path.partition(":/")
    if not mark:
        if not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
            return None
        scheme, rest = "file", os.path.abspath(path)
    root = "file:" + os.path.normpath("/" + rest.lstrip("/")) if scheme == "file" else path.rstrip("/")
    at, base = store(root)
    # Whatever is no folder is left to Spark, also to say so.
    return root if at.get_file_info(base).type == fs.FileType.Directory else None


def read_tree(spark: SparkSession, path: str, wanted: Callable[[Column], Column], ranged: bool | None = None) -> DataFrame:
    """``(path, content)`` of the files below a folder whose path is ``wanted``; others are not opened.

    Files of no bytes and hidden ones are left out, as Spark's file sources do. Where tasks cannot open the store
    by themselves (``ranged`` false, by default told from the path), and for patterns, Spark lists and reads.
    """
    root = None if ranged is False else _folder(spark, path)
    if root is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select("path", "content").filter(wanted(F.col("path")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    top = spark.range(1, numPartitions=1).select(F.lit(root).alias("path"), F.lit(True).alias("folder"))
    upper = top.mapInArrow(_list(root, 4 * parts), "path string, folder boolean")
    found = upper.repartition(parts, "path").mapInArrow(_list(root, None), "path string, folder boolean")
    names = found.select("path").filter(wanted(F.col("path"))).repartition(parts, "path")
    return names.mapInArrow(_read(root), "path string, content binary")
