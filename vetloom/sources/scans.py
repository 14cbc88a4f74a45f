"""Scans of source trees, archives, metadata, tables and label files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_whitespace, unix_path
from ..operators.files import parse_metadata
from .archives import DAMAGE, read_members
from .csv_ranges import ENCODINGS, read_csv_ranges
from .ranges import can_range
from .trees import read_tree

# Path pieces whose files are not source of the project.
EXCLUDED = ("__pycache__", ".dist-info", ".egg-info")
# Column names that mean the same.
ALIASES = {"Directory": "package", "MergedCodeWithoutComments": "code"}


def _decode(df: DataFrame, on_bad_utf8: str) -> DataFrame:
    """``bytes`` to ``content``: drop rows with bad bytes, drop the bytes, or mark them."""
    raw = F.col("bytes").cast("string")
    if on_bad_utf8 == "strict":
        # Null bytes are those of a file that could not be read; its row stays.
        return df.withColumn("content", F.try_validate_utf8(raw)).filter("content IS NOT NULL OR bytes IS NULL")
    replaced = F.make_valid_utf8(raw)
    if on_bad_utf8 == "replace":
        return df.withColumn("content", replaced)
    if on_bad_utf8 == "ignore":
        # Only text that was not valid loses its marks, so marks in valid text stay.
        dropped = F.replace(replaced, F.lit("�"), F.lit(""))
        return df.withColumn("content", F.coalesce(F.try_validate_utf8(raw), dropped))
    raise ValueError(f"unknown rule for bad bytes: {on_bad_utf8}")


def _is_source(path: Column, ignore_case: bool) -> Column:
    suffix = F.lower(path) if ignore_case else path
    keep = suffix.endswith(".py")
    for piece in EXCLUDED:
        keep = keep & ~F.contains(path, F.lit(piece))
    return keep


def _as_files(df: DataFrame, on_bad_utf8: str, *more: str) -> DataFrame:
    """``(archive, path, name, content, size)`` and ``more``; size counts characters."""
    return _decode(df, on_bad_utf8).select(
        "archive",
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "content",
        F.length("content").cast("bigint").alias("size"),
        *more,
    )


def scan_source_files(
    spark: SparkSession, path: str, on_bad_utf8: str = "strict", ignore_case: bool = True, ranged: bool | None = None
) -> DataFrame:
    """All ``.py`` files below a folder; paths are relative to it.

    The scan leaves out files of no bytes, which the analysis would drop as empty anyway. Tasks list and read the
    files; where they cannot open the store by themselves (``ranged`` false, by default told from the path), Spark does.
    """
    root = path.split("://", 1)[-1].rstrip("/") + "/"
    relative = lambda p: F.substring_index(F.regexp_replace(p, "^[a-z0-9]+:/*", "/"), root, -1)
    files = read_tree(spark, path, lambda p: _is_source(relative(p), ignore_case), ranged)
    rows = files.select(
        F.element_at(F.split(F.lit(root.rstrip("/")), "/"), -1).alias("archive"),
        relative(F.col("path")).alias("path"),
        F.col("content").alias("bytes"),
    )
    return _as_files(rows, on_bad_utf8)


def _members(batches: Iterator[pd.DataFrame], fail: bool, unreadable: bool) -> Iterator[pd.DataFrame]:
    """Files of the archives of one task, a bounded number of bytes at a time.

    A damaged member is a row without bytes that says what is wrong; so is an ``unreadable`` archive
    as a whole, without a path, if asked for.
    """
    columns = ["archive", "path", "bytes", "error"]
    limit = 32 * 1024 * 1024
    for batch in batches:
        for archive, data in zip(batch["archive"], batch["bytes"]):
            rows, held = [], 0
            try:
                opened = zipfile.ZipFile(io.BytesIO(data))
            except DAMAGE as e:
                if fail:
                    raise
                if unreadable:
                    row = (archive, None, None, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=columns)
                continue
            for info in opened.infolist():
                if info.is_dir() or not info.filename.lower().endswith(".py"):
                    continue
                try:
                    member = opened.read(info)
                except DAMAGE as e:
                    # This member only; the others of the archive are read.
                    if fail:
                        raise
                    rows.append((archive, info.filename, None, f"{type(e).__name__}: {e}"))
                    continue
                rows.append((archive, info.filename, member, None))
                held += len(member)
                if held > limit:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def expand_archives(archives: DataFrame, fail: bool = False, unreadable: bool = False) -> DataFrame:
    """``(archive, bytes)`` to one row per Python member, inside the tasks that hold the archive.

    Members that cannot be read have null bytes and an ``error``, and so have archives with ``unreadable``.

    The members are then spread by path, since one archive may hold most of the files.
    """
    members = archives.mapInPandas(
        lambda batches: _members(batches, fail, unreadable),
        "archive string, path string, bytes binary, error string",
    )
    return members.repartition(F.xxhash64("archive", "path"))


def archive_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def scan_archives(
    spark: SparkSession,
    path: str,
    on_bad_utf8: str = "strict",
    fail: bool = False,
    ignore_case: bool = True,
    unreadable: bool = False,
    ranged: bool | None = None,
) -> DataFrame:
    """Python files of all ZIP archives matching ``path``, as ``archive_files`` gives them.

    Archives of any size are read by byte ranges of their members. Where executors cannot open the
    store by themselves (``ranged`` false, by default told from the path's scheme), each archive is
    read by Spark as one value, which bounds it to 2 GB.
    """
    zips = spark.read.format("binaryFile").load(path)
    name = archive_stem(F.col("path")).alias("archive")
    ranged = can_range(path) if ranged is None else ranged
    zips = zips.select(name, F.col("path").alias("location") if ranged else F.col("content").alias("bytes"))
    return archive_files(zips, on_bad_utf8, fail, ignore_case, unreadable)


def archive_files(
    archives: DataFrame,
    on_bad_utf8: str = "strict",
    fail: bool = False,
    ignore_case: bool = True,
    unreadable: bool = False,
) -> DataFrame:
    """File table of ``(archive, location)`` or ``(archive, bytes)``; the batch scan and the stream share it.

    A damaged member has null ``content`` and ``size`` and its ``error``. An archive that is none has no
    row, or with ``unreadable`` one without a path.
    """
    if "location" in archives.columns:
        wanted = lambda path: _is_source(unix_path(path), ignore_case)
        members = read_members(archives, wanted, fail, unreadable)
    else:
        members = expand_archives(archives, fail, unreadable)
    members = members.withColumn("path", unix_path(F.col("path")))
    keep = F.col("path").isNull() | _is_source(F.col("path"), ignore_case)
    return _as_files(members.filter(keep), on_bad_utf8, "error")


def scan_package_metadata(spark: SparkSession, path: str, ranged: bool | None = None) -> DataFrame:
    """One row per ``*.txt`` file with its recognised keys; files without any are dropped.

    Tasks list and read the files, as for ``scan_source_files``.
    """
    files = read_tree(spark, path, lambda p: p.endswith(".txt"), ranged).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("content").alias("bytes"),
    )
    text = _decode(files, "ignore").select("file_name", F.col("content").alias("text"))
    return parse_metadata(text)


def parse_versions(lines: DataFrame, freeze: bool = False) -> DataFrame:
    """``name version`` lines, or ``name==version`` lines; headings and rules are left out."""
    line = strip_whitespace(F.col("value"))
    if freeze:
        parts = F.split(line, "==")
        return (
            lines.filter(F.contains(F.col("value"), F.lit("==")))
            .select(parts.alias("p"))
            .select(F.trim(F.col("p")[0]).alias("name"), F.trim(F.col("p")[1]).alias("version"))
        )
    return (
        lines.select(F.split(line, r"\s+").alias("p"))
        .filter(F.size("p") >= 2)
        .select(F.col("p")[0].alias("name"), F.col("p")[1].alias("version"))
        .filter(~F.col("name").rlike("^-+$") & (F.lower("name") != "package"))
    )


def scan_versions(spark: SparkSession, path: str, freeze: bool = False) -> DataFrame:
    return parse_versions(spark.read.text(path), freeze)


def scan_csv(
    spark: SparkSession,
    path: str,
    encodings: Sequence[str] = ENCODINGS,
    aliases: Mapping[str, str] = ALIASES,
    required: Sequence[str] = (),
    ranged: bool | None = None,
) -> DataFrame:
    """Header CSV with quoted line breaks; column names lose a byte-order mark and get aliases.

    Large files are read by many tasks, and each file has the first encoding that fits it. Where
    executors cannot open the store by themselves (``ranged`` false, by default told from the path's
    scheme), Spark reads each file in one task, as UTF-8 or else in the last encoding.
    """
    if can_range(path) if ranged is None else ranged:
        df = read_csv_ranges(spark, path, encodings)
    else:
        broken = spark.read.text(path).filter(F.try_validate_utf8("value").isNull())
        names = {"utf8": "UTF-8", "latin1": "ISO-8859-1"}
        encoding = encodings[0] if broken.isEmpty() else encodings[-1]
        charset = names.get(encoding.lower().replace("-", ""), encoding)
        reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        df = reader.option("encoding", charset).csv(path)
    clean = [c.replace("﻿", "").strip() for c in df.columns]
    df = df.toDF(*[aliases.get(c, c) for c in clean])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def parse_labels(texts: DataFrame, text: str = "value") -> DataFrame:
    """Label list text to ``(class_idx, name)``; blank lines do not count."""
    names = F.filter(
        F.transform(F.split(text, r"\r\n|\r|\n"), strip_whitespace), lambda x: x != ""
    )
    return texts.select(F.posexplode(names).alias("class_idx", "name"))


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a label file; an absent file gives no labels."""
    try:
        return parse_labels(spark.read.text(path, wholetext=True))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "class_idx int, name string")


def scan_top_packages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{"rows": [{"project": ...}]}`` to one row per project; one document per file or line."""
    schema = "rows array<struct<project:string,download_count:bigint>>"
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return rows.select(F.explode("rows").alias("r")).select("r.project")


def scan_download_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a download log with nested ``file.project``."""
    schema = "file struct<project:string>"
    return spark.read.schema(schema).json(path).select(F.col("file.project").alias("project"))
