"""CSV with quoted line breaks, read by many tasks.

Whether a byte lies inside quotes follows from the number of quotes before it. A first pass counts the
quotes of every byte range; running sums over these counts tell each range whether it begins inside
quotes. The task of a range then finds the records that begin in it and reads on to the end of the last one.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .ranges import RANGE, open_file

#: In the order in which they are tried.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "utf-16", "latin-1")
QUOTE, BREAK = 0x22, 0x0A
_MARKS = {codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}


def _units(data: bytes, encoding: str) -> np.ndarray:
    """Code units: two bytes in UTF-16, else one. Neither quotes nor line breaks are part of a longer character."""
    wide = {"utf-16-le": "<u2", "utf-16-be": ">u2"}.get(encoding)
    return np.frombuffer(data, wide) if wide else np.frombuffer(data, np.uint8)


def _mark(source) -> str | None:
    """The kind of UTF-16 that the file begins with."""
    source.seek(0)
    return _MARKS.get(source.read(2))


def _through_break(source, end: int, length: int, step: int = 1 << 16) -> bytes:
    """What follows ``end`` up to and with the next line break; no multi-byte character goes across it."""
    parts = []
    source.seek(end)
    while end < length:
        chunk = source.read(min(step, length - end))
        at = chunk.find(b"\n")
        parts.append(chunk if at < 0 else chunk[: at + 1])
        end += len(chunk)
        if at >= 0 or not chunk:
            break
    return b"".join(parts)


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _survey(encodings: Sequence[str]) -> Callable:
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("length", pa.int64()),
                        ("quotes", pa.int64()), ("wide_quotes", pa.int64()), ("fits", pa.list_(pa.bool_())), ("wide", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with open_file(path) as source:
                    wide = _mark(source)
                    source.seek(start)
                    data = source.read(end - start)
                    # Text is checked from line to line: from the first that begins in the range.
                    begin = 0 if start == 0 else data.find(b"\n") + 1
                    lines = data[begin:] + _through_break(source, end, length) if begin or start == 0 else b""
                plain = lines.isascii()
                fits = [wide is not None and length % 2 == 0 if e == "utf-16" else plain or _decodes(lines, e) for e in encodings]
                row = (path, start, end, length, data.count(b'"'), int((_units(data[: len(data) // 2 * 2], wide) == QUOTE).sum()) if wide else 0, fits, wide)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def _records(header_only: bool) -> Callable:
    schema = pa.schema([("record", pa.string()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, length, inside, encoding in zip(*(batch.column(i).to_pylist() for i in range(6))):
                texts, held, first = [], 0, start == 0

                def flushed() -> pa.RecordBatch:
                    nonlocal held, first
                    flags = [first and i == 0 for i in range(len(texts))]
                    out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(flags, pa.bool_())], schema=schema)
                    first, held = first and not texts, 0
                    texts.clear()
                    return out

                for text in _of_range(path, start, end, length, inside, encoding):
                    texts.append(text)
                    held += len(text)
                    if header_only or held > 1 << 22 or len(texts) == 10_000:
                        yield flushed()
                        if header_only:
                            break
                if texts:
                    yield flushed()

    return run


def _of_range(path: str, start: int, end: int, length: int, inside: bool, encoding: str) -> Iterator[str]:
    """Records that begin in a range, without their line breaks; empty lines are none."""
    width = 2 if encoding.startswith("utf-16-") else 1
    with open_file(path) as source:
        source.seek(max(start - width, 0))
        data = source.read(end - max(start - width, 0))
        before, data = (data[:width], data[width:]) if start else (b"", data)
        units = _units(data, encoding)
        odd = np.cumsum(units == QUOTE) + int(inside) & 1
        breaks = np.flatnonzero((units == BREAK) & (odd == 0)) + 1
        # The record that begins right at the start of the range has its line break before it.
        own = start == 0 or not inside and _units(before, encoding)[0] == BREAK
        starts = np.r_[[0] if own else [], breaks[breaks < len(units)]].astype(np.int64)
        if not len(starts):
            return
        if len(breaks) and breaks[-1] == len(units):
            rest = b""
        else:
            rest, parts, open_, at = b"", [], bool(odd[-1]) if len(odd) else inside, end
            while at < length:
                chunk = source.read(min(1 << 16, length - at))
                more = _units(chunk, encoding)
                parity = np.cumsum(more == QUOTE) + int(open_) & 1
                ends = np.flatnonzero((more == BREAK) & (parity == 0))
                parts.append(chunk if not len(ends) else chunk[: (int(ends[0]) + 1) * width])
                at += len(chunk)
                if len(ends) or not chunk:
                    break
                open_ = bool(parity[-1])
            rest = b"".join(parts)
    ends = np.r_[starts[1:], len(units)]
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        raw = data[s * width : e * width] + (rest if i == len(starts) - 1 else b"")
        text = raw.decode(encoding)
        if start == 0 and i == 0:
            text = text.removeprefix("﻿")
        text = text.removesuffix("\n").removesuffix("\r")
        if text:
            yield text


def read_csv_ranges(
    spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, span: int = RANGE, parts: int | None = None
) -> DataFrame:
    """All columns as text, named as the header of the first file names them.

    Each file has the first of ``encodings`` that all of it fits; ``utf-16`` fits files with its mark. The
    first record of every file is its header. Quotes open a field at its start and are doubled inside.
    """
    span += span % 2
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / span)))
    ranges = files.select("path", "length", number.alias("i")).withColumn("start", F.col("i") * span).select(
        "path", "start", F.least(F.col("start") + span, "length").alias("end"), "length").repartition(parts, "path", "start")
    seen = scratch_dir(spark, "csv-ranges")
    ranges.mapInArrow(
        _survey(encodings),
        "path string, start bigint, end bigint, length bigint, quotes bigint, wide_quotes bigint, fits array<boolean>, wide string",
    ).write.parquet(seen)
    survey = spark.read.parquet(seen)
    known = F.array(*[F.min(F.col("fits")[i]) for i in range(len(encodings))])
    place = F.array_position(known, F.lit(True))
    by_file = survey.groupBy("path").agg(F.max("wide").alias("kind"), place.alias("at"))
    names = F.get(F.array(*map(F.lit, encodings)), F.col("at").cast("int") - 1)
    by_file = by_file.select("path", F.when(names == "utf-16", F.col("kind")).otherwise(names).alias("encoding"))
    if by_file.filter("encoding IS NULL").limit(1).count():
        raise ValueError(f"a file fits none of {list(encodings)}")
    quotes = F.when(F.col("encoding").startswith("utf-16-"), F.col("wide_quotes")).otherwise(F.col("quotes"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside: Column = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 1
    told = survey.join(by_file, "path").select("path", "start", "end", "length", inside.alias("inside"), "encoding")
    heads = told.filter("start = 0").orderBy("path").limit(1).mapInArrow(_records(True), "record string, first boolean")
    header = heads.select("record").first()
    if header is None:
        raise ValueError(f"no header in {path}")
    options = {"escape": '"', "quote": '"'}
    width = spark.range(1).select(F.size(F.split(F.schema_of_csv(F.lit(header.record), options), ":")) - 1).first()[0]
    cells = ", ".join(f"c{i} string" for i in range(width))
    names = spark.range(1).select(F.from_csv(F.lit(header.record), cells, options).alias("h")).select("h.*").first()
    records = told.repartition(parts, "path", "start").mapInArrow(_records(False), "record string, first boolean")
    rows = records.filter("NOT first").select(F.from_csv("record", cells, options).alias("r")).select("r.*")
    return rows.toDF(*[n if n is not None else f"_c{i}" for i, n in enumerate(names)])
