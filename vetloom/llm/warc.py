"""WARC archives: writing, normalising monolithic gzip files to one member per record, and reading back.

Files are written by tasks into a folder that driver and executors share, through the file system
that its URI names. A file appears under its name only when it is complete, and its name and content
follow from the rows, so a task that runs again replaces it by the same file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_dir, slices, texts

#: Bytes read at once, payload bytes after which an archive is full, gzip level.
CHUNK, ARCHIVE_BYTES, LEVEL = 1 << 18, 32 << 20, 6
# Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _page_urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page_id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without a body if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = b"" if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _page_urn(page)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _page_urn(refers_to) if revisit else None),
        ("X-Payload-Length", str(len(payload)) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    return _headers(fields) + body + END


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:] if line)}


# ---- streams -------------------------------------------------------------------------------------


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of a gzip file in chunks, whether it has one member or many."""
    inflater = zlib.decompressobj(31)
    fresh = True
    while data := read(CHUNK):
        while data:
            if inflater.eof:
                inflater, fresh = zlib.decompressobj(31), True
            yield inflater.decompress(data, CHUNK)
            fresh = False
            while inflater.unconsumed_tail and not inflater.eof:
                yield inflater.decompress(inflater.unconsumed_tail, CHUNK)
            data = inflater.unused_data
    yield inflater.flush()
    if not fresh and not inflater.eof:
        raise ValueError("the gzip stream is cut off")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """Header and body chunks (with the closing line ends) of each record; bodies are never held whole.

    A body must be used up before the next record is asked for.
    """
    held = b""

    def take(n: int) -> Iterator[bytes]:
        nonlocal held
        while n:
            if not held:
                held = next(chunks, b"")
                if not held and (held := next((c for c in chunks if c), b"")) == b"":
                    raise ValueError("a record is cut off")
            part, held = held[:n], held[n:]
            n -= len(part)
            yield part

    while True:
        while END not in held:
            more = next(chunks, None)
            if more is None:
                if held.strip():
                    raise ValueError("a record is cut off")
                return
            held += more
        header, held = held.split(END, 1)
        if not header.startswith(VERSION):
            raise ValueError("this is no record")
        header += END
        yield header, take(int(_fields(header)["content-length"]) + len(END))


def normalise(read: Callable[[int], bytes], write: Callable[[bytes], object]) -> list[dict]:
    """Rewrites a gzip stream so that each record is a member of its own; returns the offset index.

    The stream is inflated once; neither it nor a record is held in memory.
    """
    index, at = [], 0
    for header, body in split_records(inflate(read)):
        packer, start = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at
        for part in chain([header], body):
            packed = packer.compress(part)
            write(packed)
            at += len(packed)
        packed = packer.flush()
        write(packed)
        at += len(packed)
        fields = _fields(header)
        index.append({"offset": start, "length": at - start, "id": fields["warc-record-id"], "type": fields["warc-type"]})
    return index


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Placed:
    """A file that is written under a temporary name and gets its own when it is complete."""

    def __init__(self, uri: str):
        self.store, self.path = _store(uri)
        self.draft = f"{self.path}.{os.urandom(6).hex()}.draft"

    def __enter__(self):
        self.file = self.store.open_output_stream(self.draft, compression=None)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.store.move(self.draft, self.path)
        else:
            self.store.delete_file(self.draft)


# ---- tasks ---------------------------------------------------------------------------------------


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Monolithic archives: all records of a file in one gzip member.

        A part lies in one task, so part and number of the batch tell all archives apart. The rows of a task
        are in total order, so a task that runs again cuts and numbers them alike.
        """
        for number, batch in enumerate(slices(batches, 3, ARCHIVE_BYTES)):
            name = f"{batch.column(0)[0].as_py():08d}-{number:06d}-{_page_key(batch.column(1)[0].as_py())}.warc.gz"
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            with _Placed(f"{folder}/{name}") as file:
                for i, (page, url, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 4)))):
                    payload = texts(batch.column(3).slice(i, 1))[0]
                    file.write(packer.compress(record(page, url, payload, refers)))
                file.write(packer.flush())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([batch.num_rows], pa.int64())], names=["path", "records"])

    return run


def _page_key(page: int | None) -> str:
    return "none" if page is None else str(page)


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per archive: a file with a member per record beside it, and a sidecar index with a line per record."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            made, beside = uri.replace(".warc.gz", ".members.warc.gz"), uri.replace(".warc.gz", ".members.idx")
            store, path = _store(uri)
            with store.open_input_stream(path, compression=None) as source, _Placed(made) as file:
                index = normalise(source.read, file.write)
            with _Placed(beside) as file:
                file.write("".join(json.dumps(x) + "\n" for x in index).encode())
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([beside]), pa.array([len(index)], pa.int64())],
                                             names=["path", "index", "records"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of normalised archives, each found by its offset and inflated alone."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for uri, beside in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, path = _store(uri)
            with store.open_input_stream(_store(beside)[1], compression=None) as file:
                lines = file.read().splitlines()
            rows, size = [], 0
            with store.open_input_file(path) as file:
                for entry in map(json.loads, lines):
                    file.seek(entry["offset"])
                    whole = zlib.decompress(file.read(entry["length"]), 31)
                    head, _, body = whole.partition(END)
                    fields = _fields(head + END)
                    block = body[: int(fields["content-length"])]
                    if fields["warc-type"] == "response":
                        payload = block.partition(END)[2]
                        length, digest = len(payload), payload_digest(payload)
                        if fields["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    else:
                        payload, length = None, int(fields["x-payload-length"])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    refers = fields.get("warc-refers-to")
                    rows.append((_page_id(fields["warc-record-id"]), fields.get("warc-target-uri"), payload, length, digest,
                                 fields["warc-type"], None if refers is None else _page_id(refers)))
                    size += len(block)
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def _apart(paths: DataFrame) -> DataFrame:
    """Archives spread over tasks, one or a few each."""
    return paths.repartition(max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "path")


def write_archives(
    pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0
) -> DataFrame:
    """Archives (``path``, ``records``) with a record per row of ``pages``.

    Of records with equal payloads of at least ``revisit_from`` bytes, the one with the largest id is a
    response and the others revisit it. Null html is an empty payload, which counts as a payload like
    any other; repeated rows of the responding page are responses; rows without an id revisit the page
    that has one, or are responses; an empty table gives no archive; other columns are ignored.
    """
    size = F.coalesce(F.octet_length(html), F.lit(0))
    rows = pages.select(
        F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"),
        F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("sha"), size.alias("size"),
    )
    first = rows.where(F.col("size") >= revisit_from).groupBy("sha", "size").agg(F.max("page").alias("first"), F.count("*").alias("n"))
    first = keep(first.where("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("_sha"), F.col("size").alias("_size"), "first"), "first")
    told = rows.join(first, (rows["sha"] == F.col("_sha")) & (rows["size"] == F.col("_size")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    # A task writes about one full archive, however large the table is; rows that share an id (or have none)
    # and a payload are spread by their url.
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ARCHIVE_BYTES), 1)
    told = told.select("page", "url", "html", refers.alias("refers"), F.pmod(F.xxhash64("page", "sha", "url"), F.lit(parts)).alias("part"))
    dealt = told.repartition(parts, "part").sortWithinPartitions("part", "page", "url", "html")
    return keep(dealt.select("part", "page", "url", "html", "refers").mapInArrow(_writer(folder), "path string, records bigint"), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """A normalised file and its index for each of ``archives`` (``path``)."""
    made = _apart(archives.select("path")).mapInArrow(_normaliser, "path string, index string, records bigint")
    return keep(made, "members")


def read_archives(members: DataFrame) -> DataFrame:
    """All records of normalised archives (``path``, ``index``); responses come with their payload."""
    return _apart(members.select("path", "index")).mapInArrow(
        _reader, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """``pages`` written as archives to the shared folder, normalised, and read back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return read_archives(normalise_archives(write_archives(pages, folder, **options)))
