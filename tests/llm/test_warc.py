"""WARC archives: round trip, normalising, damaged files and unusual rows."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from vetloom.llm import warc
from vetloom.llm.common import shared_dir


def test_given_pages_come_back(spark):
    from vetloom.llm.queries import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    last = {}
    for p in pages:
        last[p.html] = max(last.get(p.html, -1), p.page_id)
    found = {r.page_id: r for r in QUERIES["op6_warc"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(pages)
    for p in pages:
        data, row = (p.html or "").encode(), found[p.page_id]
        assert row.payload_bytes == len(data)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (row.record_type, row.refers_to) == (("response", None) if last[p.html] == p.page_id else ("revisit", last[p.html]))


def test_unusual_rows(spark, monkeypatch):
    rows = [(1, "http://a/ü b\r\nX: y", None), (2, None, ""), (3, "http://c", "same"), (4, "http://d", "same"), (4, "http://d", "same"), (None, "http://e", "same"),
            (None, "http://f", "alone"), (5, "http://g", "\r\n\r\nWARC/1.1\r\n\r\n" * 3), (6, "http://h", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    found = [(r.page_id, r.url, None if r.payload is None else bytes(r.payload).decode(), r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()]
    assert sorted(found, key=str) == sorted([
        (1, "http://a/%C3%BC%20b%0D%0AX:%20y", None, 0, "revisit", 2), (2, None, "", 0, "response", None),
        (3, "http://c", None, 4, "revisit", 4), (4, "http://d", "same", 4, "response", None), (4, "http://d", "same", 4, "response", None),
        (None, "http://e", None, 4, "revisit", 4), (None, "http://f", "alone", 5, "response", None),
        (5, "http://g", rows[7][2], len(rows[7][2]), "response", None), (6, "http://h", rows[8][2], 140_000, "response", None)], key=str)
    every = warc.warc_round_trip(pages, revisit_from=5).where("record_type = 'revisit'")
    assert every.count() == 0
    assert warc.warc_round_trip(pages.where("false")).count() == 0


def records(n):
    return [warc.record(i, f"http://x/{i}", bytes([65 + i % 26]) * (i * 997), i - 1 if i % 5 == 4 else None) for i in range(n)]


@pytest.mark.parametrize("members", [1, 3])
def test_every_record_gets_its_own_member(members, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 777)
    whole = records(40)
    cut = len(whole) // members
    packed = b"".join(gzip.compress(b"".join(whole[i : i + cut])) for i in range(0, len(whole), cut))
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(packed).read, out.write)
    data = out.getvalue()
    assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) == w for e, w in zip(index, whole)] == [True] * 40
    assert hashlib.sha1(gzip.decompress(data)).digest() == hashlib.sha1(b"".join(whole)).digest()
    assert [e["id"] for e in index] == [f"<urn:page:{i}>" for i in range(40)]


@pytest.mark.parametrize("spoil", [lambda p: p[:-20], lambda p: p[: len(p) // 2], lambda p: gzip.compress(gzip.decompress(p)[:-30]), lambda p: gzip.compress(b"junk" + warc.END)])
def test_damaged_archives_are_errors(spoil):
    packed = spoil(gzip.compress(b"".join(records(9))))
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise(io.BytesIO(packed).read, io.BytesIO().write)


def test_written_again_the_files_are_the_same(spark):
    folder = shared_dir(spark, "warc-again")
    store, path = warc._store(folder)
    store.create_dir(path, recursive=True)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def state():
        warc.write_archives(pages, folder)
        files = store.get_file_info(warc.fs.FileSelector(path))
        return {f.base_name: store.open_input_stream(f.path, compression=None).read() for f in files}

    first = state()
    assert first and state() == first


def test_batches_of_equal_ids_and_lengths_are_all_kept(spark):
    rows = [(None, f"http://x/{i:03d}", None) for i in range(300)] + [(7, f"http://y/{i:03d}", f"{i:03d}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        found = warc.warc_round_trip(pages).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted(r.url for r in found) == sorted(r[1] for r in rows)
    assert sorted(bytes(r.payload).decode() for r in found if r.page_id == 7) == [r[2] for r in rows[300:]]
