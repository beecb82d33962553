"""Archives: exact round trip, revisits and bounded reading."""

import gzip
import hashlib
import io

import pytest

from lotbook.llm import warc

SCHEMA = "page_id long, url string, html string, chunk int, last string"


def write(spark, tmp_path, rows):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def brute(rows):
    first = {}
    for page_id, _, text in rows:
        data = (text or "").encode()
        if len(data) >= 100:
            order = (page_id is None, page_id or 0)
            first[data] = min(first.get(data, order), order)
    out, used = [], set()
    for page_id, _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        revisit = len(data) >= 100 and data in used
        used.add(data)
        to = first[data][1] if revisit else None
        digest = hashlib.sha256(data).hexdigest()
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", to))
    return sorted(out, key=str)


def test_round_trip_with_odd_pages(spark, tmp_path):
    long, copy = "é<p>" * 60_000, "same page " * 12
    rows = [
        (5, "http://a/", copy), (3, "http://b/\r\nX: y", copy), (9, None, copy), (3, "u", copy),
        (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", copy),
        (7, "u", long), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9),
    ]
    pages = write(spark, tmp_path, rows)
    got = sorted(map(tuple, warc.page_records(pages).collect()), key=str)
    assert got == brute(rows)
    chunks = warc.round_trip(pages, chunk_bytes=1000).where("page_id = 7").orderBy("chunk").collect()
    data, digest = b"", hashlib.sha256()
    for i, row in enumerate(chunks):
        assert row.chunk == i and len(row.data) <= 1000
        data += bytes(row.data)
        digest.update(bytes(row.data))
        assert (row.bytes_so_far, row.digest_so_far) == (len(data), digest.hexdigest())
    assert data.decode() == long and chunks[-1].last


def test_empty_table(spark, tmp_path):
    assert warc.page_records(write(spark, tmp_path, [])).count() == 0


def record(body, head=""):
    text = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\n{head}"
    text += f"WARC-Payload-Digest: sha256:0\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n")


def test_reader_streams_members_and_reports_damage():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"z" * 700_000
    data = record(body) + record(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n")
    rows = list(warc.read_records(io.BytesIO(data), 65536))
    assert sum(len(r[6]) for r in rows) == 700_000 and max(len(r[6]) for r in rows) == 65536
    assert [r[9] for r in rows].count(True) == 2
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.read_records(io.BytesIO(data[: len(data) // 2]), 65536))
