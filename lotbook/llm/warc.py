"""WARC archives of pages, written and read as a table of chunks.

A record is never held whole: it is rows of record identifier and chunk number. The
writer takes them in order, one compressed member per record, and checks the digest as it
goes. The reader streams an archive and gives chunk rows, each with the number of payload
bytes and the digest up to its end. Payloads seen before become revisit records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.llm.common import new_path, numbered, stored

CHUNK_BYTES = 64 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024
MIN_REVISIT_BYTES = 100
# Rows handed on at a time by the reader, in bytes of payload.
BATCH_BYTES = 4 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean, "
    "payload_bytes long, payload_digest string"
)


def _file_system(uri: str):
    """File system and path of a folder or file that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``_row``, ``page_id``, ``url``, ``payload``, its size and digest, and what it repeats.

    Of rows with equal payloads of at least ``min_bytes``, the first by page id is the
    response (rows without an id last) and ``refers_row``, ``refers_to`` of the others
    name it. Only digests are shuffled to find them. The rows are written once with their
    numbers, which the records' names hold.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = numbered(rows.withColumn("payload_digest", F.sha2("payload", 256)), "numbered")
    small = rows.drop("payload", "url").where(F.col("payload_bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    firsts = stored(
        small.groupBy("payload_digest")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("payload_digest", "first"),
        "firsts",
    )
    again = (
        small.join(firsts, "payload_digest")
        .where(F.col("first._row") != F.col("_row"))
        .select(
            "_row",
            F.col("first._row").alias("refers_row"),
            F.col("first.page_id").alias("refers_to"),
        )
    )
    return rows.join(stored(again, "revisits"), "_row", "left")


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of a record's payload, in order; a revisit is one empty chunk."""
    body = F.when(F.col("refers_row").isNull(), F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_body") / F.lit(chunk_bytes)).cast("int"))
    return (
        rows.withColumn("_body", body)
        .withColumn("_count", count)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
        .select(
            *[c for c in rows.columns if c != "payload"],
            "chunk",
            F.substring("_body", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"),
            (F.col("chunk") + 1 == F.col("_count")).alias("last"),
        )
    )


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def _record_head(row, http: bytes) -> bytes:
    revisit = not pd.isna(row.refers_row)
    identifier = f"urn:page:{'null' if pd.isna(row.page_id) else int(row.page_id)}:{int(row.number)}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{identifier}>",
        f"WARC-Date: {DATE}",
    ]
    if isinstance(row.url, str):
        head.append(f"WARC-Target-URI: {_clean(row.url)}")
    if not pd.isna(row.page_id):
        head.append(f"X-Page-Id: {int(row.page_id)}")
    head.append(f"WARC-Payload-Digest: sha256:{row.payload_digest}")
    head.append(f"X-Payload-Bytes: {int(row.payload_bytes)}")
    if revisit:
        to = "null" if pd.isna(row.refers_to) else int(row.refers_to)
        head.append(f"WARC-Profile: {PROFILE}")
        head.append(f"WARC-Refers-To: <urn:page:{to}:{int(row.refers_row)}>")
        if to != "null":
            head.append(f"X-Refers-To-Page: {to}")
        length = 0
    else:
        length = len(http) + int(row.payload_bytes)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace")


class _Archive:
    """One archive file being written, a compressed member per record."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = _file_system(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.records = self.bytes = 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)


def write_archives(
    chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write chunk rows (in order) as archives; gives path, records and bytes of each.

    Every attempt of a task writes files of new names and only those of the attempt that
    succeeds are listed, so a retried or lost task leaves no half archive in the list.
    The list is written to the shared folder; the archives are not written again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = packer = digest = None
        done = []
        for batch in batches:
            for row in batch.rename(columns={"_row": "number"}).itertuples(index=False):
                if row.chunk == 0:
                    if archive is None:
                        archive = _Archive(folder)
                    packer, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
                    http = (
                        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {int(row.payload_bytes)}\r\n\r\n"
                    ).encode()
                    archive.put(packer.compress(_record_head(row, http)))
                    if pd.isna(row.refers_row):
                        archive.put(packer.compress(http))
                data = bytes(row.data)
                digest.update(data)
                archive.put(packer.compress(data))
                if row.last:
                    if pd.isna(row.refers_row) and digest.hexdigest() != row.payload_digest:
                        raise ValueError(f"payload of page {row.page_id} changed on its way")
                    archive.put(packer.compress(b"\r\n\r\n") + packer.flush())
                    archive.records += 1
                    if archive.bytes >= archive_bytes:
                        archive.out.close()
                        done.append((archive.uri, archive.records, archive.bytes))
                        archive = None
        if archive is not None:
            archive.out.close()
            done.append((archive.uri, archive.records, archive.bytes))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    listed = chunks.mapInPandas(write, "path string, records long, bytes long")
    return stored(listed, "archives")


def _members(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """Decompressed bytes of a file of gzip members, a bounded piece at a time."""
    unpacker, waiting, full = zlib.decompressobj(31), b"", False
    while True:
        if not waiting and not full:
            waiting = stream.read(size)
            if not waiting:
                return
        piece = unpacker.decompress(waiting, size)
        full = len(piece) == size
        if piece:
            yield piece
        waiting = unpacker.unconsumed_tail
        if unpacker.eof:
            waiting, unpacker, full = unpacker.unused_data, zlib.decompressobj(31), False


class _Source:
    """Bytes of an archive, taken by line or by count."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def head(self) -> list[str] | None:
        """Lines up to an empty one; none at the end of the archive."""
        while b"\r\n\r\n" not in self.held:
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a header")
                return None
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head.decode("utf-8", "replace").split("\r\n")

    def take(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("archive ends inside a record")
        data, self.held = self.held[:most], self.held[most:]
        return data


def read_records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of an archive, in the order of ``CHUNK_SCHEMA``."""
    source = _Source(_members(stream))
    while True:
        lines = source.head()
        if lines is None:
            return
        head = dict(line.split(": ", 1) for line in lines if ": " in line)
        number = lambda name, head=head: int(head[name]) if name in head else None
        left = int(head["Content-Length"])
        if left:
            http = source.head()
            left -= len("\r\n".join(http).encode("utf-8")) + 4
        fixed = (
            head["WARC-Record-ID"].strip("<>"), number("X-Page-Id"), head.get("WARC-Target-URI"),
            head["WARC-Type"], number("X-Refers-To-Page"),
        )
        declared = (number("X-Payload-Bytes"), head["WARC-Payload-Digest"].removeprefix("sha256:"))
        digest, seen, chunk = hashlib.sha256(), 0, 0
        while True:
            parts, size = [], 0
            while left and size < chunk_bytes:
                parts.append(source.take(min(left, chunk_bytes - size)))
                size += len(parts[-1])
                left -= len(parts[-1])
            data = b"".join(parts)
            digest.update(data)
            seen += size
            yield (
                *fixed, chunk, data, seen, digest.copy().hexdigest(), left == 0, *declared
            )
            chunk += 1
            if not left:
                break
        if source.head() != [""]:
            raise ValueError("record is longer than its header says")


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all archives in ``path``; each archive is streamed by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            for name in ("page_id", "refers_to", "payload_bytes"):
                out[name] = out[name].astype("Int64")
            return out

        for batch in batches:
            for uri in batch["path"]:
                system, path = _file_system(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_records(stream, chunk_bytes):
                        rows.append(row)
                        size += len(row[6]) + 200
                        if size >= BATCH_BYTES:
                            yield frame(rows)
                            rows, size = [], 0
                    yield frame(rows)

    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInPandas(read, CHUNK_SCHEMA)


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Archive all pages and read them back: the chunk table of the archives.

    A null or empty page is a record with an empty payload; a row without a page id is
    archived without one. Rows that repeat id and payload are one response and revisits
    of it.
    """
    folder = new_path(pages.sparkSession, "warc")
    archives = write_archives(chunked(with_revisits(pages), chunk_bytes), folder)
    return read_archives(archives, chunk_bytes)


def page_records(pages: DataFrame) -> DataFrame:
    """One row per page, from the last chunk of its record.

    A revisit has no payload of its own: size and digest are those it declares.
    """
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("payload_bytes")).otherwise(F.col("bytes_so_far"))
    digest = F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far"))
    return (
        round_trip(pages)
        .where("last")
        .select(
            "page_id",
            size.alias("payload_bytes"),
            digest.alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
