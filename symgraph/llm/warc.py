"""WARC records as a table of chunks.

The writer makes WARC 1.0 files, a gzip member for each record, in the folder given; the reader streams files member by
member through a buffer of one chunk, and a payload of any size becomes rows (record id, chunk number) of at most ``CHUNK`` bytes, each with the
digest of the payload up to its end. Neither holds a whole record. Files that a failed or repeated task left behind are not read: a table of the files
of tasks that ended tells the reader what there is.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.tables import shared_dir, shared_table, small_batches

CHUNK, FILE_BYTES, BATCH_BYTES = 16_384, 128 << 20, 4 << 20
CHUNKS = "record_id string, page_id bigint, url string, chunk_no int, start bigint, n_bytes int, digest string, last boolean, payload binary, error string"


def _header(page_id: int | None, url: str | None, body: memoryview) -> bytes:
    """The record's identifier names the page and the beginning of its payload's digest: pages that share an id with another text are told apart."""
    clean = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{hashlib.sha256(body).hexdigest()[:16]}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean}")
    return ("\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode()


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    where, base = fs.FileSystem.from_uri(folder)
    out, name, size, n = None, "", 0, 0
    names: list[tuple[str, int, int]] = []
    for b in batches:
        for page_id, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
            if out is None:
                where.create_dir(base, recursive=True)
                name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            body = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            size += out.write(packer.compress(_header(page_id.as_py(), url.as_py(), body)))
            for at in range(0, len(body), BATCH_BYTES):
                size += out.write(packer.compress(body[at : at + BATCH_BYTES]))
            size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            n += 1
            if size >= file_bytes:
                out.close()
                names.append((name, n, size))
                out = None
    if out is not None:
        out.close()
        names.append((name, n, size))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.int64()), pa.array([x[2] for x in names], pa.int64())], names=["file", "records", "bytes"])


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to WARC files in folder; (file, records, bytes) of those written.

    Null ids and urls are left out of a record's header, a null html is an empty payload, repeated rows are repeated records, an empty table writes no file; other columns are not looked at.
    """
    small_batches(pages.sparkSession, 200)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return shared_table(rows.mapInArrow(lambda it: _write(it, folder, file_bytes), "file string, records bigint, bytes bigint"), "warc-files")


class Stream:
    """Bytes of a file, gzip members or none, through a small buffer."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.buffer, self.at = source, step, bytearray(), 0
        self.raw = source.read(step)
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        if self.at:
            del self.buffer[: self.at]
            self.at = 0
        while True:
            if not self.raw:
                self.raw = self.source.read(self.step)
                if not self.raw:
                    return False
            if not self.packed:
                self.buffer += self.raw
                self.raw = b""
                return True
            got = self.unpack.decompress(self.raw, self.step)
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data or b"", zlib.decompressobj(31)
            else:
                self.raw = self.unpack.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n", self.at)) < 0:
            if not self.more():
                return None
        out = bytes(self.buffer[self.at : end])
        self.at = end + 2
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, or as many as there are."""
        while len(self.buffer) - self.at < n and self.more():
            pass
        out = bytes(memoryview(self.buffer)[self.at : self.at + n])
        self.at += len(out)
        return out


def records(stream: Stream, chunk: int = CHUNK, name: str = "") -> Iterator[tuple]:
    """Rows of chunks of all records; page ids are those of ``write``, records of other writers have none, and where they have no identifier they get the file's name and their number in it.

    A file ends at what isn't a record, at a record without a length, at damaged compression and at its cut-off end. The chunks until then are
    there; the last row, with ``error``, says what was wrong, and other files are read all the same.
    """
    number, row = 0, (None, None, None, 0, 0, 0, None, False, b"", None)
    try:
        while True:
            first = stream.line()
            if first is None:
                return
            if not first:
                continue
            row = (f"{name}#{number}", None, None, 0, 0, 0, None, False, b"", None)
            if not first.startswith(b"WARC/"):
                yield (*row[:-1], "not a WARC record")
                return
            head = {}
            while line := stream.line():
                key, _, value = line.partition(b":")
                head[key.strip().lower()] = value.strip().decode("utf-8", "replace")
            said, length = head.get(b"warc-record-id", "").strip("<>"), head.get(b"content-length", "")
            page = said.split(":")[2] if said.startswith("urn:page:") else ""
            row = (said or f"{name}#{number}", int(page) if page.lstrip("-").isdigit() else None, head.get(b"warc-target-uri"), 0, 0, 0, None, False, b"", None)
            if not (length.isascii() and length.isdigit()):
                yield (*row[:-1], "no content length")
                return
            size, digest, at, i = int(length), hashlib.sha256(), 0, 0
            while True:
                want = min(chunk, size - at)
                part = stream.take(want)
                digest.update(part)
                short = len(part) < want
                row = (*row[:3], i, at, len(part), digest.copy().hexdigest(), at + len(part) == size, part, "cut short" if short else None)
                yield row
                at, i = at + len(part), i + 1
                if short:
                    return
                if at >= size:
                    break
            number += 1
    except zlib.error as e:
        yield (*row[:3], row[3], row[4] + row[5], 0, row[6], False, b"", f"damaged: {e}")


def _read(batches: Iterator[pa.RecordBatch], folder: str, chunk: int) -> Iterator[pa.RecordBatch]:
    where, base = fs.FileSystem.from_uri(folder)
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for name in b.column(0).to_pylist():
            with where.open_input_stream(os.path.join(base, name), compression=None) as source:
                rows, held = [], 0
                for row in records(Stream(source), chunk, name):
                    rows.append(row)
                    held += row[5] + 200
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


def read(files: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """(record_id, page_id, url, chunk_no, start, n_bytes, digest, last, payload, error) of the records in the files (file) of folder.

    digest is the hex SHA-256 of the payload up to the chunk's end, so the last chunk's is that of the whole. An empty payload has one
    empty chunk; long ones are never whole in memory; equal records of a file each have their rows; no files give an empty result. A broken
    file gives what comes before the break, and a row that names it in ``error`` (else null).
    """
    spread = files.select("file").repartition(max(1, min(files.count(), 10_000)))
    return spread.mapInArrow(lambda it: _read(it, folder, chunk), CHUNKS)


def chunk_table(pages: DataFrame, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages written as WARC files below the shared folder and read back as chunks.

    A null html is an empty payload, a null url and a null id stay null (line ends in a url are percent-encoded); repeated rows are repeated
    records with equal chunks; an empty table gives an empty result; columns other than page_id, url and html are not looked at.
    """
    folder = f"{shared_dir(pages.sparkSession)}/symgraph/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, file_bytes), folder, chunk)
