"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each task buffers the first records of an archive, builds a dictionary from them, writes it in a
leading skippable frame, and then each record as one frame compressed with it, so that any record
can be read on its own. Where the records are too few or too short to train a dictionary, the last of
them themselves are one (a raw content dictionary), an eighth of their size at most. Payloads seen before become revisit records that name the first page.
Archives are written under a temporary name in the shared folder and renamed when whole; the
manifest names those of the tasks that counted, so a task that is run again leaves no double.

Defined results: null html is an empty payload; of rows with equal long payloads those with the
smallest page_id are responses (all of them, if that page's row is repeated) and the others revisits;
a null page_id is never the first, and with no other id its rows are all responses; an empty table
gives no archive and no rows; payloads of any length are written whole; columns besides page_id, url and
html play no part and may have any name. Archives in a folder that is given stay there; without one
they are kept in the application's part of the shared folder, which goes when the driver ends.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import prepare, shared_dir, spread_join, staged

#: Payloads of fewer bytes are always written out.
REVISIT_BYTES = 100
#: Records' bytes that a dictionary is built from, its size, and an archive's bytes before the next one is begun.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 1 << 19, 1 << 15, 1 << 28
#: Revisits (an id and an id each) that are broadcast to the writers at most; beyond, pages are shuffled to them.
BROADCAST_ROWS = 200_000
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its payload and not the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "urn:unknown")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES and an eighth of the records' size, 256 bytes at least."""
    size = max(256, min(DICTIONARY_BYTES, sum(map(len, records)) // 8))
    if size >= 4096:
        try:
            return zstandard.train_dictionary(size, [x[:16384] for x in records], k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too few records to train one
            pass
    return b"".join(x[: size // min(len(records), 4)] for x in records[-4:])


class ArchiveWriter:
    """Writes records to a stream; the dictionary comes from the first of them."""

    def __init__(self, out, level: int = 6):
        self.out, self.level = out, level
        self.first: list[bytes] | None = []
        self.held = self.size = self.count = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, raw: bytes) -> None:
        self.count += 1
        if self.first is None:
            self._write(self.compressor.compress(raw))
            return
        self.first.append(raw)
        self.held += len(raw)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        first, self.first = self.first, None
        data = dictionary(first)
        self._write(struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(data))
        for raw in first:
            self._write(self.compressor.compress(raw))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.first:
            self._begin()
        self.out.close()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    head = stream.read(8)
    dictionary, before = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE_MAGIC:
        dictionary, before = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    raw = unpacker.stream_reader(_Joined(before, stream), read_across_frames=True)
    lines = io.BufferedReader(raw, 1 << 18)
    while line := lines.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = lines.read(int(fields["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
            raise ValueError("a WARC record is cut short")
        yield fields, block


class _Joined(io.RawIOBase):
    """Bytes that were read already, then the rest of a stream."""

    def __init__(self, before: bytes, rest):
        self.before, self.rest = before, rest

    def read(self, n: int = -1) -> bytes:
        if self.before:
            out, self.before = self.before, b""
            return out
        return self.rest.read(n)


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, html as archives in folder (a URI that all executors reach); the manifest."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("nth"), "url", payload.alias("payload"))
    meta = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("nth", F.sha2("payload", 256).alias("digest"))
    firsts = meta.groupBy("digest").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    again = spread_join(meta, firsts, "digest").filter(F.col("first").isNotNull() & ~F.col("nth").eqNullSafe(F.col("first")))
    again = again.select(F.col("nth").alias("again"), "digest", F.col("first").cast("string").alias("refers_to")).distinct()
    again = staged(again, "warc-revisits")
    few = again.count() <= BROADCAST_ROWS
    same = F.col("nth").eqNullSafe(F.col("again")) & (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") >= REVISIT_BYTES)
    if not few:  # ids spread the payloads evenly, digests would not
        rows = rows.withColumn("key", F.coalesce("page_id", F.lit("")))
        again = again.withColumn("key2", F.coalesce(F.col("again").cast("string"), F.lit("")))
        same = (F.col("key") == F.col("key2")) & same
    else:
        again = F.broadcast(again)
    rows = rows.join(again, same, "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        writer = name = None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            writer.close()
            store.move(f"{top}/{name}.part", f"{top}/{name}")
            done.append((name, writer.count, writer.size))

        for batch in batches:
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{top}/{name}.part", compression=None))
                writer.add(record("" if page_id is None else page_id, url, data, refers_to, date))
                if writer.size >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x, strict=True)) for x in done])

    return staged(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Each record of the archives: page_id (text), payload_bytes, payload_digest, record_type, refers_to (text)."""
    prepare(manifest.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{top}/{archive}", compression=None) as stream:
                    for fields, block in read_records(stream):
                        rows.append(_row(fields, block))
                        if len(rows) >= 1024:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    spread = manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism, "archive")
    return spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """What a record tells; a response's payload is measured and held against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError("a payload does not have its digest")
    else:
        size = int(head.rpartition(b"Content-Length: ")[2])
    page, refers = (fields.get(x, "")[len("<urn:page:") : -1] or None for x in ("WARC-Record-ID", "WARC-Refers-To"))
    return page, size, digest, fields["WARC-Type"], refers


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives in folder (a URI; else in the shared folder) and read them back, one row per page."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    kind = pages.schema["page_id"].dataType
    back = read_archives(write_archives(pages, folder), folder)
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
