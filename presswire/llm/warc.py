"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress by themselves. A bundle is its frames and, in a skippable frame at the end, the
seek table of the Zstandard seekable format: compressed and decompressed size of every frame. An index maps record ids to a bundle,
a frame and an offset inside the decompressed frame, so one record is read by reading one frame.

Each task writes its own bundles through ``pyarrow.fs`` into a folder that all machines share, under names that no other attempt has;
only what a successful task returned gets into the index, so a repeated task leaves at most a file that nothing names.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm.scratch import new_path, written

#: Decompressed bytes from which a frame is closed, and compressed bytes from which a bundle is; a longer record has a frame of its own.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 128 << 20
#: Bytes of records that a task reads.
TASK_BYTES = 16 << 20
#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
#: Ids of revisits go to every executor up to this number; beyond it, pages are shuffled to them.
MAX_BROADCAST_IDS = 1_000_000

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame_at long, frame_bytes long, record_at long, record_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class BundleWriter:
    """Appends records to a bundle and says where each one is once its frame is closed."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.at, self.size, self.parts, self.waiting, self.sizes = 0, 0, [], [], []

    def add(self, key: int | None, record: bytes) -> list[tuple]:
        self.waiting.append((key, self.size, len(record)))
        self.parts.append(record)
        self.size += len(record)
        return self.flush() if self.size >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.parts:
            return []
        frame = self.packer.compress(b"".join(self.parts))
        self.out.write(frame)
        places = [(key, self.at, len(frame), at, n) for key, at, n in self.waiting]
        self.sizes.append((len(frame), self.size))
        self.at += len(frame)
        self.parts, self.waiting, self.size = [], [], 0
        return places

    def close(self) -> list[tuple]:
        places = self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return places


def seek_table(read) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of a bundle opened for random access."""
    size = read.size()
    n, _, magic = struct.unpack("<IBI", read.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entries, out, at = read.read_at(8 * n, size - 9 - 8 * n), [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    key = "" if page_id is None else page_id
    address = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{key}>", "WARC-Date: 2024-01-31T00:00:00Z", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a decompressed frame; a response's digest is taken anew from its payload."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:head_end].decode().split("\r\n")[1:])
        start, n = head_end + 4, int(head["Content-Length"])
        block = data[start : start + n]
        http_end = block.index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in block[: http_end - 4].decode().split("\r\n")[1:])
        revisit = head["WARC-Type"] == "revisit"
        payload = None if revisit else block[http_end:]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        ids = [head.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
        key, other = (int(x) if x else None for x in ids)
        yield {"page_id": key, "url": head["WARC-Target-URI"], "payload_bytes": int(http["Content-Length"]) if revisit else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": other, "payload": payload}
        at = start + n + 4


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of ``REVISIT_FROM`` bytes or more all but that of the largest page_id refer to it.

    Rows that repeat the largest page_id are all responses, and so is a row without id. A null html is an empty payload.
    """
    full = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keys = full.where(F.octet_length("payload") >= REVISIT_FROM).select("page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("digest"))
    keys = written(keys, "payloads")
    groups = keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    # a payload that very many pages have is one row of the groups, which go to the pages
    revisits = written(keys.join(_side(written(groups, "groups")), ["digest", "size"]).where("page_id < refers_to").select("page_id", "refers_to", "digest").distinct(), "revisits")
    marked = full.withColumn("digest", F.sha1("payload")).join(_side(revisits), ["page_id", "digest"], "left")
    return marked.select("page_id", "url", "payload", "refers_to")


def _side(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each of ``pages`` (page_id, url, html) into bundles in ``folder``; returns the index, itself written there.

    Repeated rows have a record each. Without pages there are no bundles and the index has no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer, name, rows = None, "", []

        def index(places: list[tuple]) -> list[dict]:
            return [{"page_id": k, "bundle": f"{folder}/{name}", "frame_at": a, "frame_bytes": b, "record_at": c, "record_bytes": d} for k, a, b, c, d in places]

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                rows += index(writer.add(row["page_id"], record(row["page_id"], row["url"], row["payload"], row["refers_to"])))
                if writer.at >= BUNDLE_BYTES:
                    rows += index(writer.close())
                    writer = None
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                rows = []
        if writer is not None:
            yield pa.RecordBatch.from_pylist(index(writer.close()), schema=_INDEX)

    return written(with_revisits(pages).mapInArrow(run, INDEX), "warc-index")


_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("record_at", pa.int64()), ("record_bytes", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _frames(places: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    """The decompressed frames at (bundle, offset, compressed size), each checked against its bundle's seek table; one in a row is read once."""
    unpack, bundle, sizes, last, data = zstandard.ZstdDecompressor(), None, {}, None, b""
    with contextlib.ExitStack() as opened:
        for place in places:
            if place[0] != bundle:
                bundle = place[0]
                opened.close()  # the bundle before
                store, path = fs.FileSystem.from_uri(bundle)
                read = opened.enter_context(store.open_input_file(path))
                sizes = {at: n for at, n, _ in seek_table(read)}
            if place != last:
                if sizes.get(place[1]) != place[2]:
                    raise ValueError(f"{bundle} has no frame of {place[2]} bytes at {place[1]}")
                last, data = place, unpack.decompress(read.read_at(place[2], place[1]))
            yield data


def _spread(rows: DataFrame, size: str, *by: str) -> DataFrame:
    """``rows`` in order, over as many tasks as their ``size`` in bytes asks for."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.repartitionByRange(max(1, -(-total // TASK_BYTES)), *by).sortWithinPartitions(*by)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of ``bundles`` (bundle), in ``RECORDS``, by their seek tables alone; each bundle is read once, in some task. No bundles: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as read:
                    table = seek_table(read)
                for data in _frames((bundle, at, n) for at, n, _ in table):
                    rows = list(parsed(data))
                    yield pa.RecordBatch.from_pylist(rows if payloads else [r | {"payload": None} for r in rows], schema=_RECORDS)

    sized = bundles.select("bundle").distinct().withColumn("size", F.lit(BUNDLE_BYTES))
    return _spread(sized, "size", "bundle").select("bundle").mapInArrow(run, RECORDS)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The record of each row of ``index``, in ``RECORDS``: its frame is decompressed and cut at its offset. No rows: no records.

    Rows are dealt to tasks by the place of their frames, so that a frame is read once but for the one at a task's edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for r, data in zip(rows, _frames((r["bundle"], r["frame_at"], r["frame_bytes"]) for r in rows), strict=True):
                one = next(parsed(data[r["record_at"] : r["record_at"] + r["record_bytes"]]))
                if one["page_id"] != r["page_id"]:
                    raise ValueError(f"the index names page {r['page_id']} where {r['bundle']} has page {one['page_id']}")
                found.append(one if payloads else one | {"payload": None})
                if len(found) == 64:
                    yield pa.RecordBatch.from_pylist(found, schema=_RECORDS)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=_RECORDS)

    return _spread(index, "record_bytes", "bundle", "frame_at", "record_at").mapInArrow(run, RECORDS)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (page_id), in ``RECORDS``: each needs its frame alone."""
    return read_records(index.join(ids.select("page_id").distinct(), "page_id", "left_semi"))


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The index of bundles with a record for each of ``pages``, in ``folder`` or a new one in the shared folder."""
    return write_bundles(pages, folder or new_path(spark, "warc"))
