"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with a group of whole
WARC records, and a footer: a skippable frame with the seek table (compressed
and decompressed size and checksum of each frame). An index maps each record to
its frame and to its offset within the decompressed frame, so one record costs
the decompression of one frame. Bundles are rows of a table with a binary
column: Spark's commit protocol then covers them when an executor is lost.

A null payload is stored as an empty one, a null URL as an empty header, a null
id as ``null``. Payloads under ``MIN_REVISIT`` bytes are always responses.
Repeated rows with one id give repeated records. An empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MIN_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Add payload_bytes, payload_digest, refers_to: the smallest key with an equal payload, if that is another row's."""
    out = pages.withColumn("_payload", F.encode(F.coalesce(payload, F.lit("")), "UTF-8"))
    out = out.withColumn("payload_bytes", F.octet_length("_payload").cast("long")).withColumn("payload_digest", F.sha2("_payload", 256))
    groups = out.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
    out = out.join(groups.where("_n > 1").select("payload_digest", "_first"), "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(key))
    return out.withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first")


def record_id(key: int | None) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def record_key(name: str) -> int | None:
    key = name[len("<urn:page:") : -1]
    return None if key == "null" else int(key)


def warc_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP head, with the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC headers, HTTP headers, payload of the record at ``at``, and where the next one begins."""

    def head(start: int) -> tuple[dict[str, str], int]:
        end = data.index(b"\r\n\r\n", start)
        lines = data[start:end].decode("utf-8").split("\r\n")
        return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]) | {"": lines[0]}, end + 4

    warc, body = head(at)
    if not warc[""].startswith("WARC/1."):
        raise ValueError(f"no WARC record at {at}")
    end = body + int(warc["Content-Length"])
    http, payload = head(body)
    return warc, http, data[payload:end], end + 4


def close_bundle(frames: list[bytes]) -> bytes:
    """Compressed frames and the seek table that describes them."""
    packer, parts, rows = zstandard.ZstdCompressor(level=3), [], []
    for raw in frames:
        parts.append(packer.compress(raw))
        rows.append(struct.pack("<III", len(parts[-1]), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
    body = b"".join(rows) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return b"".join(parts) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, decompressed size, checksum) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    size = n * width + 9
    if struct.unpack("<II", bundle[-size - 8 : -size]) != (SKIPPABLE, size):
        raise ValueError("damaged seek table")
    out, at = [], 0
    for k in range(n):
        entry = bundle[len(bundle) - size + k * width : len(bundle) - size + (k + 1) * width]
        packed, raw, *check = struct.unpack("<III" if width == 12 else "<II", entry)
        out.append((at, packed, raw, check[0] if check else -1))
        at += packed
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int, int]) -> bytes:
    start, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=max(size, 1))
    if len(raw) != size or check not in (-1, xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF):
        raise ValueError("a frame fails its checksum")
    return raw


def read_one(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A single record by its place: only its frame is decompressed."""
    return parse_record(read_frame(bundle, seek_table(bundle)[frame]), offset)[:3]


def write_bundles(records: DataFrame, key: str, url: str) -> DataFrame:
    """Rows (bundle, archive, ids, frames, offsets) from the output of ``with_revisits``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        frames: list[list[bytes]] = [[]]
        size = total = 0
        index: list[tuple[int | None, int, int]] = []

        def flush() -> pa.RecordBatch:
            archive = close_bundle([b"".join(f) for f in frames if f])
            ids, where, offsets = zip(*index, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{seq:06d}"]), pa.array([archive], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([where], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int64()))], ["bundle", "archive", "ids", "frames", "offsets"])

        for batch in batches:
            for k in range(batch.num_rows):
                one = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
                record = warc_record(*one)
                if size and size + len(record) > FRAME_BYTES:
                    frames.append([])
                    size = 0
                index.append((one[0], len(frames) - 1, size))
                frames[-1].append(record)
                size, total = size + len(record), total + len(record)
                if total >= BUNDLE_BYTES:
                    yield flush()
                    frames, size, total, index, seq = [[]], 0, 0, [], seq + 1
        if index:
            yield flush()

    rows = records.select(F.col(key).cast("long"), url, "_payload", "payload_digest", F.col("refers_to").cast("long"))
    return rows.mapInArrow(pack, "bundle string, archive binary, ids array<long>, frames array<int>, offsets array<long>")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Each record of the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, frame_offset.

    A response's digest is computed from the payload read back and must equal the header's.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, archive, ids, where, offsets = (batch.column(c)[row].as_py() for c in range(5))
                entries, out, last, raw = seek_table(archive), [], -1, b""
                for key, frame, offset in zip(ids, where, offsets, strict=True):
                    if frame != last:
                        last, raw = frame, read_frame(archive, entries[frame])
                    warc, http, payload, _ = parse_record(raw, offset)
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    if record_key(warc["WARC-Record-ID"]) != key or kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record {key} of bundle {name} is damaged")
                    size = len(payload) if kind == "response" else int(http["Content-Length"])
                    refers = record_key(warc["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((key, size, digest, kind, refers, name, frame, offset))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long"
    return bundles.select("bundle", "archive", "ids", "frames", "offsets").mapInArrow(unpack, schema)


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bundles = staged(write_bundles(with_revisits(pages, "page_id", "html"), "page_id", "url"), "warc")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op6_warc_bundles": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f"""
}
