"""MPEG-1 Layer III columns: writing payloads as frames, and reading any such stream.

The reader skips an ID3v2 tag, resynchronises on frame headers (a header counts
when the next one or the stream's end follows at its length), verifies the
CRC-16 of protected frames, parses the variable-bitrate table, and gives the
exact duration in samples and the byte offset of each frame.

The writer carries bytes as main data, 1 to 3 units of 192 bytes a frame, in
protected mono frames at 48 kHz whose bitrate follows the units they carry, so
that a stream has a variable bitrate. ``part2_3_length`` of a frame's granules
tells how much of its main data is payload.

A null or empty payload becomes one unit of blanks. Each row stands alone: order,
ties and repeated rows do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

UNIT = 192
SAMPLES, RATE = 1152, 48000
#: Fixed values of MPEG-1 Layer III: kbit/s by index, and Hz by index.
KBPS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
HERTZ = [44100, 48000, 32000]
#: Units of payload in a frame, and the bitrate index that has room for them.
INDEX_OF_UNITS = {1: 6, 2: 10, 3: 12}
HEAD = 4 + 2 + 17  # header, CRC, side information of a mono frame


def _crc_table(poly: int) -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table(0x8005)


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The CRC of a frame: polynomial 0x8005, from 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


@functools.lru_cache(maxsize=4096)
def parse_header(head: bytes) -> tuple[int, int, int, bool, bool] | None:
    """(frame length, kbit/s, Hz, protected, mono) of a 4-byte Layer III header; None if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xFE != 0xFA:
        return None
    kbps, hertz = head[2] >> 4, head[2] >> 2 & 3
    if kbps in (0, 15) or hertz == 3 or head[3] & 3 == 2:
        return None
    length = 144000 * KBPS[kbps] // HERTZ[hertz] + (head[2] >> 1 & 1)
    return length, KBPS[kbps], HERTZ[hertz], not head[1] & 1, head[3] >> 6 == 3


@functools.lru_cache(maxsize=8)
def frame_start(units: int) -> tuple[bytes, bytes]:
    """Header, CRC and side information of a frame with so many units, and the stuffing after its payload."""
    head = bytes([0xFF, 0xFA, INDEX_OF_UNITS[units] << 4 | 1 << 2, 0xC0])
    bits = units * UNIT * 8 // 2
    side = (bits << (136 - 18 - 12) | bits << (136 - 77 - 12)).to_bytes(17, "big")
    length = parse_header(head)[0]
    return head + struct.pack(">H", crc16(head[2:] + side)) + side, bytes(length - HEAD - units * UNIT)


def id3_tag(texts: dict[str, str]) -> bytes:
    frames = b""
    for name, value in texts.items():
        body = b"\0" + name.encode("latin-1") + b"\0" + value.encode("latin-1")
        frames += b"TXXX" + struct.pack(">IH", len(body), 0) + body
    n = len(frames)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames


def parse_id3(data: bytes) -> tuple[dict[str, str], int]:
    """User texts of an ID3v2.3 tag at the start, and where the tag ends (0: no tag)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    texts, at = {}, 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"TXXX":
            name, _, value = data[at + 11 : at + 10 + size].partition(b"\0")
            texts[name.decode("latin-1")] = value.decode("latin-1")
        at += 10 + size
    return texts, end


def encode(payload: bytes, note: dict[str, str] | None = None) -> bytes:
    """Tag, frame with the variable-bitrate table, and the frames that carry ``payload`` (whole units)."""
    if len(payload) % UNIT or not payload:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    frames, sizes = [], []
    for at in range(0, len(payload), 3 * UNIT):
        part = payload[at : at + 3 * UNIT]
        start, rest = frame_start(len(part) // UNIT)
        frames.append(start + part + rest)
        sizes.append(len(frames[-1]))
    table_head = bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0])
    length = parse_header(table_head)[0]
    n, total = len(frames), length + sum(sizes)
    # every frame but the last has one length, so offsets need no running sum
    toc = bytes(min(255, 256 * (length + k * n // 100 * sizes[0]) // total) for k in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, total) + toc
    first = (table_head + bytes(17) + xing).ljust(length, b"\0")
    tag = id3_tag((note or {}) | {"payload_bytes": str(len(payload)), "payload_crc32": f"{zlib.crc32(payload):08x}"})
    return tag + first + b"".join(frames)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    hertz: int = 0
    samples: int = 0
    kbps_sum: int = 0
    offsets: list[int] = field(default_factory=list)
    skipped: int = 0
    bad_crc: int = 0
    payload: bytes = b""


def decode(data: bytes) -> Stream:
    """Read a stream. Bytes that belong to no frame are counted in ``skipped``; a frame with a wrong CRC is left out and counted."""
    out, parts = Stream(), []
    out.tags, at = parse_id3(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    first, synced = True, False
    while at + 4 <= end:
        got = parse_header(data[at : at + 4])
        stop = at + got[0] if got else 0
        if got is None or stop > end or not synced and stop + 4 <= end and parse_header(data[stop : stop + 4]) is None:
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at, synced = (found if found >= 0 else end), False
            continue
        length, kbps, hertz, protected, mono = got
        side_size = 17 if mono else 32
        body = at + 4 + 2 * protected
        mark = data[body + side_size : body + side_size + 4]
        if first and mark in (b"Xing", b"Info"):
            p = body + side_size + 4
            flags = data[p + 3]
            p += 4
            if flags & 1:
                out.vbr_frames, p = struct.unpack(">I", data[p : p + 4])[0], p + 4
            if flags & 2:
                out.vbr_bytes, p = struct.unpack(">I", data[p : p + 4])[0], p + 4
            if flags & 4:
                out.toc = data[p : p + 100]
            first, at = False, stop
            continue
        first = False
        side = data[body : body + side_size]
        if protected and crc16(data[at + 2 : at + 4] + side) != data[at + 4] << 8 | data[at + 5]:
            out.bad_crc += 1
            out.skipped += 1
            at, synced = at + 1, False
            continue
        synced = True
        out.hertz, out.samples, out.kbps_sum = hertz, out.samples + SAMPLES, out.kbps_sum + kbps
        out.offsets.append(at)
        if mono:
            n = payload_of(side)
            parts.append(data[body + 17 : body + 17 + n])
        at = stop
    out.skipped += max(0, end - at)
    out.payload = b"".join(parts)
    return out


@functools.lru_cache(maxsize=4096)
def payload_of(side: bytes) -> int:
    """Bytes of main data that both granules of a mono frame use."""
    bits = int.from_bytes(side, "big")
    return ((bits >> (136 - 30) & 4095) + (bits >> (136 - 89) & 4095)) // 8


def feature(stream: Stream) -> str:
    n = len(stream.offsets)
    rest = 1000 * stream.samples
    return f"mpeg1-layer3 hz={stream.hertz} frames={n} samples={stream.samples} ms={rest // stream.hertz if stream.hertz else 0} kbps={stream.kbps_sum // n if n else 0} skipped={stream.skipped} bad_crc={stream.bad_crc}"


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as an MPEG stream, read it back, and return its digests, exact duration and seek offsets (and the stream)."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "frame_offsets"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
    if keep_media:
        names, kinds = [*names, "media"], [*kinds, pa.binary()]

    def one(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8")
        media = encode(raw.ljust(-(-max(1, len(raw)) // UNIT) * UNIT, b" "), {"n_bytes": str(len(raw))})
        got = decode(media)
        if f"{zlib.crc32(got.payload):08x}" != got.tags["payload_crc32"] or got.vbr_frames != len(got.offsets):
            raise ValueError("a stored stream reads back differently")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        row = int(got.tags["n_bytes"]), len(got.payload), sha(got.payload), zlib.crc32(got.payload[-16:]), len(media), sha(media), feature(got), got.samples, got.offsets
        return (*row, media) if keep_media else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [one(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [key, *names])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, frame_offsets array<int>"
    return df.select(key, text).mapInArrow(run, schema + (", media binary" if keep_media else ""))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
