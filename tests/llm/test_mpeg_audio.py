import hashlib
import random
import zlib

from pitmill.llm.mpeg_audio import UNIT, crc16, decode, encode, frame_start, parse_header, store_texts


def plain_crc(data):
    c = 0xFFFF
    for byte in data:
        for k in range(8):
            c = (c << 1 ^ (0x8005 if (c >> 15 ^ byte >> (7 - k)) & 1 else 0)) & 0xFFFF
    return c


def test_headers_and_checksums():
    assert parse_header(bytes([0xFF, 0xFB, 0x90, 0x00]))[:3] == (417, 128, 44100)  # 128 kbit/s at 44.1 kHz
    assert parse_header(bytes([0xFF, 0xFB, 0x92, 0x00]))[0] == 418
    assert parse_header(b"\xff\xfb\xf0\x00") is None and parse_header(b"\xff\xe3\x90\x00") is None and parse_header(b"\xff") is None
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.randrange(256) for _ in range(19))
        assert crc16(data) == plain_crc(data)
    for units in (1, 2, 3):
        start, rest = frame_start(units)
        assert parse_header(start[:4])[0] == len(start) + units * UNIT + len(rest)


def test_round_trip_and_resync():
    rng = random.Random(2)
    for units in (1, 2, 3, 4, 7, 40):
        payload = bytes(rng.randrange(256) for _ in range(units * UNIT))
        media = encode(payload, {"n_bytes": "5"})
        got = decode(media)
        assert got.payload == payload and got.vbr_frames == len(got.offsets) == -(-units // 3) and got.tags["n_bytes"] == "5"
        assert got.samples == 1152 * len(got.offsets) and got.skipped == got.bad_crc == 0 and len(got.toc) == 100
        assert all(parse_header(media[at : at + 4]) for at in got.offsets)
        noisy = b"junk\xff\xfb" + media + b"TAG" + bytes(125)
        again = decode(noisy)
        assert again.payload == payload and again.skipped > 0


def test_damage_is_found():
    payload = bytes(range(192)) * 9
    media = bytearray(encode(payload))
    at = decode(bytes(media)).offsets
    media[at[1] + 8] ^= 0xFF  # side information
    got = decode(bytes(media))
    assert got.bad_crc >= 1 and len(got.offsets) == 2 and got.payload == payload[:576] + payload[1152:]


def test_contract(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "ü" * 96), (5, "ü" * 96 + "x"), (6, "long " * 100_000), (7, "abc"), (None, "abc"), (1, "abc")]
    df = spark.createDataFrame([(k, t, b"x", 1) for k, t in rows], "doc_id long, text string, media binary, n_bytes int")
    got = store_texts(df, keep_media=True).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (key, text) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(rows, key=lambda r: (r[0] or 0, len((r[1] or "").encode())))):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (key, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and decode(bytes(r.media)).payload == payload
        assert by_text.setdefault(text or "", r[1:]) == r[1:]
    assert store_texts(df.limit(0)).collect() == []
