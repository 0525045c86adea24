import hashlib

import pytest
import zstandard

from pitmill.llm.warc_bundles import close_bundle, parse_record, read_bundles, read_frame, read_one, seek_table, warc_record, with_revisits, write_bundles

LONG = "x" * 100


def rows():
    return [(5, "http://a/", LONG), (3, "http://b/\r\nWARC-Type: x", LONG), (9, None, LONG + "ü"), (1, "http://c/", "small"), (2, "http://d/", "small"), (4, "http://e/", None), (6, "http://f/", ""), (7, "http://g/", "<p>\r\n\r\nWARC/1.1</p>" * 50_000), (None, "http://h/", LONG)]


def test_round_trip(spark):
    df = spark.createDataFrame([(k, u, t, 1, "x") for k, u, t in rows()], "page_id long, url string, html string, bundle int, payload_digest string").repartition(2)
    bundles = write_bundles(with_revisits(df.drop("payload_digest"), "page_id", "html"), "page_id", "url").persist()
    got = {r.page_id: r for r in read_bundles(bundles).collect()}
    assert len(got) == len(rows())
    for key, _, text in rows():
        body = (text or "").encode()
        r = got[key]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        first = 3 if text == LONG else key
        assert (r.record_type, r.refers_to) == (("response", None) if key == first else ("revisit", 3))
    for b in bundles.collect():
        for key, frame, offset in zip(b.ids, b.frames, b.offsets):
            warc, _, payload = read_one(b.archive, frame, offset)
            assert warc["WARC-Record-ID"] == f"<urn:page:{'null' if key is None else key}>"
            if warc["WARC-Type"] == "response":
                assert payload == (next(t for k, _, t in rows() if k == key) or "").encode()
    bundles.unpersist()


def test_frames_are_independent_and_readable_by_any_decoder():
    frames = [b"a" * 1000, b"b" * 10, b""]
    bundle = close_bundle(frames)
    table = seek_table(bundle)
    assert [read_frame(bundle, e) for e in reversed(table)] == frames[::-1]
    assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"".join(frames)
    broken = bytearray(bundle)
    broken[table[0][0] + 8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        read_frame(bytes(broken), table[0])
    with pytest.raises(ValueError, match="seek table"):
        seek_table(bundle[:-1])


def test_records():
    data = warc_record(1, "u", b"p", "00", None) + warc_record(2, "u", b"pp", "11", 1)
    warc, http, payload, at = parse_record(data)
    assert (warc["WARC-Type"], http["Content-Length"], payload) == ("response", "1", b"p")
    warc, http, payload, at = parse_record(data, at)
    assert (warc["WARC-Refers-To"], http["Content-Length"], payload, at) == ("<urn:page:1>", "2", b"", len(data))


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_bundles(write_bundles(with_revisits(none, "page_id", "html"), "page_id", "url")).collect() == []
