import random

import pytest

from pitmill.llm.sentence_pieces import BLANK, MODEL, StreamingViterbi, decode_ids, encode, encode_stream, encode_texts, load_pieces

sentencepiece = pytest.importorskip("sentencepiece")
pieces = load_pieces()
TEXTS = ["", " ", "a", "Hello, world!", "  two  blanks ", "line\nbreak\ttab", "äöü ñ éauxtionre", "日本語のテキスト", "😀 emoji", f"a{BLANK}b {BLANK}", "<s> </s> <unk> <0x41>", "x" * 700, "thonorin the ed " * 300, "\x00\x7f", "ё" * 50]


def full_table(text):
    """Viterbi over the whole text at once."""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.search.get(text[start:end])
            score = None
            if found:
                score, ids = best[start][0] + found[1], [found[0]]
            elif end == start + 1:
                score, ids = best[start][0] + pieces.unknown, [pieces.byte_ids[b] for b in text[start:end].encode()]
            if score is not None and (top is None or score > top[0]):
                top = (score, start, ids)
        best.append((top[0], best[top[1]][1] + top[2]))
    return best[-1][1]


def library():
    """The library's own unigram search over the same pieces and scores."""
    data = open(MODEL, "rb").read()
    out, at = b"", 0

    def varint(p):
        value = shift = 0
        while True:
            value |= (data[p] & 127) << shift
            p, shift = p + 1, shift + 7
            if not data[p - 1] & 128:
                return value, p

    while at < len(data):
        tag, p = varint(at)
        size, p = varint(p)
        body = data[p : p + size]
        if tag >> 3 == 2:  # trainer settings; their field 3 is the kind of model
            k = body.index(b"\x18\x02")
            body = body[:k] + b"\x18\x01" + body[k + 2 :]
        out += data[at:p] + body
        at = p + size
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_equals_full_table_and_parts():
    rng = random.Random(1)
    for text in TEXTS:
        whole = BLANK + text.replace(BLANK, "?").replace(" ", BLANK)
        want = full_table(whole)
        assert list(encode_stream([whole], pieces)) == want
        cuts = sorted(rng.randrange(len(whole) + 1) for _ in range(6))
        assert list(encode_stream([whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])], pieces)) == want
        if text:
            assert encode(text.replace(BLANK, "?"), pieces).tolist() == want


def test_equals_library():
    model = library()
    for text in TEXTS:
        if BLANK not in text and "\x00" not in text:
            assert encode(text, pieces).tolist() == model.encode(text)


def test_window_is_bounded():
    search = StreamingViterbi(pieces)
    for _ in range(2000):
        search.feed("thonorinabledx")
        assert len(search.scores) == len(search.sizes) == len(search.text) + 1 < 400


def test_every_id_comes_from_the_streaming_search(monkeypatch):
    given, commit = [], StreamingViterbi._commit

    def counted(self, boundary, out):
        before = len(out)
        commit(self, boundary, out)
        given.append(len(out) - before)

    monkeypatch.setattr(StreamingViterbi, "_commit", counted)
    pieces.cache.clear()
    pieces.older.clear()
    text = " ".join(f"thonorin{k}able" for k in range(300)) + "thonorinable" * 700
    assert sum(given) == 0 and len(encode(text, pieces)) == sum(given) and max(given) < 300
    pieces.cache.clear()
    pieces.older.clear()


def test_long_stretches_without_convergence():
    rng = random.Random(4)
    for text in ["thonorin" * 2000, "".join(rng.choice("thoinerasd") for _ in range(9000)), "ё" * 5000, "a" * 5000]:
        assert encode(text, pieces).tolist() == full_table(BLANK + text)


def test_round_trip_on_spark(spark):
    rows = [(k, t, [1]) for k, t in enumerate(TEXTS)] + [(0, "", [1]), (None, "a b", [2]), (99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    out = encode_texts(df, pieces)
    assert out.where("NOT round_trip").count() == 0
    back = decode_ids(out, pieces)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("doc_id", "text").collect()))
    assert encode_texts(df.limit(0), pieces).collect() == []
