import random
import re
from collections import Counter

import numpy as np
import pytest

from pitmill.llm.collocations import SHARED, collocations, frequent_phrases, multikey_quicksort


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_force(rows, least, top, most=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    found = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(g == lang and len(q) > len(p) and b >= least and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        found.append((lang, " ".join(p), a, left, right, n[lang], score))
    out = []
    for lang in n:
        ranked = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(x[0], i, *x[1:]) for i, x in enumerate(ranked, 1)]
    return sorted(out)


def corpus():
    rng = random.Random(12)
    phrases = ["New York", "in the end of", "Ä ö ü", "one  two\tthree four five six", "the the the the the the", "a.b c", "x, y z"]
    rows = []
    for _ in range(200):
        words = [rng.choice(phrases) if rng.random() < 0.4 else f"w{rng.randrange(25)}" for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "de", None]), rng.choice([" ", "  ", " \n "]).join(words)))
    rows += [("en", None), ("en", ""), ("fr", ".,;"), ("und", "new york " * 30), ("de", "alpha beta gamma " * 40_000), ("en", " ".join(f"u{k}" for k in range(3000)))]
    return rows + [("de", "one passage that many documents share, word for word.")] * 150


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, lang, "x", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    for least, top in ((12, 2000), (30, 7)):
        got = sorted(tuple(r) for r in collocations(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == brute_force(rows, least, top) and len(got) > 20


@pytest.mark.parametrize("hot", [1, 10**9])
def test_all_frequent_phrases_whatever_the_blocks(spark, monkeypatch, hot):
    from pitmill.llm import collocations as module

    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name, value in (("SLICE", 3000), ("COMBINED", 500), ("BUCKETS", 4), ("HOT_SHARE", hot)):
        monkeypatch.setattr(module, name, value)
    phrases, totals = frequent_phrases(df, least=20)
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", " ".join(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    assert {(r.lang, r.phrase): r.n for r in phrases.collect()} == {k: v for k, v in f.items() if v >= 20}
    assert {r.lang: r.total for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for _ in range(20):
        keys = rng.integers(0, 3, (300, 6)).astype(np.int32)
        length = rng.integers(3, 7, 300)
        keys[np.arange(6)[None, :] >= length[:, None]] = -1
        weight = rng.integers(1, 4, 300)
        want = Counter()
        for row, w, size in zip(keys, weight, length):
            for d in range(SHARED, size + 1):
                want[tuple(row[:d])] += int(w)
        for shared in (SHARED, 0):
            at, depth, n = multikey_quicksort(keys, weight, 9, shared)
            got = Counter()
            for p, d, c in zip(at, depth, n):
                got[tuple(keys[p, :d])] += int(c)
            assert got == {k: v for k, v in want.items() if len(k) == shared or v >= 9}
    assert [len(x) for x in multikey_quicksort(np.empty((0, 6), np.int32), np.empty(0, np.int64), 9, SHARED)] == [0, 0, 0]


def test_products_beyond_64_bits(spark):
    big = 2**40
    row = spark.createDataFrame([(big, 2**45, big, big + 1)], "a long, total long, l long, r long")
    from pyspark.sql import functions as F

    from pitmill.llm.collocations import score

    assert row.select(score().alias("s")).first().s == 1000 * big * 2**45 // (big * (big + 1))
    assert row.select(F.lit(1)).count() == 1


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).collect() == []
