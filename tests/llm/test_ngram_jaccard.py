import random
import re

import numpy as np
import pytest

from pitmill.llm.components import components
from pitmill.llm.ngram_jaccard import near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, width, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {k: (len(sets[i]), root(k)) for i, (k, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [None, "", "  \t", "One", "one", "one two", "A b  c", "a B c d", "x " * 5000, "x " * 4000]
    rng.shuffle(rows)
    return [(10 + k, text) for k, text in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 80, 3)])
def test_equals_brute_force(spark, width, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, token string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width, percent).collect()}
    assert got == brute_force(rows, width, percent)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == []
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in near_duplicates(rows).collect())
    assert got == [(0, 2, 5), (5, 2, 5), (5, 2, 5), (9, 0, 9)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("block", [3, 128])
def test_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr("pitmill.llm.ngram_jaccard.BLOCK_DOCS", block)
    rng = random.Random(4)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base[:k] + [f"z{k}"] * (k > 0) + base[k + 1 :]) for k in range(0, 150, 12)]
    texts += [texts[3], texts[5]] + [" ".join(base[: 150 - 4 * k]) for k in range(1, 9)] + ["p q r s", "p q r s t"] + [f"{x} b c d e f g h i j k l m n o p q r s t" for x in "uv"]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    kinds = list({frozenset(s): s for s in sets}.values())
    want = {k: sum(s != t and 100 * len(s & t) >= 80 * len(s | t) for t in kinds) for k, s in enumerate(sets)}
    got = {r.doc_id: r.n_links for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 3, 80).collect()}
    assert got == want and max(want.values()) > 10


def test_signatures_bound_common_keys():
    rng = np.random.default_rng(3)
    for n in (1, 20, 300, 3000):
        a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in "ab")
        b[: n // 2] = a[: n // 2]
        (x, y), (la, lb) = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        shared = sum(int(i & j).bit_count() for i, j in zip(x.view(np.uint64).tolist(), y.view(np.uint64).tolist()))
        assert shared + min(la, lb) >= len(np.intersect1d(a, b))
