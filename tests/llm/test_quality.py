import random
import zlib

import numpy as np
import pyarrow as pa

from pitmill.llm.labelled import training_rows
from pitmill.llm.quality import BUCKETS, fit, indicators, keep, score, train


def corpus(n, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(3, 60))]
        bad = k % 4 == 0
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + ".", 0 if bad else 1))
    return rows


def test_indicators_are_distinct_and_local():
    got = indicators(pa.array(["abcabc", "", None, "ab", "xyz abc"]))
    assert got.shape == (5, BUCKETS) and got[1].sum() == got[2].sum() == got[3].sum() == 0
    alone = np.concatenate([indicators(pa.array([t], pa.string())) for t in ["abcabc", "", None, "ab", "xyz abc"]])
    assert (got == alone).all() and got[0].sum() == 3


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(k, t, "held") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = score(docs, train(docs, labels)).toPandas().set_index("doc_id")
    truth = {k: q for k, _, q in rows}
    held = got[got.held_out]
    assert len(held) > 80 and np.mean([truth[k] == p for k, p in held.predicted.items()]) > 0.97
    assert got.score.between(0, 1).all()


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert score(docs.limit(0), fit([], np.empty(0, np.int64))).collect() == []


def brute_buckets(text):
    """N-grams of a text by the definition, one at a time."""
    import re

    from pitmill.llm.common import mix, span_hashes
    from pitmill.llm.quality import _KIND, BYTE_BUCKETS, SHAPE_BUCKETS

    b = (text or "").encode()
    out = {(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 18 for i in range(len(b) - 2)}
    shapes, before = [], None
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", b):
        w = m.group()
        kinds = [int(_KIND[c]) for c in w]
        h = span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        shape = kinds[0]
        for more in (kinds[-1], min(len(w), 15), min(kinds.count(2), 2), min(kinds.count(1), 2), int(h == before)):
            shape = shape * 41 + more
        shapes.append(shape)
        before = h
    for x, y in zip(shapes, shapes[1:]):
        out.add(BYTE_BUCKETS + int(mix(np.array([x * 1_000_003 + y], np.uint64))[0]) % SHAPE_BUCKETS)
    return sorted(out)


def test_score_equals_brute_force(spark):
    rows = corpus(200, seed=9)
    texts = ["", None, "ab", "a b", "A1 A1 zz!", "é ü “x” 12.5%", " \n ", "x " * 3000] + [t for _, t, _ in rows[:30]]
    model = fit([np.array(brute_buckets(t)) for _, t, _ in rows], np.array([q for *_, q in rows]))
    got = {r.doc_id: (r.score, r.predicted) for r in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        margin = sum(float(model.weights[b]) for b in brute_buckets(t)) + model.bias
        want = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -50, 50)))
        assert abs(got[k][0] - want) < 1e-4 and got[k][1] == int(got[k][0] >= 0.3)


def test_training_reaches_the_optimum():
    """Against the hinge-loss optimum by plain subgradient steps on the same scaled indicators."""
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 120)
    rows = [np.unique(np.where(rng.random(12) < 0.65, rng.integers(0, 40, 12) + 40 * y, rng.integers(0, 80, 12))) for y in labels]
    model = fit(rows, labels, rounds=400)
    order = np.random.default_rng(1).permutation(len(rows))
    used = order[len(rows) // 5 :]
    sums = np.ones((2, BUCKETS))
    for k in used:
        sums[labels[k], rows[k]] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    x = np.zeros((len(used), 81))
    for i, k in enumerate(used):
        x[i, rows[k]] = ratio[rows[k]]
        x[i, 80] = 1
    y, share = 2.0 * labels[used] - 1, labels.mean()
    cost = np.where(y > 0, 5 / share, 5 / (1 - share)) / np.mean((x**2).sum(1))
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = best = np.zeros(81)
    for step in range(1, 20001):
        w = w - (w - x.T @ (cost * y * (y * (x @ w) < 1))) / step
        best = min(best, w, key=loss)
    mine = np.append(np.divide(model.weights[:80], ratio[:80], out=np.zeros(80), where=ratio[:80] != 0), model.bias)
    assert loss(mine) <= 1.02 * loss(best)


def test_a_score_equal_to_the_threshold_counts(spark):
    rows = corpus(80)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").coalesce(1)
    model = train(docs, spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in score(docs, model).collect()}
    at = sorted(scores.values())[40]
    want = {k for k, s in scores.items() if s >= at}
    assert {r.doc_id for r in score(docs, model, at).where("predicted = 1").collect()} == want == {r.doc_id for r in keep(docs, model, at).collect()}


def test_of_several_texts_under_one_id_the_smallest_is_learned_from(spark):
    docs = [(1, "b"), (1, "a"), (1, None), (2, None), (3, "c"), (3, "c"), (4, "held out or not")]
    labels = spark.createDataFrame([(k, q) for k in (1, 2, 3) for q in (0, 1)], "doc_id long, quality int")
    for n in (1, 4):
        got = training_rows(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels, "quality", 10)
        rows = {(r.doc_id, r.text, r.label) for r in got.collect()}
        assert rows == {x for x in ((1, "a", 1), (2, None, 1), (3, "c", 1)) if zlib.crc32(str(x[0]).encode()) % 5}
