import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pitmill.llm.log_bilinear import TAILS, contexts_of, count_tokens, frequent, score, score_texts, start_model, token_scores, tokens, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = []
        while len(words) < rng.randint(0, 80):
            words += rng.choice([["The", "cat", "sat"], ["a", "dog", "ran"], ["x%d" % rng.randrange(300)], ["it", "is"]])
        rows.append((k, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "cat " * 30_000)]


def test_base_score_and_counts(spark):
    rows = corpus()
    split = {k: [*WORD.findall((t or "").lower()), None] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in split}
    c = Counter(w for k, ws in split.items() if not held[k] for w in ws)
    total, distinct = sum(c.values()), len(c)
    df = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in score_texts(df).collect()}
    assert got.keys() == split.keys()
    for k, ws in split.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(w in c for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
    aside = [got[k] for k in got if held[k]]
    assert sum(r.score for r in aside) > sum(r.base_score for r in aside)


def test_scores_are_normalised():
    rng = np.random.default_rng(1)
    model = start_model(np.full(8, 1 / 8), np.full(10, 1 / 10))
    first = np.array([0, 0, 0, 0, 0, 0, 0, 3, 10])  # classes 6 and 7 are groups of 3 and 7 tokens
    label = np.array([0, 1, 2, 3, 4, 5, 6, 6, 6, *[7] * 7])
    member = np.array([-1] * 6 + list(range(10)))
    contexts = np.repeat(rng.integers(0, 9, (5, 2)), 16, axis=0)
    got = token_scores(model, contexts, np.tile(label, 5), np.tile(member, 5), first)
    assert np.allclose(np.exp(got).reshape(5, 16).sum(1), 1, atol=1e-5)
    assert contexts_of(np.array([4, 5, 6, 7]), np.array([3, 1]), 12).tolist() == [[12, 12], [4, 12], [5, 4], [12, 12]]


def test_score_equals_brute_force(spark):
    """The probability of every token by the definition, one at a time."""
    rows = corpus(120, seed=9)[:-1] + [(500, "cat " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = count_tokens(docs).persist()
    head = frequent(counted, limit=70, singles=4, groups=3, modelled_count=4)
    model = train(docs, head)
    assert len(head.token) < counted.count() and len(head.share) > 6 and (head.label < TAILS).any()
    got = {r.doc_id: r.score for r in score(docs, head, counted, model).collect()}
    n = {r.token: r.n for r in counted.collect()}
    place = {int(t): k for k, t in enumerate(head.token)}
    own = {int(t.view(np.int64)) for t, k in zip(head.token, head.label) if k >= TAILS}
    ending = {r.token: r.tail for r in counted.collect()}
    rare = [1 + sum(c + 1 for t, c in n.items() if ending[t] == k and t not in own) for k in range(TAILS)]
    total = 0.0
    for key, text in rows:
        found, _, tail = tokens(pa.array([text], pa.string()))
        classes = [int(head.label[place[int(t)]]) if int(t) in place else int(k) for t, k in zip(found, tail)]
        log = 0.0
        for at, (t, c) in enumerate(zip(found, classes)):
            q = sum(model.context[classes[at - 1 - j] if at > j else len(head.noise)] @ model.matrices[j] for j in range(2))
            e = np.exp(model.target @ q + model.bias)
            log += math.log10(e[c] / e.sum())
            if c < TAILS:
                log += math.log10((n.get(int(t.view(np.int64)), 0) + 1) / rare[c])
            elif c >= TAILS + 4:
                a, b = head.first[c], head.first[c + 1]
                e = np.exp(model.word[a:b] @ q + model.word_bias[a:b])
                log += math.log10(e[head.member[place[int(t)]] - a] / e.sum())
        assert math.isclose(got[key], log, rel_tol=1e-4, abs_tol=1e-4)


def test_tokens_and_empty_tables(spark):
    found, n, tail = tokens(pa.array(["A b", None, "a  B"]))
    assert (tail[:2] == tail[4:6]).all() and (tail < TAILS).all()
    assert n.tolist() == [3, 1, 3] and (found[:3] == found[4:]).all()
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = score_texts(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert len(only) == 2 and not only[0].held_out and only[0].n_known == 3


def test_rows_that_share_an_id_keep_their_own_tail(spark):
    docs = spark.createDataFrame([(1, "a b b c d"), (1, "c d e"), (None, "e f"), (None, "a a a g h")], "doc_id long, text string")
    counts = count_tokens(docs).persist()
    n = Counter(w for r in docs.collect() for w in [*r.text.split(), None])
    head = frequent(counts, limit=2, singles=1)
    assert 0 < len(head.token) < len(n)
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in score(docs, head, counts, start_model(head.noise, head.share)).collect())
    split = [[*r.text.split(), None] for r in docs.collect()]
    assert got == sorted((len(ws), len(ws), round(sum(math.log10((n[w] + 1) / (sum(n.values()) + len(n) + 1)) for w in ws), 6)) for ws in split)


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    from pitmill.llm import log_bilinear

    monkeypatch.setattr(log_bilinear, "SHARD_TOKENS", 700)
    docs = spark.createDataFrame(corpus(300, seed=4)[:-1], "doc_id long, text string")
    one, eight = ({r.doc_id: r.score for r in score_texts(docs.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and all(math.isclose(one[k], eight[k], rel_tol=1e-6, abs_tol=1e-6) for k in one)
