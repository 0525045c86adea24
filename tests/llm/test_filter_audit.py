import random
import re
from itertools import permutations

from pitmill.llm.filter_audit import FILTERS, audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    out = []
    for key, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        bad = set()
        bad |= {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if key is not None and any(k is not None and k < key and (u or "") == t for k, u, _ in rows) else set()
        out.append(bad)
    return out


def brute_force(rows, good, toxic):
    """Every order walked document by document."""
    bad = fails(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(k, b) for (k, _, s), b in zip(rows, bad) if (s or "") == part]
        shapley = dict.fromkeys(FILTERS, 0)
        for order in map("".join, permutations(FILTERS)):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = sum(f in b for _, b in mine)
                shapley[f] += len(gone)
                out[part, order, step] = [len(stay), len(gone), failing - len(gone), sum(b == {f} for _, b in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone), f]
                left = stay
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    rng = random.Random(8)
    rows = []
    for k in range(120):
        n = rng.choice([3, 199, 200, 260])
        vocabulary = [f"w{i}é" for i in range(rng.choice([50, 100, 400]))]
        words = [rng.choice(vocabulary) for _ in range(n)]
        words[0] = rng.choice(["#", "A" * 40, "plain", "x|y"])
        rows.append((k, rng.choice([" ", "\n\t", "  "]).join(words), rng.choice(["a", "b", None, ""])))
    rows += [(200 + k, rows[k % 7][1], "a" if k % 2 else "c") for k in range(60)]  # copies in several parts
    rows += [(5, rows[5][1], "c"), (300, None, "a"), (301, "", None), (None, rows[3][1], "a"), (None, rows[3][1], "z"), (302, "word " * 50_000, "a")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    labels = [(k, k % 2, int(k % 5 == 0)) for k, _, _ in rows if k is not None and k % 3] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9, None, None)]
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, good int, part string").repartition(4)
    got = audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_force(rows, good, toxic)
    assert len(got) == len(want) == 600 * 5
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).collect() == []
    one = audit(spark.createDataFrame([(1, "a", None)], docs.schema), labels).collect()
    assert len(one) == 600 and all(r.part == "" and r.good_lost == r.toxic_lost == 0 for r in one)
    assert all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)
