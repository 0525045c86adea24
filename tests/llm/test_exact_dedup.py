import hashlib
import random
import re
from collections import Counter

from pitmill.llm.exact_dedup import drop_copies, exact_copies, prefix_table, surviving_prefixes


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def rows():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcÄé .") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    base += ["x" * 300 + c for c in "abcab"]  # equal lengths and prefixes
    out = [(k, rng.choice([str.upper, str, str.title])(rng.choice(base))) for k in range(200)]
    out += [(300, None), (301, ""), (302, None), (303, "ÄB"), (304, "äb"), (305, "long " * 400_000), (306, "LONG " * 400_000)]
    return out + [(400 + k, "hot text") for k in range(500)]  # nearly half of all rows


def brute_force(data):
    groups = {}
    for k, t in data:
        groups.setdefault(lower(t), []).append(k)
    return sorted((k, max(groups[lower(t)]), len(groups[lower(t)]), k == max(groups[lower(t)])) for k, t in data)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows()], "doc_id long, text string, group_size int, digest string").repartition(5)
    got = exact_copies(df, prefix=16, every_digest=True).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute_force(rows())
    text = dict(rows())
    assert all(bytes(r.digest) == hashlib.sha256(lower(text[r.doc_id]).encode()).digest() for r in got)


def test_only_survivors_are_hashed_in_full(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    hashed = {r.doc_id for r in exact_copies(df).collect() if r.digest is not None}
    seen = Counter(lower(t) for _, t in rows())
    again = {k for k, t in rows() if seen[lower(t)] > 1}
    assert again <= hashed and 303 not in hashed and len(hashed) < len(rows())
    narrow = prefix_table(df)
    assert int(sum(bin(b).count("1") for b in surviving_prefixes(narrow))) <= narrow.groupBy("prefix").count().where("count > 1").count()


def test_ids_that_are_null_or_repeated_and_empty_tables(spark):
    data = [(None, "a b"), (7, "A b"), (None, "only"), (None, "ONLY"), (5, "twice"), (5, "twice"), (5, "other"), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_copies(df).collect())
    assert got == sorted([("None", "7", 2, False), ("7", "7", 2, True), ("None", "None", 2, True), ("None", "None", 2, False), ("5", "5", 2, True), ("5", "5", 2, False), ("5", "5", 1, True), ("None", "None", 1, True)])
    left = sorted((str(r.doc_id), lower(r.text)) for r in drop_copies(df).collect())
    assert left == [("5", "other"), ("5", "twice"), ("7", "a b"), ("None", ""), ("None", "only")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_copies(empty).collect() == [] == drop_copies(empty).collect()


def test_copies_go_and_other_columns_stay(spark):
    df = spark.createDataFrame([(k, t, k % 3) for k, t in rows()], "doc_id long, text string, kept int")
    left = drop_copies(df)
    want = {k for k, _, _, kept in brute_force(rows()) if kept}
    got = left.collect()
    assert left.columns == df.columns and {r.doc_id for r in got} == want and len(got) == len(want)
    assert all(r.kept == r.doc_id % 3 for r in got)
