import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns, name
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids), name
        ids = now
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert out.where("round_trip").count() == len(ids)


def test_each_removal_has_its_reason(spark):
    """Brute force of the duplicate and benchmark stages on the small table."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for k, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in rows:
        for b in rows:
            if a < b and min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {find(k) for k in rows}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()}
    assert {k for k, t in rows.items() if any(i in " ".join(t.lower().split()) for i in items)} == set(rows) - clean


def test_nulls_repeats_ties_and_other_columns(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = ". ".join(words(9) for _ in range(7)) + ". "
    item = "Which of the seven rivers named in the second letter flows through the old town of the miller and his brother?"
    base = words(60)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n ", "b"), (4, words(30) + ". " + shared + words(30) + ".", "c"), (5, words(30) + ". " + shared + words(30) + ".", None),
        (6, base, "d"), (6, base, "d"), (7, base + " more", "e"), (None, base, "f"), (None, None, None), (None, shared + words(40), "g"), (8, words(10) + " " + item, "h"), (8, words(20), "i"), (9, words(30_000), "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_sentences string").coalesce(1)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    assert stage["quality"](spark, docs, sf).count() == len(rows)
    once = stage["near_duplicates"](spark, docs, sf)
    assert once.columns == docs.columns and ids(once) == [(False, k) for k in (1, 2, 3, 4, 5, 6, 8, 9)] + [(True, 0)] * 3
    cut = stage["substring_dedup"](spark, docs.withColumnRenamed("n_sentences", "kind"), sf)
    text = {r.doc_id: r.text for r in cut.where("doc_id IS NOT NULL").collect()}
    assert cut.columns == ["doc_id", "text", "kind"] and shared[:200] in text[4] and shared[:200] not in text[5] and text[1] is None and text[3] == " \n "
    assert ids(stage["decontamination"](spark, docs, sf)) == [x for x in ids(docs) if x != (False, 8)]
    out = stage["sentence_pieces"](spark, docs, sf)
    assert out.count() == len(rows) and out.where("NOT round_trip").count() == 0
    for f in stage.values():
        assert f(spark, docs.limit(0), sf).collect() == []
