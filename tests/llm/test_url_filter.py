import math

from pitmill.llm.url_filter import RULES, judge, labelled_urls, train

LABELLED_URLS = labelled_urls()
URLS = [
    (1, "http://a.example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://Example.ORG/en/19.html", "example.org", "/en/19.html", "example.org/en/1", "block"),
    (3, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (4, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (5, "ftp://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    (6, "http://x.com/fr", "x.com", "/fr", None, None),
    (7, "http://x.org", "x.org", "", None, None),
    (8, "http://x.org?a=/b", "x.org", "", None, None),
    (9, None, "", "", None, None),
    (10, "no scheme", "", "", None, None),
    (11, "", "", "", None, None),
    (12, "a://b://c", "b:", "//c", None, None),
    (12, "http://x.org/" + "p" * 20000, "x.org", "/" + "p" * 20000, "org/", "allow"),
]


def test_contract(spark):
    model = train(spark.createDataFrame(LABELLED_URLS, "url string, label int"))
    df = spark.createDataFrame([(k, u, "extra", 1) for k, u, *_ in URLS], "page_id long, url string, host string, rule int")
    got = judge(df, model, RULES).collect()
    assert len(got) == len(URLS)
    for want in URLS:
        r = next(r for r in got if r.page_id == want[0] and r.url == want[1])
        assert (r.host, r.path, r.rule) == want[2:5]
        assert r.verdict == (want[5] or ("block" if r.block_score >= 0.5 else "allow"))
    assert judge(df.limit(0), model).collect() == []


def test_training_separates_and_equals_plain_descent(spark):
    rows = spark.createDataFrame(LABELLED_URLS, "url string, label int")
    model = train(rows)
    got = {r.url: r.block_score for r in judge(rows, model, []).collect()}
    assert sum((got[u] >= 0.5) == bool(y) for u, y in LABELLED_URLS) >= 0.95 * len(LABELLED_URLS)
    few = LABELLED_URLS[:2] + LABELLED_URLS[-2:]
    weights, bias = train(spark.createDataFrame(few, "url string, label int"), rounds=20, rate=2.0, decay=0.0, momentum=0.0)
    # the same by descent on the weights themselves
    from pitmill.llm.url_filter import ngram_buckets, url_host, url_path
    from pyspark.sql import functions as F

    x = {r.url: r.b for r in spark.createDataFrame(few, "url string, label int").select("url", ngram_buckets(url_host(F.col("url")), url_path(F.col("url")), 3, 4096).alias("b")).collect()}
    w, c = [0.0] * 4096, 0.0
    for _ in range(20):
        steps = []
        for u, y in few:
            f = sum(w[b] for b in x[u]) / math.sqrt(len(x[u])) + c
            steps.append((u, 2.0 / len(few) * (y - 1 / (1 + math.exp(-f)))))
        for u, s in steps:
            c += s
            for b in x[u]:
                w[b] += s / math.sqrt(len(x[u]))
    assert math.isclose(bias, c, abs_tol=1e-9) and max(abs(a - b) for a, b in zip(weights, w)) < 1e-9


def test_no_labels(spark):
    assert train(spark.createDataFrame([], "url string, label int"))[1] == 0.0


def test_held_out_recall(spark):
    rows = lambda part: spark.createDataFrame(part, "url string, label int")
    model = train(rows([x for k, x in enumerate(LABELLED_URLS) if k % 5]))
    got = judge(rows([x for k, x in enumerate(LABELLED_URLS) if not k % 5]), model, []).collect()
    assert sum(r.verdict == "block" for r in got if r.label) >= 0.9 * sum(r.label for r in got)
    assert sum(r.verdict == "block" for r in got if not r.label) <= 0.05 * len(got)


def test_many_rules_are_joined_with_the_same_result(spark):
    rules = [*RULES, ("", "/", "block"), ("x.com", "", "block")] + [(f"h{k}.example.net", f"/{k % 7}", "allow" if k % 2 else "block") for k in range(400)]
    urls = [(k, u) for k, u, *_ in URLS] + [(100 + k, f"http://{'www.' * (k % 3)}h{k}.example.net/{k % (7 + k % 2)}/x") for k in range(60)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    model = [0.0] * 8, -1.0
    few = {}
    for r in [r for at in range(0, len(rules), 150) for r in judge(df, model, rules[at : at + 150]).where("rule IS NOT NULL").collect()]:
        few[r.page_id, r.url] = max(few.get((r.page_id, r.url), ("", "")), (r.rule, r.verdict), key=lambda x: len(x[0]))
    got = {(r.page_id, r.url): (r.rule, r.verdict) for r in judge(df, model, rules).where("rule IS NOT NULL").collect()}
    assert got == few and len(got) > 30 and judge(df, model, rules).count() == len(urls)
    assert judge(df.limit(0), model, rules).collect() == []
