"""URL filtering: longest matching rule, else a logistic regression on hashed character n-grams.

Everything is DataFrame expressions. Few rules are one expression; more are a
table that is joined on the host's suffixes and the path's beginnings. A null URL, or one without ``://``, has an
empty host and path, matches no rule and is judged by the model's bias alone.
Repeated rows give repeated results; an empty table gives none; further columns
of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules of the contract: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Up to so many rules are one expression; more are joined. Both give the same.
RULES_IN_EXPRESSION = 200
#: So many labelled URLs at most are trained on (their inner products are one row); of more, a sample by hash.
MAX_LABELLED = 512

#: Words of unwanted and of ordinary hosts. Fixed values.
UNWANTED = """casino poker slots jackpot roulette bets betting lottery win winner prize bonus adult xxx porn sex cams escort hookup nude pills viagra cialis
pharma steroids loans payday debt cash bitcoin-double spam farm-links ads adserver banner popup track tracker pixel clicks affiliate promo crack keygen warez
torrent serials cheap replica fake free deals farm telemetry""".split()
ORDINARY = """news library garden docs wiki university museum recipes forum weather code journal council health school travel science books music sport art
stories maps help history photo city water forest letters theatre radio market bridge harbour language village kitchen river northern southern weather
mother brother father others leather feather thing things theory method mathematics athletics earth birth depth truth youth months clothes smith thatcher""".split()
#: The most frequent letter pairs of English.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
SECTIONS = ["en", "de", "fr", "es", "item", "about", "archive"]
TAILS = ["", "/", ".html", "?page=2", "?utm_source=feed", "#top"]


def labelled_urls(each: int = 4) -> list[tuple[str, int]]:
    """The small labelled URL table (1: block), by a rule: each unwanted word, alone or with
    another, in ``each`` hosts of several forms, and each ordinary one in half as many.

    Invented names of frequent letter pairs stand for the many ordinary hosts without a known word.
    """
    names = ["".join(PAIRS[(k * 7 + j * (k % 13 + 2)) % len(PAIRS)] for j in range(2 + k % 3)) for k in range(2 * len(UNWANTED))]
    out = []
    for words, label, times in ((UNWANTED, 1, each), (ORDINARY, 0, each // 2), (names, 0, each // 4)):
        for k, word in enumerate(words):
            for j in range(times):
                other = words[(k * 5 + j * 11 + 1) % len(words)]
                host = [f"{word}-{other}", word, f"{other}-{word}"][(j + k) % 3]
                at = k + 2 * j + label
                out.append((f"http{'s' * (at % 2)}://{['', 'www.', 'm.', 'blog.'][at % 4]}{host}.example.{['com', 'net', 'org'][at // 2 % 3]}/{SECTIONS[at % 7]}/{37 * at % 9973}{TAILS[at % 6]}", label))
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. One condition a rule."""
    found: Column | None = None
    for of, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        value = F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add _fit, as from ``match_rule``, to ``urls`` (host, path and others) from a table of any size of rules (of, start, verdict).

    Distinct hosts and paths meet the rules by equal host suffix and equal beginning
    of the path, of the lengths that the suffix's rules have, so no rule meets a URL
    that it does not fit.
    """
    rules = rules.where("of IS NOT NULL AND start IS NOT NULL").select("of", "start", "verdict").distinct()
    lengths = rules.groupBy("of").agg(F.collect_set(F.length("start")).alias("lengths"))
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    pairs = urls.select("host", "path").distinct()
    seen = pairs.withColumn("of", F.explode(suffixes)).join(lengths, "of").withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path"))
    fits = seen.withColumn("start", F.expr("left(path, n)")).join(rules, ["of", "start"])
    order = F.struct(-(F.length("of") + F.length("start")), "of", "start", "verdict")
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("of", "start").alias("rule"), "verdict"), order).alias("_fit"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "_fit")


def ngram_buckets(host: Column, path: Column, n: int, buckets: int) -> Column:
    """Buckets of all character n-grams of ``^host$`` and ``^path$``, the part of the URL being part of the n-gram."""

    def grams(text: Column, part: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), F.substring(framed, i, n)), F.lit(buckets)).cast("int"))

    return F.concat(grams(host, "host"), grams(path, "path"))


def train(labelled: DataFrame, n: int = 3, buckets: int = 4096, rounds: int = 100, rate: float = 2.0, decay: float = 1e-4, momentum: float = 0.9, limit: int = MAX_LABELLED) -> tuple[list[float], float]:
    """Weights per bucket and the bias of a logistic regression on a small table (url, label).

    Gradient descent with momentum runs in its dual form: each labelled URL has a coefficient,
    and a step needs only the matrix of inner products of the labelled URLs,
    which a join on the buckets gives. At most ``limit`` URLs are taken, so that
    matrix and the ``buckets`` weights have a fixed bound.
    """
    rows = labelled.select("url", F.col("label").cast("double").alias("y")).distinct().orderBy(F.xxhash64("url", "y"), "url", "y").limit(limit)
    size = rows.count()
    if not size:
        return [0.0] * buckets, 0.0
    rows = rows.withColumn("i", F.xxhash64("url", "y"))
    grams = rows.select("i", "y", F.explode(ngram_buckets(url_host(F.col("url")), url_path(F.col("url")), n, buckets)).alias("b"))
    norms = grams.groupBy("i").agg(F.sqrt(F.count("*")).alias("norm"))
    x = grams.groupBy("i", "y", "b").count().join(norms, "i").select("i", "y", "b", (F.col("count") / F.col("norm")).alias("v"))
    x = x.union(rows.select("i", "y", F.lit(buckets), F.lit(1.0)))  # the bias: a bucket that all share, so that every pair has a product
    other = x.select(F.col("i").alias("j"), "b", F.col("v").alias("u"))
    products = x.join(other, "b").groupBy("i", "y", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    lines = products.groupBy("i", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda e: e["k"]).alias("line"))
    one = lines.agg(F.array_sort(F.collect_list(F.struct("i", "y", "line"))).alias("m"))
    solved = one.select(
        "m",
        F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)),
            F.transform("m", lambda e: F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("v"))),
            lambda a, _: F.transform(
                F.transform(
                    F.zip_with("m", a, lambda e, c: F.struct(e["y"].alias("y"), c.alias("c"), F.aggregate(F.zip_with(e["line"], a, lambda k, w: k * w["c"]), F.lit(0.0), lambda s, z: s + z).alias("f"))),
                    lambda e: F.struct(e["c"]["c"].alias("c"), (momentum * e["c"]["v"] - decay * rate * e["c"]["c"] + (rate / size) * (e["y"] - 1 / (1 + F.exp(-e["f"])))).alias("v")),
                ),
                lambda e: F.struct((e["c"] + e["v"]).alias("c"), e["v"].alias("v")),
            ),
        ).alias("a"),
    )
    alpha = solved.select(F.explode(F.zip_with("m", "a", lambda e, c: F.struct(e["i"].alias("i"), c["c"].alias("c")))).alias("e")).select("e.i", "e.c")
    weights = [0.0] * (buckets + 1)
    for row in x.join(alpha, "i").groupBy("b").agg(F.sum(F.col("v") * F.col("c")).alias("w")).collect():  # one row a bucket at most
        weights[row["b"]] = row["w"]
    return weights[:-1], weights[-1]


def judge(urls: DataFrame, model: tuple[list[float], float], rules: Sequence[tuple[str, str, str]] = tuple(RULES), n: int = 3, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and block_score (the model's probability of "block") to ``urls``.

    Input columns with one of these names are replaced.
    """
    weights, bias = model
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # a constant, folded once
    out = urls.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    grams = ngram_buckets(F.col("host"), F.col("path"), n, len(weights))
    score = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(w, b)) / F.sqrt(F.size(grams)) + bias
    out = out.withColumn("block_score", 1 / (1 + F.exp(-score)))
    if len(rules) <= RULES_IN_EXPRESSION:
        out = out.withColumn("_fit", match_rule(F.col("host"), F.col("path"), rules))
    else:
        out = join_rules(out, urls.sparkSession.createDataFrame(rules, "of string, start string, verdict string"))
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return out.withColumn("rule", F.col("_fit.rule")).withColumn("verdict", F.coalesce("_fit.verdict", method)).drop("_fit")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.createDataFrame(labelled_urls(), "url string, label int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "block_score")
