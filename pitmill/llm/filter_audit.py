"""Interaction audit of quality filters by contingency tensors.

Each document fails or passes five filters (``FILTERS``); a part's documents make a
2x2x2x2x2 tensor of counts, with one layer for all documents, one for good and one
for toxic ones. What any order of the filters keeps and removes is a contraction of
that tensor: along each axis a step takes passes, failures or both. Spark counts the
cells, at most 32 a part; numpy contracts them, part by part.

Filter E fails a text that is identical to that of a smaller ``doc_id``. It is known
without bringing copies together: counts by (digest) give the smallest id of each
text, and hot texts are broadcast back to their rows.

A null text is an empty one; a null source is the part ''. Rows without an id never
fail E, and no row fails E because of them; rows that share id and text fail it
together or not at all. A document is good (toxic) if any of its ``labels`` rows says 1; null labels say
nothing. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, staged, table

FILTERS = "ABCDE"
MEASURES = ["n", "good", "toxic"]
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails filters A to D."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): counts of the documents that fail just those filters."""
    flags = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        *(c.cast("int").alias(k) for k, c in failures(F.col("text")).items()),
    )
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    # rows without an id have no labels and would meet in one task
    rows = flags.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").unionByName(flags.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    rows = staged(rows.fillna(0, ["good", "toxic"]), "flags")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    rows = join_groups(rows, staged(firsts, "firsts"), "digest", "copies", rows.count())
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    sums = [F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")]
    return rows.withColumn("E", later).groupBy("part", *FILTERS).agg(*sums)


def selectors() -> dict[str, np.ndarray]:
    """For every order and step, and each filter's axis, the weights of pass and fail: shape (600, 5, 2)."""
    both, passes, fails = (1, 1), (1, 0), (0, 1)
    rows: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique": []}
    for order in ORDERS:
        for step, letter in enumerate(order):
            before = order[:step]
            rows["kept"].append([passes if f in before or f == letter else both for f in FILTERS])
            rows["removed"].append([fails if f == letter else passes if f in before else both for f in FILTERS])
            rows["failing"].append([fails if f == letter else both for f in FILTERS])
            rows["unique"].append([fails if f == letter else passes for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def audit_part(counts: pd.DataFrame) -> pd.DataFrame:
    """The audit of one part from its cells, at most 32 rows."""
    tensor = np.zeros((len(MEASURES), *[2] * len(FILTERS)), np.int64)
    at = tuple(counts[f].to_numpy() for f in FILTERS)
    for k, measure in enumerate(MEASURES):
        np.add.at(tensor[k], at, counts[measure].to_numpy())
    chosen = {name: np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensor, *np.moveaxis(w, 1, 0)) for name, w in selectors().items()}
    n, good, toxic = range(len(MEASURES))
    removed = chosen["removed"]
    letters = np.array([f for order in ORDERS for f in order])
    shapley = {f: int(removed[n][letters == f].sum()) for f in FILTERS}
    return pd.DataFrame(
        {
            "part": counts["part"].iloc[0],
            "filter_order": np.repeat(ORDERS, len(FILTERS)),
            "step": np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)),
            "kept": chosen["kept"][n],
            "removed": removed[n],
            "redundant": chosen["failing"][n] - removed[n],
            "unique_fails": chosen["unique"][n],
            "good_lost": removed[good],
            "toxic_lost": removed[toxic],
            "shapley": [shapley[f] for f in letters],
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return cells(docs, labels).groupBy("part").applyInPandas(audit_part, schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = {
    "op13_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN m USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
placed AS (
  SELECT filter_order, cells.*,
         coalesce(list_min(list_transform(string_split(fails, ''), lambda x: instr(filter_order, x))), 9) AS place FROM orders, (SELECT * FROM cells WHERE fails <> '') cells
  UNION ALL SELECT filter_order, cells.*, 9 FROM orders, cells WHERE fails = ''),
steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
o AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x,
         sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN place < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM o"""
}
