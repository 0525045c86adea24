"""Training rows of the classifiers: bounded, held-out rows left aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32(key as text) mod 5 is 0; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents that are not held out, the same ones for the same tables.

    A document with several labels has the largest, an id with several texts the smallest of these (null only if it has no other). The sample has at most
    ``limit`` ids, so it is broadcast to the scan of the texts.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
