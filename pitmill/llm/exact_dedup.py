"""Exact copies by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after A-Z is lower-cased; a null text is an
empty one. One scan gives the byte length and a hash of the first ``PREFIX_BYTES``
bytes of each text, a narrow table. Rows whose length occurs once drop out by a
bitmap of lengths, and of the others those whose length and prefix occur once by a
second bitmap. Only for what survives both does the second scan hash the full text
(SHA-256), and only those rows are grouped. Bitmaps have a fixed size; a full one
lets more rows through to the full hash and changes no result.

Counts and the row that stays are combined before the shuffle. Groups that hold
more than a 1024th of all rows are broadcast back to their rows, so no task gets
all copies of one text.

Of equal texts the row with the largest ``doc_id`` stays; a row without an id stays
only where no copy has one. Of rows that share id and text one stays: they are the
same document twice, so which of them it is makes no difference. An empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, bitmap_has, drop_staged, ints, join_groups, lower_ascii, mix, slices, span_hashes, staged, table, text_bytes

PREFIX_BYTES = 256
LENGTH_BITS, PREFIX_BITS = 20, 24


def _prefixes(raw: np.ndarray, offsets: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths of a slice's texts, and hashes of length and first bytes."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    head = span_hashes(raw, starts, np.minimum(starts + prefix, offsets[1:]))
    return sizes, mix(head + sizes.astype(np.uint64))


def _place(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - PREFIX_BITS)


def prefix_table(docs: DataFrame, prefix: int = PREFIX_BYTES) -> DataFrame:
    """(length, prefix) of every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(0))
                sizes, heads = _prefixes(lower_ascii(raw), offsets, prefix)
                yield pa.RecordBatch.from_arrays([ints(sizes, pa.int64()), ints(heads, pa.int64())], ["length", "prefix"])

    return docs.select("text").mapInArrow(work, "length long, prefix long")


def surviving_prefixes(narrow: DataFrame) -> np.ndarray:
    """The bitmap of the prefix hashes that occur more than once, among rows whose length does."""
    spark = narrow.sparkSession
    again = narrow.groupBy("length").count().where("count > 1")
    lengths = spark.sparkContext.broadcast(bitmap(again, F.pmod("length", F.lit(1 << LENGTH_BITS)), LENGTH_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << LENGTH_BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(bitmap_has(lengths.value, place)))], ["prefix"])

    alike = narrow.mapInArrow(work, "prefix long").groupBy("prefix").count().where("count > 1")
    return bitmap(alike, F.shiftrightunsigned("prefix", 64 - PREFIX_BITS), PREFIX_BITS)


def full_hashes(docs: DataFrame, survivors: np.ndarray, prefix: int = PREFIX_BYTES, every: bool = False) -> DataFrame:
    """(doc_id, row, candidate, digest): the full hash of rows that survived; with ``every`` also of the others, which stay no candidates."""
    known = docs.sparkSession.sparkContext.broadcast(survivors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(1))
                raw = lower_ascii(raw)
                alike = bitmap_has(known.value, _place(_prefixes(raw, offsets, prefix)[1]))
                view = memoryview(raw)
                digests = [hashlib.sha256(view[a:b]).digest() if every or c else None for a, b, c in zip(offsets[:-1].tolist(), offsets[1:].tolist(), alike.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(alike), pa.array(digests, pa.binary())], ["doc_id", "row", "candidate", "digest"])

    schema = T.StructType([docs.schema["doc_id"]]).add("row", "long").add("candidate", "boolean").add("digest", "binary")
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(work, schema)


def exact_copies(docs: DataFrame, prefix: int = PREFIX_BYTES, every_digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of ``docs`` (doc_id, text); the digest is null where no full hash was needed."""
    narrow = staged(prefix_table(docs, prefix), "prefixes")
    survivors = surviving_prefixes(narrow)
    drop_staged(narrow)
    rows = staged(full_hashes(docs, survivors, prefix, every_digest), "digests")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")
    groups = rows.where("candidate").groupBy("digest").agg(F.max(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = staged(groups.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "groups")
    alone = rows.where("NOT candidate").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    joined = join_groups(rows.where("candidate").drop("candidate"), groups, "digest", "group_size", rows.count())
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    ).unionByName(alone)


def drop_copies(docs: DataFrame, prefix: int = PREFIX_BYTES) -> DataFrame:
    """``docs`` without the copies, all columns as they were; of rows that share id and text any one stays.

    What has no copies meets nothing in the join and passes.
    """
    found = staged(exact_copies(docs, prefix), "copies")
    state = found.where("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("kept").alias("_kept"))
    digest = F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    marked = docs.withColumn("_key", digest).join(state, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")), "left")
    whole = marked.where("_digest IS NULL").select(docs.columns)
    twice = marked.where("_kept").dropDuplicates(["_id", "_digest"]).select(docs.columns)
    return whole.unionByName(twice)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(table(spark, sf_dir, "documents"), every_digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = {
    "op11_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
