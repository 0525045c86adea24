"""A corpus from raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, as Parquet read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitmill.llm import decontamination, ngram_jaccard, quality, sentence_pieces, span_dedup
from pitmill.llm.common import staged, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Every row is judged by its text alone: null and empty texts get the bias's score,
    a score equal to the threshold stays, repeated rows share their fate, and without
    labels all stay. Other columns pass through; an empty table gives none.
    """
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) the one with the smallest id stays.

    Null and blank texts are similar to nothing and stay. Of rows that share an id one
    stays, that with the smallest text (null first) and then the smallest other values.
    Rows without an id stay.
    """
    found = staged(ngram_jaccard.near_duplicates(docs, width=5, percent=80).select("doc_id", "component_id"), "groups")
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    again = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *(F.col(f"`{c}`").cast("string") for c in rest)))
    once = once.withColumn("_place", place).where("_place = 1").drop("_place")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences go; so does a document that consisted of nothing else.

    Null texts and texts without words stay as they are. Of rows that share an id one is
    the earlier place; rows without an id come last and are told apart. ``n_chars``,
    where there is such a column, follows the text; other columns pass through, but for
    ``n_sentences`` and ``n_removed``, which are left out.
    """
    cut = span_dedup.dedup_spans(docs.drop("n_sentences", "n_removed"))
    left = cut.where("n_removed = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return left.select([c for c in docs.columns if c in cut.columns and c not in ("n_sentences", "n_removed")])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other parameters, go.

    All rows of a contaminated id go. Rows without an id, null and empty texts stay; an
    empty benchmark removes nothing.
    """
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text as decoded from its ids, their number, and the ids, for every row.

    A null text has null ids and number, an empty one no ids; other columns are not read.
    """
    return sentence_pieces.encode_texts(docs, sentence_pieces.load_pieces(), keep_text=True)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("sentence_pieces", encode),
]

#: Trained models, prefix joins and segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
