"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    collocations,
    decontamination,
    exact_dedup,
    filter_audit,
    log_bilinear,
    mpeg_audio,
    ngram_jaccard,
    quality,
    sentence_pieces,
    span_dedup,
    toxicity,
    url_filter,
    warc_bundles,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_mpeg_audio": mpeg_audio.op3_mpeg_audio,
    "op4_span_dedup": span_dedup.op4_span_dedup,
    "op5_sentence_pieces": sentence_pieces.op5_sentence_pieces,
    "op6_warc_bundles": warc_bundles.op6_warc_bundles,
    "op9_quality_nbsvm": quality.op9_quality_nbsvm,
    "op10_toxicity": toxicity.op10_toxicity,
    "op8_log_bilinear": log_bilinear.op8_log_bilinear,
    "op7_url_filter": url_filter.op7_url_filter,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL: dict[str, str] = warc_bundles.ORACLE | exact_dedup.ORACLE | collocations.ORACLE | filter_audit.ORACLE
