"""Removal of repeated runs of sentences.

A sentence ends at a word that ends in ``.``, ``!`` or ``?`` (a closing quote or
bracket may follow) or at a line break; it stays whole whatever its length. Each reaches to the next one's first word, so that the sentences of a
text, joined, give the text. Every run of ``RUN`` consecutive sentences is hashed
over its lower-cased words and joined globally, however short they are, and so is
every run of ``PAIR`` that has ``MIN_WORDS`` words. The first place
of a run is in the document with the smallest id, and there the earliest; the
sentences that any other place covers are removed.

Only a stretch of more than ``MAX_WORDS`` words without any end is no sentence. It is cut
into pieces after words that their hash chooses, so that an insertion moves no
later cut. Runs of pieces have at least ``RUN`` of them and ``MIN_WORDS`` words; no run
has pieces and sentences.

Within a document all but the first place of a run is known at once, so one row
a run and document enters the shuffle; a run that a third of all documents hold
costs one minimum, combined before the shuffle, and a join that splits.

A null text stays null, and one without words stays as it is. Of rows that share an
id, one is the earlier place and the others are later ones, in the order of the
input. Rows without an id are
documents of their own, which come after all others in the order of the input.
Other columns pass through unchanged; an input column named
``n_sentences`` or ``n_removed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _powers, drop_staged, ints, lower_ascii, mix, slices, span_hashes, staged, table, text_bytes, word_spans

RUN, PAIR, MIN_WORDS, MAX_WORDS = 3, 2, 12, 100
#: In a stretch without an end, about one word in so many ends a piece, and no piece has more words than this.
CUT, PIECE_WORDS = 3, 32
_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_CLOSE = np.isin(np.arange(256), [ord(c) for c in "\"')]"])
_BREAK = np.isin(np.arange(256), [10, 11, 12, 13])


def sentences(raw: np.ndarray, offsets: np.ndarray, max_words: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all sentences of a slice: byte start, hash, number of words, whether it is a piece; and for each text the index of its first sentence (n + 1)."""
    starts, ends, first = word_spans(raw, offsets)
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool), np.zeros(len(offsets), np.int64)
    words = span_hashes(lower_ascii(raw), starts, ends)
    last, before = raw[ends - 1], raw[np.maximum(ends - 2, starts)]
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_BREAK[raw], out=breaks[1:])
    gap = np.append(breaks[starts[1:]] - breaks[ends[:-1]] > 0, True)
    over = _END[last] | _CLOSE[last] & _END[before] | gap
    opens = np.append(True, over[:-1])
    opens[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(opens)
    size = np.diff(np.append(at, n))
    chosen = np.append(False, words[:-1] % np.uint64(CUT) == 0)
    opens[at] = True
    long = np.repeat(size > max_words, size)
    at = np.flatnonzero(opens | chosen & long)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero((place == 0) | long & (place % PIECE_WORDS == 0))
    stop = np.append(at[1:], n)
    power, inverse = _powers(max(n, 1 << 20) + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=sums[1:])
    return starts[at], mix((sums[stop] - sums[at]) * inverse[at] + (stop - at).astype(np.uint64)), stop - at, long[at], np.searchsorted(at, first)


def runs(hashes: np.ndarray, words: np.ndarray, piece: np.ndarray, first: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs within the texts of a slice: sentence at which one begins, index after its last, hash; and for each text the index of its first run (n + 1)."""
    n = len(hashes)
    total, pieces = np.append(0, np.cumsum(words)), np.append(0, np.cumsum(piece))
    begin = np.arange(n)
    enough = np.searchsorted(total, total[:-1] + min_words)  # where a run has the words
    found = []
    for end, kind in ((begin + run, False), (np.where(enough <= begin + PAIR, begin + PAIR, n + 1), False), (np.maximum(begin + run, enough), True)):
        inside = np.minimum(end, n)
        among = pieces[inside] - pieces[:-1]
        good = (end <= n) & (among == (end - begin if kind else 0))
        found.append((begin[good], end[good]))
    if run == PAIR:
        del found[1]
    begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(first, begin, side="right") - 1
    inside = end <= first[text + 1]
    begin, end, text = begin[inside], end[inside], text[inside]
    order = np.argsort(begin, kind="stable")
    begin, end, text = begin[order], end[order], text[order]
    power, inverse = _powers(max(n, 1 << 20) + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return begin, end, mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)), np.searchsorted(text, np.arange(len(first)))


PLACE = ["_no_id", "_id", "_row"]


def run_table(docs: DataFrame, run: int, min_words: int, max_words: int) -> DataFrame:
    """(run, and the place of its row): the runs of each row of ``docs``, each run once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, hashes, words, piece, first = sentences(*text_bytes(part.column(3)), max_words)
                _, _, h, of = runs(hashes, words, piece, first, run, min_words)
                found = [np.unique(h[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([ints(np.concatenate(found), pa.int64()), *(part.column(c).take(at) for c in range(3))], ["run", *PLACE])

    return docs.select(*PLACE, "text").mapInArrow(work, "run long, _no_id boolean, _id long, _row long")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row: whether it has no id, the id (null: 0), and the number of the row where others share its id.

    Only rows without an id and rows of repeated ids are staged, so that their numbers stay the same.
    """
    given = F.col("doc_id").cast("long")
    numbered = lambda df: df.withColumn("_no_id", given.isNull()).withColumn("_id", F.coalesce(given, F.lit(0)).cast("long"))
    zero = F.lit(0).cast("long")
    again = staged(docs.where(given.isNotNull()).groupBy(given.alias("_again")).count().where("count > 1").select("_again"), "repeated_ids")
    none = docs.where(given.isNull())
    once, rest = docs.where(given.isNotNull()), none
    if not again.isEmpty():
        rest = none.unionByName(once.join(again, given == F.col("_again"), "left_semi"))
        once = once.join(again, given == F.col("_again"), "left_anti")
    rest = staged(numbered(rest).withColumn("_row", F.monotonically_increasing_id()), "shared_ids")
    return numbered(once).withColumn("_row", zero).unionByName(rest)


def dedup_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, and n_sentences and n_removed."""
    docs = docs.drop("n_sentences", "n_removed")
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    docs = identified(docs)
    listed = staged(run_table(docs, run, min_words, max_words), "runs")
    place = F.struct(*PLACE)
    firsts = listed.groupBy("run").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = listed.join(firsts, "run").where(place > F.col("_first"))
    cut = staged(later.groupBy(*PLACE).agg(F.collect_set("run").alias("_cut")), "cuts")
    drop_staged(listed)
    joined = docs.join(cut, PLACE, "left")
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(at))
                starts, hashes, words, piece, first = sentences(raw, offsets, max_words)
                begin, end, h, of = runs(hashes, words, piece, first, run, min_words)
                texts, cuts = part.column(at).to_pylist(), part.column(len(names))
                removed = np.zeros(len(texts), np.int32)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    mine = slice(of[k], of[k + 1])
                    own = h[mine]
                    _, pos, which = np.unique(own, return_index=True, return_inverse=True)
                    again = pos[which] != np.arange(len(own))
                    if cuts[k].is_valid:
                        again |= np.isin(own, cuts[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    if not again.any():
                        continue
                    change = np.zeros(b - a + 1, np.int64)
                    np.add.at(change, begin[mine][again] - a, 1)
                    np.add.at(change, end[mine][again] - a, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.append(starts[a:b], offsets[k + 1])
                    edges[0] = offsets[k]
                    data = raw[offsets[k] : offsets[k + 1]].tobytes()
                    keep = np.flatnonzero(~gone)
                    texts[k] = b"".join(data[edges[s] - offsets[k] : edges[s + 1] - offsets[k]] for s in keep).decode("utf-8")
                    removed[k] = int(gone.sum())
                columns = [part.column(c) if c != at else pa.array(texts, part.column(at).type) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first).astype(np.int32)), pa.array(removed)], [*names, "n_sentences", "n_removed"])

    return joined.select(*(joined[f"`{c}`"] for c in names), "_cut").mapInArrow(work, schema)


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
