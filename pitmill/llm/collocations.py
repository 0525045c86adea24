"""Phrase collocations, counted by a multikey quicksort of suffix pointers.

A text is split into pieces at punctuation and line breaks, and these into words.
Every word begins a suffix of its piece, cut to ``MAX_WORDS`` words. Suffixes are
routed by language and first two words into buckets of bounded size, so that one bucket has all that share
them; there pointers to them are sorted by a three-way multikey
quicksort over word numbers. A partition equal in its first k words is a phrase and its
size the count; partitions smaller than the least count are abandoned unsorted. Pairs of words that
begin more than a 1024th of all suffixes are hot: their suffixes are routed by three words, and the
sizes of their two-word partitions are partial and summed afterwards.

Only what can be in a frequent phrase is routed: a scan before counts words exactly
and pairs of words in a sketch of fixed size (an upper bound),
and a suffix ends before its first infrequent pair. At a size that fills the sketch, more
suffixes are routed, and the results are the same. A task combines equal suffixes, so copies of
a passage cost one line a task, and ships those of one bucket as one compressed block.

Candidates are phrases of two or more words with at least ``least`` occurrences. A
candidate's score is the lowest of its cuts' scores, as an integer of exact decimal
arithmetic. As every part of a phrase occurs at least as often, all counts that
scores need are among the frequent phrases. A candidate inside a longer one that
occurs as often is dropped; the phrases in between occur as often too, so looking
one word further is enough.

A null text is an empty one, a null language ``und``. Repeated rows and rows that
share an id count each. Ties are ordered by the contract's last key, the phrase. An
empty table, and a language without candidates, give no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, bitmap_has, drop_staged, join_groups, lower_ascii, mix, slices, span_hashes, staged, table, text_bytes, word_spans

MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Bytes of text at once, distinct suffixes that a task combines, words for each bucket and least number of buckets.
SLICE, COMBINED, BUCKET_WORDS, BUCKETS = 4_000_000, 1_000_000, 100_000, 1024
PAIR_BITS, CHUNK = 23, 1 << 15
#: Leading columns (language, two words) of partitions that other buckets share where a pair is hot.
SHARED = 3
SALTS = 64
_BREAK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\v\f\r"])
_WORD = ~_BREAK & ~np.isin(np.arange(256), [32, 9])


class Words:
    """The words of a slice of texts (columns lang, text), each followed by one blank in ``data``."""

    def __init__(self, part: pa.RecordBatch):
        raw, offsets = text_bytes(part.column(1))
        raw = lower_ascii(raw)
        starts, ends, first = word_spans(raw, offsets, _WORD[raw])
        self.n = len(starts)
        size = ends - starts + 1
        #: Byte starts in ``data`` (n + 1).
        self.at = np.append(0, np.cumsum(size))
        index = np.repeat(starts - self.at[:-1], size) + np.arange(self.at[-1])
        self.data = raw[np.minimum(index, max(0, len(raw) - 1))]
        self.data[self.at[1:] - 1] = 32
        langs = pc.fill_null(part.column(0), "und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(), np.diff(first)).astype(np.int32)
        breaks = np.append(0, np.cumsum(_BREAK[raw]))
        #: Whether the next word is in the same piece.
        self.joined = np.zeros(self.n, bool)
        self.joined[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
        last = first[1:][first[1:] > 0] - 1
        self.joined[last] = False

    def pair_places(self) -> tuple[np.ndarray, np.ndarray]:
        """The words that have a next one in their piece, and the place of each such pair in the sketch."""
        i = np.flatnonzero(self.joined)
        h = span_hashes(self.data, self.at[i], self.at[i + 2] - 1)
        return i, mix(h + self.salts()[self.lang[i]]) >> np.uint64(64 - PAIR_BITS)

    def salts(self) -> np.ndarray:
        return mix(np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64))

    def counted(self, **columns) -> pa.Table:
        """Distinct rows of (l: language, and others) and the number of each."""
        sums = pa.table(columns).group_by(list(columns)).aggregate([([], "count_all")]).combine_chunks()
        return sums.set_column(0, "lang", pa.array(self.langs, pa.string()).take(sums.column("l").combine_chunks())).rename_columns({"count_all": "n"})

    def words(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        strings = pa.StringArray.from_buffers(self.n, pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(self.data))
        sums = self.counted(l=self.lang, s=strings)
        lang, word, n = (sums.column(c).combine_chunks() for c in ("lang", "s", "n"))
        return lang, pc.utf8_slice_codeunits(word, 0, -1), n

    def suffixes(self, pairs: np.ndarray, hot: np.ndarray, max_words: int, buckets: int) -> pa.Table:
        """(lang, bucket, suffix, n) of suffixes of two words or more, each up to its first pair that is not in the bitmap ``pairs``.

        Buckets from ``buckets`` on are those of pairs in the bitmap ``hot``.
        """
        i, place = self.pair_places()
        good, spread = np.zeros(self.n + max_words, bool), np.zeros(self.n, bool)
        good[i], spread[i] = bitmap_has(pairs, place), bitmap_has(hot, place)
        length, going = np.ones(self.n, np.int64), np.ones(self.n, bool)
        for k in range(max_words - 1):
            going &= good[k : k + self.n]
            length += going
        begin = np.flatnonzero(length > 1)
        length, spread = length[begin], spread[begin]
        lead = span_hashes(self.data, self.at[begin], self.at[begin + np.minimum(length, np.where(spread, 3, 2))] - 1)
        bucket = mix(lead + self.salts()[self.lang[begin]]) % np.uint64(buckets) + spread * np.uint64(buckets)
        a, b = self.at[begin], self.at[begin + length] - 1
        offsets = np.append(0, np.cumsum(b - a))
        data = self.data[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
        strings = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data))
        return self.counted(l=self.lang[begin], bucket=bucket.astype(np.int32), suffix=strings)


def word_and_pair_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) per slice of text; and per task the counters of pairs as rows with a ``chunk``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "word", "n", "chunk", "counters"]
        pairs = np.zeros(1 << PAIR_BITS, np.int32)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part)
                if not words.n:
                    continue
                lang, word, n = words.words()
                yield pa.RecordBatch.from_arrays([lang, word, n, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
                np.add.at(pairs, words.pair_places()[1].astype(np.int64), 1)
        chunks = [(k, c) for k, c in enumerate(pairs.reshape(-1, CHUNK)) if c.any()]
        if chunks:
            packed = pa.array([zlib.compress(c.tobytes(), 1) for _, c in chunks], pa.binary())
            none = pa.nulls(len(chunks), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([0] * len(chunks), pa.int64()), pa.array([k for k, _ in chunks], pa.int32()), packed], names)

    return docs.select("lang", "text").mapInArrow(work, "lang string, word string, n long, chunk int, counters binary")


def pair_bitmaps(counted: DataFrame, least: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the sketch's counters that reach ``least`` and ``hot``: 2^``PAIR_BITS`` bits each, added up chunk by chunk on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), np.int32).astype(np.int64)
        if sums:
            bits = [pa.array([np.packbits(s >= x, bitorder="little").tobytes() for s in sums.values()], pa.binary()) for x in (least, hot)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *bits], ["chunk", "bits", "hot"])

    chunks = counted.where("chunk IS NOT NULL").select("chunk", "counters").repartition("chunk").mapInArrow(add, "chunk int, bits binary, hot binary")
    out = np.zeros((2, (1 << PAIR_BITS) // 8), np.uint8)
    for k, *both in chunks.collect():
        for row, bits in zip(out, both, strict=True):
            row[k * CHUNK // 8 : (k + 1) * CHUNK // 8] = np.frombuffer(bits, np.uint8)
    return out[0], out[1]


def packed_blocks(held: list[pa.Table]) -> pa.RecordBatch:
    """(bucket, lang, block): the suffixes of each bucket and language with their numbers, as compressed lines."""
    sums = pa.concat_tables(held).group_by(["bucket", "lang", "suffix"]).aggregate([("n", "sum")]).sort_by([("bucket", "ascending"), ("lang", "ascending"), ("suffix", "ascending")])
    bucket, lang, suffix, n = (sums.column(c).combine_chunks() for c in ("bucket", "lang", "suffix", "n_sum"))
    lines = pc.binary_join_element_wise(suffix, pc.cast(n, pa.large_string()), pc.cast("", pa.large_string()), pc.cast("\t", pa.large_string()))
    code = lang.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.append(True, (np.diff(bucket.to_numpy()) != 0) | (np.diff(code) != 0)))
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = memoryview(lines.buffers()[2])
    edges = offsets[np.append(first, len(lines))].tolist()
    blocks = [zlib.compress(data[a:b], 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([bucket.take(at), lang.take(at), pa.array(blocks, pa.binary())], ["bucket", "lang", "block"])


def routed_suffixes(docs: DataFrame, pairs: np.ndarray, hot: np.ndarray, max_words: int, buckets: int) -> DataFrame:
    """(bucket, lang, block), those of one bucket in one task and next to each other."""
    known = docs.sparkSession.sparkContext.broadcast((pairs, hot))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part)
                if words.n:
                    held.append(words.suffixes(*known.value, max_words, buckets))
                if sum(len(t) for t in held) >= COMBINED:
                    yield packed_blocks(held)
                    held = []
        if sum(len(t) for t in held):
            yield packed_blocks(held)

    found = docs.select("lang", "text").mapInArrow(work, "bucket int, lang string, block binary")
    return found.repartition("bucket").sortWithinPartitions("bucket")


def multikey_quicksort(keys: np.ndarray, weight: np.ndarray, least: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the equal beginnings of ``keys`` (one row a suffix, -1 after its end), as (a row that begins so, its length, the count).

    Three-way partitions by the key at one depth after another; what is smaller than ``least`` is
    left as it is. Beginnings of ``shared`` keys are all counted, those of under ``SHARED`` keys, single words, not at all.
    """
    out: list[tuple[int, int, int]] = []
    small = [np.empty(0, np.int64)]  # abandoned before their shared keys were told apart
    stack = [(np.arange(len(keys)), 0)] if len(keys) else []
    while stack:
        pointers, depth = stack.pop()
        key = keys[pointers, depth]
        pivot = key[len(key) // 2]
        below, same = key < pivot, key == pivot
        for part in (pointers[below], pointers[~(below | same)]):
            if len(part) and weight[part].sum() >= least:
                stack.append((part, depth))
            elif len(part) and depth < shared:
                small.append(part)
        if pivot < 0:  # suffixes that end here
            continue
        equal = pointers[same]
        size = int(weight[equal].sum())
        if depth + 1 == shared or (depth + 1 >= SHARED and size >= least):
            out.append((int(equal[0]), depth + 1, size))
        if size >= least and depth + 1 < keys.shape[1]:
            stack.append((equal, depth + 1))
        elif depth + 1 < shared:
            small.append(equal)
    rest = np.concatenate(small)
    if len(rest):
        rest = rest[np.lexsort(keys[rest, :shared].T[::-1])]
        first = np.flatnonzero(np.append(True, (keys[rest[1:], :shared] != keys[rest[:-1], :shared]).any(1)))
        out += zip(rest[first].tolist(), [shared] * len(first), np.add.reduceat(weight[rest], first).tolist(), strict=True)
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def count_bucket(langs: list[str], blocks: list[bytes], hot: bool, least: int, max_words: int) -> list[tuple[str, str, int, int]]:
    """(lang, phrase, k, n) of a bucket; of a hot one with partial counts of its pairs."""
    lines = [pc.split_pattern(pa.array([zlib.decompress(b)[:-1].decode()], pa.large_string()), "\t").values for b in blocks]
    sizes = [len(x) // 2 for x in lines]
    lines = pa.concat_arrays(lines)
    # a block is suffix, tab, number, tab and so on
    suffix, n = (lines.take(pa.array(np.arange(k, len(lines), 2))) for k in (0, 1))
    lang = pa.array(langs).dictionary_encode()
    words = pc.split_pattern(suffix, " ")
    coded = words.values.dictionary_encode()
    length = np.diff(words.offsets.to_numpy())
    keys = np.full((len(length), max_words + 1), -1, np.int32)
    keys[:, 0] = np.repeat(lang.indices.to_numpy(), sizes)
    row = np.repeat(np.arange(len(length)), length)
    keys[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + 1] = coded.indices.to_numpy()
    at, depth, count = multikey_quicksort(keys, pc.cast(n, pa.int64()).to_numpy(), least, SHARED if hot else 0)
    names, of = coded.dictionary.to_pylist(), lang.dictionary.to_pylist()
    return [(of[keys[p, 0]], " ".join([names[c] for c in keys[p, 1:d]]), d - 1, c) for p, d, c in zip(at.tolist(), depth.tolist(), count.tolist(), strict=True)]


def frequent_phrases(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of 1 to ``max_words`` words with ``least`` occurrences or more; and (lang, total) of all words."""
    counted = staged(word_and_pair_counts(docs), "words")
    totals = staged(counted.where("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, 1 << (every // BUCKET_WORDS).bit_length())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "k", "n"]
        partial: dict[tuple, int] = {}  # at most one for each hot pair and language
        of, langs, blocks = -1, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for lang, phrase, k, n in count_bucket(langs, blocks, of >= buckets, least, max_words) if blocks else []:
                if of >= buckets and k < SHARED:
                    partial[lang, phrase, k] = partial.get((lang, phrase, k), 0) + n
                else:
                    rows.append((lang, phrase, k, n))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema)

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for bucket, lang, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != of:
                    yield from flush()
                    of, langs, blocks = bucket, [], []
                langs.append(lang)
                blocks.append(block)
        yield from flush()
        if partial:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*((*key, n) for key, n in partial.items()), strict=True), strict=True)), schema)

    routed = routed_suffixes(docs, *pair_bitmaps(counted, least, max(every // HOT_SHARE, least)), max_words, buckets)
    phrases = routed.mapInArrow(work, "lang string, phrase string, k int, n long").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
    words = counted.where("chunk IS NULL").groupBy("lang", F.col("word").alias("phrase"), F.lit(1).alias("k")).agg(F.sum("n").alias("n"))
    phrases = staged(words.unionByName(phrases).where(F.col("n") >= least), "phrases")
    drop_staged(counted)
    return phrases, totals


def score() -> Column:
    """floor(1000 * a * total / (l * r)), exact for products of up to 38 digits."""
    above = "CAST(1000 * CAST(a AS DECIMAL(16,0)) * CAST(total AS DECIMAL(16,0)) AS DECIMAL(38,0))"
    return F.expr(f"{above} div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)) AS DECIMAL(38,0))")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """The best ``top`` candidates of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, least, max_words)
    # a language has at most as many candidates as a share of its words, so its words tell which are hot
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    candidates = phrases.where("k > 1").withColumnRenamed("n", "a")
    ends = phrases.where("k > 2").withColumn("w", F.split("phrase", " "))
    part = lambda begin: F.array_join(F.slice("w", begin, F.col("k") - 1), " ").alias("phrase")
    longer = ends.select("lang", part(1), "n").unionByName(ends.select("lang", part(2), "n")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = candidates.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer")
    cuts = alone.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = staged(cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).drop("first", "rest"), "cuts")
    cuts = join_groups(cuts, totals, "lang", "total", every)
    best = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct(score().alias("score"), "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within salts, so that no task orders a whole language
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op12_collocations": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s
  FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(s, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM w
  UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) FROM w
  UNION ALL SELECT lang, 5, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) FROM w),
totals AS MATERIALIZED (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
parts AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase
  FROM c),
longer AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY 1, 2),
alone AS (SELECT c.* FROM c LEFT JOIN longer q USING (lang, phrase) WHERE q.longer IS NULL OR 100 * q.longer < 100 * c.a),
cut AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM alone),
halves AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS one, array_to_string(ws[cut + 1:], ' ') AS two FROM cut),
cuts AS (
  SELECT h.lang, h.phrase, h.a, x.f AS l, y.f AS r, t.n, h.cut,
         (1000::HUGEINT * h.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.one JOIN f y ON y.lang = h.lang AND y.phrase = h.two JOIN totals t ON t.lang = h.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""
}
