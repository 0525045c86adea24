"""Exact Jaccard self-join on word n-grams, with prefix filters under several global token orders.

A token is the 64-bit hash of a shingle of lower-cased words. Two sets whose
Jaccard similarity reaches the threshold share a token in their prefixes under
*every* global order of the tokens, and as many as their sizes ask for. Three
orders are used: rare tokens first, and the same within either half of the
tokens first, so that the last two test different tokens. One pass over the
texts gives the prefixes under all of them, those of the first order as rows and
all as bitmaps. A join on prefix tokens of the first order gives candidates; of
these only pairs whose bitmaps allow enough shared prefix tokens under each of the
three orders have their texts fetched and their sets intersected.

Groups of copies are kept from growing quadratically. Documents with equal sets
are one class from the start. Within a prefix token's group every member is
first tested against one pivot, the member with the fewest rarer tokens; links
found are contracted to components; only pairs from different components that
the length and position bounds allow are tested afterwards. No link between
different components is lost, so the components are exact. Every link lies within
a component: at the end all pairs of each component are tested, block by block,
for the number of links.

How rare a token is comes from a sketch of fixed size. Any order is a valid
global order, so the sketch changes the work and never the result.

Null or blank texts have an empty set and link with nothing. Rows that share an
id are one node. Rows without an id get the component of their class. Tokens
are taken to be equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, ints, lower_ascii, mix, sequence_hashes, slices, span_hashes, staged, table, text_bytes, word_spans
from .components import components

SKETCH_BITS, ORDERS = 20, 3
#: Longs of a prefix's bitmap.
SIGN_WORDS = 8
BLOCK_TOKENS = 1_000_000
#: So many ids at most are broadcast (16 MB).
BROADCAST_IDS = 2_000_000
#: Members of a component that are tested against as many others at a time.
BLOCK_DOCS, BLOCK_COLUMNS = 128, 1 << 14
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than ``width`` make one shingle."""
    raw, offsets = text_bytes(column)
    raw = lower_ascii(raw)
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    runs = sequence_hashes(words, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield sequence_hashes(words[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: for each document its set's size and signature, and for each block the counts of tokens that recur in it, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        held = 0

        def sketch() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(block), return_counts=True)
            token, n = token[n >= 2], n[n >= 2]
            counts = np.bincount((token & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), weights=n)
            bucket = np.flatnonzero(counts)
            none = pa.nulls(len(bucket), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(bucket).cast(pa.int64()), pa.array(counts[bucket].astype(np.int64))], names)

        names = ["doc_id", "n", "hi", "lo", "bucket", "count"]
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column(1), width))
                size = np.array([len(s) for s in sets], np.int64)
                hi = np.array([np.add.reduce(mix(s ^ _A)) for s in sets], np.uint64)
                lo = np.array([np.add.reduce(mix(s ^ _B)) for s in sets], np.uint64)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), ints(hi, pa.int64()), ints(lo, pa.int64()), none, none], names)
                block += sets
                held += int(size.sum())
                if held >= BLOCK_TOKENS:
                    yield sketch()
                    block, held = [], 0
        if held:
            yield sketch()

    return docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, bucket long, count long")


def rarity(profile: DataFrame) -> np.ndarray:
    """A level for each of the sketch's buckets: 2^SKETCH_BITS bytes, whatever the input's size."""
    rows = profile.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("n")).toPandas()
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    level[rows["bucket"].to_numpy(np.int64)] = np.minimum(255, 4 * np.log2(1 + rows["n"].to_numpy(float))).astype(np.uint8)
    return level


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def order_keys(tokens: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Keys whose ascending order is the global order: 0 by rarity, 1 and 2 one half of the tokens before the other."""
    rank = level[(tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    if not order:
        return rank << np.uint64(55) | tokens >> np.uint64(9)
    other = mix(tokens ^ _C)
    half = (other & np.uint64(1)) ^ np.uint64(order - 1)
    return half << np.uint64(63) | rank << np.uint64(55) | other >> np.uint64(9)


def prefix(tokens: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    keys = order_keys(tokens, level, order)
    p = prefix_length(len(keys), percent)
    return np.sort(np.partition(keys, p - 1)[:p])


def signatures(keys: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix a bitmap of ``SIGN_WORDS`` longs of its keys' lowest bits, and how many keys fell on a bit that was taken."""
    bits = SIGN_WORDS * 64
    held = np.zeros((len(each), bits), np.uint8)
    held[np.repeat(np.arange(len(each)), each), (keys & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held, axis=1, bitorder="little").view(np.int64), (each - held.sum(1)).astype(np.int32)


def postings(docs: DataFrame, width: int, percent: int, level) -> DataFrame:
    """(token, doc_id, pos, n): each document's prefix under the first order; the row at place 0 also has the signatures of its prefixes. ``level``: a broadcast of ``rarity``.

    ``signs`` has the bitmaps of the prefixes under all orders, and ``lost`` for each
    how many keys share a bit with others of the same prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(i, len(s), [prefix(s, level.value, o, percent) for o in range(ORDERS)]) for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), width), strict=True) if len(s)]
                if not found:
                    continue
                ids, sizes, keys = zip(*found, strict=True)
                each = np.array([len(k[0]) for k in keys])
                first = np.cumsum(each) - each
                columns = np.concatenate([k[0] for k in keys]), np.repeat(np.array(ids, np.int64), each), np.arange(each.sum()) - np.repeat(first, each), np.repeat(np.array(sizes), each)
                rows = [ints(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                signs, lost = zip(*(signatures(np.concatenate([k[o] for k in keys]), each) for o in range(ORDERS)), strict=True)
                at = np.full(len(columns[0]), -1)
                at[first] = np.arange(len(first))
                none = at < 0
                for values, kind in ((np.concatenate(signs, axis=1), pa.int64()), (np.stack(lost, axis=1), pa.int32())):
                    offsets = pa.array(np.append(0, np.cumsum(~none) * values.shape[1]).astype(np.int32), mask=np.append(none, False))
                    rows.append(pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), kind)))
                yield pa.RecordBatch.from_arrays(rows, ["token", "doc_id", "pos", "n", "signs", "lost"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "token long, doc_id long, pos int, n int, signs array<long>, lost array<int>")


def may_link(i: Column, n: Column, j: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can link if their first common token is at the places i and j.

    The tokens before it are in one set only, which bounds the symmetric difference from below.
    """
    apart = F.greatest(i + j, m - n + 2 * i, n - m + 2 * j)
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def of_wanted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ``pairs``: by a broadcast of the wanted ids where their number allows it, else by a shuffled semi-join."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", "left_semi")


def enough_shared(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may share as many prefix tokens under every order as a link needs.

    A link has a certain number of common tokens. Of these, under any order, only as
    many as the longer rest of the two sets, beyond its prefix, can be missing from
    the prefixes. Shared tokens fall on shared bits, one each but for the lost ones, so
    the bits that two prefixes share bound their common tokens from above; very long
    prefixes fill their bitmaps and pass.
    """
    signs = of_wanted(listed.where("pos = 0").select("doc_id", "n", "signs", "lost"), pairs)
    a, b = (signs.toDF(k, f"{k}_n", f"{k}_signs", f"{k}_lost") for k in "ab")
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    needed = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent)) - F.greatest(rest("a_n"), rest("b_n"))
    both = pairs.join(a, "a").join(b, "b")
    for o in range(ORDERS):
        bits = sum((F.bit_count(F.get("a_signs", F.lit(k)).bitwiseAND(F.get("b_signs", F.lit(k)))) for k in range(o * SIGN_WORDS, (o + 1) * SIGN_WORDS)), F.lit(0))
        both = both.where(bits + F.least(F.get("a_lost", F.lit(o)), F.get("b_lost", F.lit(o))) >= needed)
    return both.select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the exact test. Texts travel instead of token sets, since they compress and hashes do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x, y = (list(shingle_sets(part.column(c), width)) for c in (2, 3))
                good = np.zeros(part.num_rows, bool)
                for k, (s, t) in enumerate(zip(x, y, strict=True)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    good[k] = len(s) > 0 and 100 * common >= percent * (len(s) + len(t) - common)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good)) for c in (0, 1)], ["a", "b"])

    pairs = staged(pairs, "pairs")
    texts = staged(of_wanted(docs.select("doc_id", "text"), pairs), "texts")
    both = pairs.join(texts.toDF("a", "a_text"), "a").join(texts.toDF("b", "b_text"), "b")
    links = staged(both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct(), "links")
    drop_staged(pairs, texts)
    return links


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common tokens of each two sets."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.cumsum(times > 1) - 1  # tokens of a single set are in no intersection
    kept = times[column] > 1
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, [at, at + BLOCK_COLUMNS])
        held = np.zeros((len(sets), int(column[b - 1]) + 1 - at), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        common += (held @ held.T).astype(np.int64)
    common[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return common


def link_counts(found: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, n_links): for each node of ``found`` (node, component) all the nodes of its component that it links with.

    The members of a component are dealt into blocks by a hash, and each two blocks
    are one group. The two members of a pair have one link.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, block = (group.column(c).to_numpy() for c in ("node", "block"))
        text = group.column("text")
        sets = list(shingle_sets(text.chunk(0) if text.num_chunks else pa.array([], pa.string()), width))
        size = np.array([len(s) for s in sets])
        common = common_tokens(sets)
        link = (100 * common >= percent * (size[:, None] + size - common)) & (common > 0) & (node[:, None] != node)
        if group.column("x")[0] != group.column("y")[0]:
            link &= block[:, None] != block
        names, which = np.unique(node, return_inverse=True)
        linked = np.zeros((len(names), len(names)), bool)
        a, b = np.nonzero(link)
        linked[which[a], which[b]] = True
        return pa.table({"rep": names, "n": linked.sum(1).astype(np.int64)})

    members = found.join(found.groupBy("component").agg(F.count("*").alias("k")), "component")
    twos = members.where("k = 2").select(F.col("node").alias("rep"), F.lit(1).cast("long").alias("n_links"))
    n_blocks = F.ceil(F.col("k") / BLOCK_DOCS).cast("int")
    more = members.where("k > 2").select("node", "component", n_blocks.alias("blocks"), F.pmod(F.xxhash64("node"), n_blocks).cast("int").alias("block"))
    if found.count() <= BROADCAST_IDS // 2:
        more = F.broadcast(more)
    rows = docs.join(more, docs["doc_id"] == more["node"]).select("node", "component", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "block", "text")
    counted = rows.groupBy("component", "x", "y").applyInArrow(run, "rep long, n long")
    return twos.unionByName(counted.groupBy("rep").agg(F.sum("n").alias("n_links")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs`` (doc_id, text; other columns are not read).

    n_links counts the other classes that the document's class links with; 0 means
    that no other set is similar.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profile = staged(profiles(docs, width), "profiles")
    level = spark.sparkContext.broadcast(rarity(profile))
    rows = profile.where("bucket IS NULL").select("doc_id", "n", "hi", "lo")
    classes = staged(rows.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep")), "classes")

    listed = staged(postings(docs, width, percent, level), "postings")
    places = listed.select("token", "doc_id", "pos", "n")
    shared = places.groupBy("token").agg(F.count("*").alias("_k")).where("_k > 1").select("token")
    live = places.join(shared, "token").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    live = staged(live.select("token", "doc_id", "pos", "n"), "live")

    pivot = live.groupBy("token").agg(F.min(F.struct("pos", "n", "doc_id")).alias("p"), F.count("*").alias("_k")).where("_k > 1")
    star = live.join(pivot.select("token", "p"), "token").where(F.col("doc_id") != F.col("p.doc_id"))
    star = star.where(may_link(F.col("pos"), F.col("n"), F.col("p.pos"), F.col("p.n"), percent))
    star = staged(star.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct(), "stars")
    links = verified(enough_shared(star, listed, percent), docs, width, percent)

    near = components(links)
    named = live.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    named = staged(named.join(mixed, "token", "left_semi"), "named")
    x, y = (named.select("token", *(F.col(c).alias(f"{k}_{c}") for c in ("doc_id", "pos", "n", "component"))) for k in "xy")
    cross = x.join(y, (x["token"] == y["token"]) & (x["x_doc_id"] < y["y_doc_id"]) & (x["x_component"] != y["y_component"]) & may_link(x["x_pos"], x["x_n"], y["y_pos"], y["y_n"], percent))
    cross = cross.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    cross = staged(cross, "cross")
    drop_staged(live, named, star)
    more = verified(enough_shared(cross, listed, percent), docs, width, percent)
    drop_staged(listed, cross)

    found = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if not more.isEmpty() else near
    degree = link_counts(found, docs, width, percent)
    classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    out = rows.join(classes.drop("n"), ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)
