"""Benchmark decontamination by canonical templates.

Texts become sequences of canonical tokens: words lose punctuation at their ends
and case; numbers, units after a number and names (capitalised, not at the start
of a sentence) become typed placeholders, whose surface is kept as a slot; names
or numbers with one blank between them are read as one slot too. Windows of the lower-cased
words are joined too, so that a verbatim copy depends on no case and no line breaks.
Windows of ``WINDOW`` canonical tokens are hash-joined with those of the
benchmark (an item with fewer tokens is one window). Matches on one diagonal (the
document's place less the item's) give the share of the item that is covered
and its slots. Diagonals that lie within ``WINDOW`` of the next are also taken
together, so that words put in or left out split no item. A document that puts
*one* value for each slot value of the item has the same question with other
parameters; slots that contradict each other mean that only the wording agrees.
Values that fall together weigh less: the coverage counts times the number of the
document's distinct values over the item's.

Windows with slots need ``MIN_PLAIN`` tokens that are none: a template of little but
placeholders fits anything. An item of fewer words than that is matched only by a
document that consists of just these words.

A document is contaminated by an item if its best diagonal or group of diagonals
is consistent and covers, so weighted, half of the item, or ``LONG_MATCH`` of its
tokens.

Before the join, document windows pass a bitmap of the benchmark's hashes. Its
size is fixed; a larger benchmark lets more rows through to the same join. Windows that
more than a 1024th of all that pass share are spread over ``SALTS`` tasks.

Null and empty texts, and texts without a canonical token, match nothing, on
either side. Rows that share an id are matched one by one and reported once. Rows without
an id are left out of the result. An empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, ints, lower_ascii, sequence_hashes, slices, span_hashes, staged, table, text_bytes, word_spans

WINDOW, MIN_COVERAGE, LONG_MATCH, MIN_PLAIN = 8, 0.5, 30, 4
SALTS = 32
BITMAP_BITS = 24
#: Units that follow a number. Fixed values.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
percent degree degrees dollar dollars cent cents euro euros usd eur gbp mph kmh km/h m/s hz khz mhz w kw kwh j kj v a ohm kb mb gb tb""".split()
VERBATIM = 2  # the kind of windows of words as they are
_KIND = np.uint64(0x706C61696E)  # tells windows of different kinds of tokens apart
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65))
_DIGIT = np.isin(np.arange(256), [*range(48, 58)])
_NUMERIC = _DIGIT | np.isin(np.arange(256), [ord(c) for c in ".,:/-+$%"])
_WORD_BYTE = _DIGIT | np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256), ord("$"), ord("%")])
_UPPER = np.isin(np.arange(256), [*range(65, 91)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:"])


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return span_hashes(raw, np.append(0, ends[:-1]), ends)


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def canonical(raw: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, Tokens, Tokens]:
    """Of all texts of a slice: token hashes, whether each is a slot, byte starts and ends; and for each text the index of its first token (n + 1).

    Three times: with typed slots for single words, with one slot for a run of names
    or of numbers, and with the lower-cased words as they are.
    """
    starts, ends, _ = word_spans(raw, offsets)
    # the first and the last byte of each word that can be in a token
    body = np.append(np.flatnonzero(_WORD_BYTE[raw]), len(raw))
    if not len(starts):
        none = np.empty(0, np.uint64), np.empty(0, bool), starts, ends, np.zeros(len(offsets), np.int64)
        return none, none, none
    tail = raw[ends - 1]
    head = body[np.searchsorted(body, starts)]
    last = body[np.maximum(np.searchsorted(body, ends) - 1, 0)] + 1
    kept = (head < ends) & (last > head)
    opens = np.append(True, _STOP[tail[:-1]])  # a sentence starts here
    breaks = np.append(0, np.cumsum((raw == 10) | (raw == 13)))
    opens[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    opens[np.searchsorted(starts, offsets[:-1][offsets[:-1] <= starts[-1]])] = True
    head, last, opens = head[kept], last[kept], opens[kept]
    hashes = span_hashes(lower_ascii(raw), head, last)
    count = lambda mask: np.append(0, np.cumsum(mask[raw]))
    digits, numeric = count(_DIGIT), count(_NUMERIC)
    number = (digits[last] > digits[head]) & (numeric[last] - numeric[head] == last - head)
    after = np.append(False, number[:-1])
    unit = after & ~number & np.isin(hashes, _unit_hashes())
    second = np.minimum(head + 1, len(raw) - 1)
    first, following = raw[head], raw[second]
    accented = (first == 0xC3) & (following >= 0x80) & (following <= 0x9E)
    name = ~number & ~opens & (last - head > 1) & ((_UPPER[first] & ~_UPPER[following]) | accented)
    out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes)))
    first_of = np.searchsorted(head, offsets)
    joins = np.append(False, (number | name)[1:] & (out[1:] == out[:-1]) & (head[1:] == last[:-1] + 1))[: len(head)]
    joins[first_of[:-1][first_of[:-1] < len(head)]] = False
    at = np.flatnonzero(~joins)
    merged = out[at], (number | unit | name)[at], head[at], last[np.append(at[1:], len(head)) - 1] if len(at) else last, np.searchsorted(head[at], offsets)
    return (out, number | unit | name, head, last, first_of), merged, (hashes, np.zeros(len(head), bool), head, last, first_of)


def windows(texts: DataFrame, key: str, widths: list[int], bitmap=None) -> DataFrame:
    """(hash, key, row, pos, n, slots, kind) of every window; with ``bitmap`` (a broadcast) only of those that it may contain.

    Without a bitmap each text gives windows of ``max(widths)`` tokens, or one of
    all its tokens if it has fewer. With it, each text gives windows of each of ``widths``,
    but one of under ``MIN_PLAIN`` words only if that is the whole text.
    """
    largest = max(widths, default=WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(1))
                rows: list[tuple] = []
                for kind, (tokens, slot, head, last, first) in enumerate(canonical(raw, offsets)):
                    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    for width in range(1, largest + 1) if bitmap is None else widths:
                        h = sequence_hashes(tokens, width) ^ _KIND * np.uint64(kind)
                        good = of[: len(h)] == of[width - 1 :] if len(h) else np.empty(0, bool)
                        if (bitmap is None and width < largest) or width < MIN_PLAIN:
                            good &= np.diff(first)[of[: len(h)]] == width
                        if kind < VERBATIM:
                            plain = np.append(0, np.cumsum(~slot))
                            good &= plain[width:][: len(h)] - plain[: len(h)] >= MIN_PLAIN
                        if bitmap is not None:
                            place = h >> np.uint64(64 - BITMAP_BITS)
                            good &= bitmap.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
                        for at in np.flatnonzero(good):
                            values = [raw[head[t] : last[t]].tobytes().decode("utf-8", "replace").lower() for t in range(at, at + width) if slot[t]]
                            text = int(of[at])
                            rows.append((int(h[at].view(np.int64)), text, int(at - first[text]), int(first[text + 1] - first[text]), values, kind))
                if rows:
                    hashes, text, pos, n, slots, kinds = zip(*rows, strict=True)
                    columns = pa.array(hashes, pa.int64()), part.column(0).take(pa.array(text)), part.column(2).take(pa.array(text)), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(slots, pa.list_(pa.string())), pa.array(kinds, pa.int32())
                    yield pa.RecordBatch.from_arrays(list(columns), ["hash", key, "row", "pos", "n", "slots", "kind"])

    rows = texts.select(F.col(key).cast("long"), "text", F.monotonically_increasing_id()).where(F.col(key).isNotNull())
    return rows.mapInArrow(run, f"hash long, {key} long, row long, pos int, n int, slots array<string>, kind int")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, long_match: int = LONG_MATCH) -> DataFrame:
    """Pairs (doc_id, item_id) of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text), with what was matched."""
    spark = docs.sparkSession
    items = windows(benchmark, "item_id", [window]).select(F.col("hash"), "item_id", F.col("pos").alias("item_pos"), F.col("n").alias("item_tokens"), F.col("slots").alias("item_slots"), "kind")
    items = staged(items.distinct(), "items")
    places = items.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("p"), F.least(F.col("item_tokens"), F.lit(window)).alias("w"))
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[places.select("p").distinct().toPandas()["p"].to_numpy(np.int64)] = True  # at most 2^BITMAP_BITS rows
    widths = sorted(r.w for r in places.select("w").distinct().collect())  # at most ``window``
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    found = staged(windows(docs, "doc_id", widths, bitmap), "windows")
    hot = found.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > found.count())
    hot = F.broadcast(staged(hot.select("hash", F.lit(True).alias("hot")), "hot_windows"))  # fewer rows than HOT_SHARE
    found = found.join(hot, "hash", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    items = items.join(hot, "hash", "left").withColumn("salt", F.explode(salts)).drop("hot")
    found = found.join(items, ["hash", "kind", "salt"]).withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("item_pos", F.col("item_pos") + F.least("item_tokens", F.lit(window)) - 1))))
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")))))
    of = ["doc_id", "row", "item_id", "kind", "item_tokens"]
    lines = found.groupBy(*of, "diagonal").agg(covered.alias("covered"), pairs.alias("pairs"))
    w = Window.partitionBy(*of).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > window, F.lit(False)).cast("int")
    lines = lines.withColumn("apart", apart).withColumn("near", F.sum("apart").over(w)).withColumn("alone", F.array("diagonal"))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    grouped = lines.groupBy(*of, "near").agg(union("covered"), union("pairs"), F.min("diagonal").alias("diagonal"), F.count("*").alias("n_diagonals"))
    lines = lines.select(*of, "diagonal", "covered", "pairs", F.lit(1).cast("long").alias("n_diagonals")).unionByName(grouped.where("n_diagonals > 1").drop("near"))
    side = lambda k: F.size(F.array_distinct(F.transform("pairs", lambda p: p[k])))
    lines = lines.withColumn("n_slots", F.size("pairs")).withColumn("n_changed_slots", F.size(F.filter("pairs", lambda p: p["i"] != p["d"])))
    lines = lines.where(side("i") == F.col("n_slots")).withColumn("matched_tokens", F.size("covered"))
    lines = lines.withColumn("coverage", F.col("matched_tokens") / F.col("item_tokens")).withColumn("weight", F.when(F.col("n_slots") > 0, side("d") / F.col("n_slots")).otherwise(1.0))
    lines = lines.where((F.col("coverage") * F.col("weight") >= min_coverage) | (F.col("matched_tokens") * F.col("weight") >= long_match))
    order = F.struct(F.col("coverage") * F.col("weight"), -F.col("kind"), "matched_tokens", -F.col("n_diagonals"), -F.col("n_changed_slots"), -F.col("diagonal"), -F.col("row"))
    best = F.max_by(F.struct("matched_tokens", "item_tokens", "coverage", "n_slots", "n_changed_slots", "weight", "n_diagonals"), order)
    return lines.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
