"""Shared pieces of the text operators: staged tables, text slices and word hashes.

Everything that runs in a task works on Arrow batches cut into slices of a few
megabytes, so a task's memory depends on the slice size and on the longest
single text, never on the number of rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session has none, a local master gets a scratch folder and any
    other master a folder below the warehouse, which executors can reach too.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not the work before it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read any more: all that was made of them has been staged itself."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``limit`` bytes; one longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets into them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, or of the runs of ``word`` bytes, and for each text the index of its first word (n + 1)."""
    if word is None:
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[:1] = True
    before[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = True
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: np.uint64) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_BASE_INVERSE)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial modulo 2^64 by prefix sums, then mixed with the length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = max(SLICE_BYTES, 1 << int(len(raw)).bit_length()) + 1
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _M2)


def sequence_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive hashes (len - width + 1 of them)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix(h * _BASE + items[k : k + n])
    return h


def ints(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """uint64 hashes as signed longs, and other integer arrays as they are."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values).cast(kind)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), ints(values, kind))


def bitmap(df: DataFrame, place: Column, bits: int) -> np.ndarray:
    """A bitmap of 2^``bits`` bits, packed into bytes, in which the bits ``place`` (0 to 2^bits - 1) of all rows are set.

    Its size is fixed. Pieces of 32768 bits are put together in Spark; at most 2^(bits - 15) of these, 4 KB each, reach the driver.
    """
    place = place + 1  # Spark counts such places from 1
    pieces = df.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    out = np.zeros(1 << max(bits - 3, 12), np.uint8)
    for k, piece in pieces.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(piece, np.uint8)
    return out


def bitmap_has(packed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits ``place`` (uint64) are set."""
    return packed[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1


#: A group that holds more than one in so many rows is hot; there are fewer such groups than this number.
HOT_SHARE = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with the columns of ``groups``, one row a ``key``, whose column ``size`` counts the group's rows among ``total``.

    Hot groups, at most ``HOT_SHARE`` of them, are broadcast, so their rows stay where they are; no other
    key has more than a 1024th of the rows in the shuffle. Both inputs should be staged, as they are read more than once.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    others = groups.where(F.col(size) * HOT_SHARE <= total)
    rest = rows.join(hot.select(key), key, "left_anti").join(others, key, "left")
    return rows.join(hot, key).unionByName(rest)
