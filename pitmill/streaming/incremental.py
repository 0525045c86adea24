"""Streams of fact rows: newest versions, adding counts, estimates by the newest day, immutable snapshots. ``event_time`` has what ends with event time."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import latest_version
from ..sources.tables import shared_path


class MergedTable:
    """A keyed table that batches of a stream merge into.

    The state is in the table's folder alone: ``v<batch>/bucket=<k>`` holds the keys of
    one bucket as of a batch. A batch rewrites only the buckets of its own keys, and a
    version counts once its write has been committed. A restart finds what was
    committed; a replayed batch starts from the versions before it and writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], combine: Callable[[DataFrame], DataFrame], buckets: int = 32):
        self.spark, self.path, self.keys, self.combine, self.buckets = spark, path.rstrip("/"), keys, combine, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _current(self, before: int | None = None) -> dict[int, str]:
        """The folder of each bucket's newest committed version (below a batch)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = lambda p: [str(f.getPath().toString()) for f in (top.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")) or [])]
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        done = {int(re.search(r"/v(\d+)/_SUCCESS$", f)[1]) for f in pattern("v*/_SUCCESS")}
        found: dict[int, tuple[int, str]] = {}
        for folder in pattern("v*/bucket=*"):
            version, bucket = map(int, re.search(r"/v(\d+)/bucket=(\d+)$", folder).groups())
            if version in done and (before is None or version < before) and version > found.get(bucket, (-1, ""))[0]:
                found[bucket] = version, folder
        return {k: folder for k, (_, folder) in found.items()}

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = {r["_bucket"] for r in batch.select("_bucket").distinct().collect()}  # at most ``buckets``
            old = [folder for k, folder in self._current(batch_id).items() if k in touched]
            rows = batch.drop("_bucket")
            if old:
                rows = self.spark.read.schema(rows.schema).parquet(*old).unionByName(rows)
            self.combine(rows).withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{batch_id:012d}")
            self._remove_superseded(batch_id)
        finally:
            batch.unpersist()

    def _remove_superseded(self, batch_id: int) -> None:
        """Delete bucket versions older than those that this batch, run again, would start from."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        needed = {k: int(re.search(r"/v(\d+)/", folder)[1]) for k, folder in self._current(batch_id).items()}
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/bucket=*")
        for status in pattern.getFileSystem(conf).globStatus(pattern) or []:
            version, bucket = map(int, re.search(r"/v(\d+)/bucket=(\d+)$", str(status.getPath().toString())).groups())
            if version < needed.get(bucket, -1):
                status.getPath().getFileSystem(conf).delete(status.getPath(), True)

    def read(self, schema=None) -> DataFrame:
        folders = sorted(self._current().values())
        if not folders:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(*folders)


def newest(keys: list[str], version: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: latest_version(rows, keys, version[0], version[1:])


def added(keys: list[str], sums: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run what is there beyond the named checkpoint, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_latest(stream: DataFrame, keys: list[str], version: list[str], path: str | None = None) -> DataFrame:
    """The newest row of each key. With the same ``path`` a later run goes on where this one ended."""
    spark = stream.sparkSession
    path = path or shared_path(spark, "latest")
    table = MergedTable(spark, f"{path}/table", keys, newest(keys, version))
    drain(stream, table.merge, f"{path}/checkpoint")
    return table.read(stream.schema)


def keep_sums(stream: DataFrame, keys: list[str], sums: dict[str, Column], path: str | None = None) -> DataFrame:
    """Sums by key over all batches: each is aggregated by itself and added to what is there."""
    spark = stream.sparkSession
    path = path or shared_path(spark, "sums")
    table = MergedTable(spark, f"{path}/table", keys, added(keys, list(sums)))
    batch_sums = lambda batch: batch.groupBy(*keys).agg(*(F.sum(x).alias(c) for c, x in sums.items()))
    drain(stream, lambda batch, k: table.merge(batch_sums(batch), k), f"{path}/checkpoint")
    return table.read(batch_sums(spark.createDataFrame([], stream.schema)).schema)


def live_estimates(stream: DataFrame, by: list[str], time: str, tie: str, days: int = 180, path: str | None = None) -> DataFrame:
    """The latest estimate of each source that has not expired on the newest day seen."""
    now = keep_latest(stream, by, [time, tie], path)
    last = now.agg(F.max(time).alias("_now"))
    return now.crossJoin(F.broadcast(last)).where(F.datediff("_now", time) <= days).withColumnRenamed("_now", "as_of")


class SnapshotLog:
    """Snapshots at given dates, written once: rows that arrive later, and corrections, change only later dates.

    A date is written when a row known after it arrives, from all rows known by then.
    """

    def __init__(self, spark: SparkSession, path: str, dates: DataFrame, keys: list[str], known: str):
        self.spark, self.path, self.dates, self.keys, self.known = spark, path, dates, keys, known
        self.facts = MergedTable(spark, f"{path}/facts", [*keys, known], newest([*keys, known], [known]))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        self.facts.merge(batch, batch_id)
        self.write(batch.schema, batch_id, final=False)

    def write(self, schema, batch_id: int, final: bool) -> None:
        facts = self.facts.read(schema)
        done = self.read()
        todo = self.dates if done is None else self.dates.join(done.where(F.col("written_by") < batch_id).select("snapshot_date").distinct(), "snapshot_date", "left_anti")
        if not final:
            todo = todo.crossJoin(F.broadcast(facts.agg(F.max(self.known).alias("_last")))).where(F.col("snapshot_date") < F.col("_last")).drop("_last")
        found = facts.join(F.broadcast(todo), F.col(self.known) <= F.col("snapshot_date"))
        latest_version(found, [*self.keys, "snapshot_date"], self.known).withColumn("written_by", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={batch_id:012d}")

    def read(self) -> DataFrame | None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        if not (top.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/batch=*/_SUCCESS")) or []):
            return None
        return self.spark.read.parquet(f"{self.path}/snapshots").drop("batch")


def late_safe_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A folder, or a pattern, of Parquet files as a stream with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def write_in_turn(parts: Sequence[DataFrame], path: str, rows_a_file: int = 500_000) -> int:
    """Write each of ``parts`` as a folder below ``path``, one after another and all of as many files.

    Returns that number: a stream that takes so many files a batch takes one part a batch.
    """
    spark = parts[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = max(1, -(-max(part.count() for part in parts) // rows_a_file))
    for k, part in enumerate(parts):
        target = f"{path}/part={k}"
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.parquet(target)
        pattern = jvm.org.apache.hadoop.fs.Path(f"{target}/part-*")
        for _ in range(files - len(pattern.getFileSystem(conf).globStatus(pattern) or [])):  # an empty partition has left no file
            spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(target)
    return files
