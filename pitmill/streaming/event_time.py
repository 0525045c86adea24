"""Streams whose state ends with event time: expiry by timers, windows that close, repeats within the watermark, late rows aside."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Timers need the state store on disk; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def append_batches(stream: DataFrame, path: str) -> StreamingQuery:
    """Drain an append or update stream into ``path``/rows, one folder a batch: a batch that runs again replaces its own folder."""
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={k:012d}")
    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows/batch=*")


class Expiry(StatefulProcessor):
    """The newest row of each key of a bucket; a row without a successor for ``days`` days is emitted by a timer, without a later row of its key.

    A bucket has one timer, at the day when the first of its rows is over. Keys share
    buckets as a call and its state cost the same for one key as for a thousand.
    """

    def __init__(self, keys: str, names: list[str], time: str, tie: str, days: int):
        self.keys, self.names, self.time, self.tie, self.days = keys, names, time, tie, days

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getListState("latest", f"{self.keys}, at timestamp, tie long, value double")

    def _held(self) -> pd.DataFrame:
        held = pd.DataFrame(list(self.latest.get()) if self.latest.exists() else [], columns=[*self.names, self.time, self.tie, "value"])
        return held.astype({self.time: "datetime64[ns]", self.tie: "int64", "value": "float64"})

    def _due(self, rows: pd.DataFrame) -> pd.Series:
        return rows[self.time] + timedelta(days=self.days + 1)

    def _keep(self, rows: pd.DataFrame) -> None:
        """Make ``rows`` the state, with a timer for the first of them that is over."""
        if rows.empty:
            self.latest.clear()
            return
        self.latest.put(list(zip(*(rows[c].tolist() for c in self.names), [at.to_pydatetime() for at in rows[self.time]], rows[self.tie].tolist(), rows["value"].tolist(), strict=True)))
        self.handle.registerTimer(int(self._due(rows).min().timestamp() * 1000))

    def _over(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[[*self.names, self.time, self.tie, "value"]].assign(expired_at=self._due(rows))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        new = pd.concat([x[held.columns] for x in rows]).astype(held.dtypes[[self.time, self.tie, "value"]])
        every = pd.concat([held.assign(_held=1), new.assign(_held=0)] if len(held) else [new.assign(_held=0)])
        # a row up to the held one changes nothing; of rows at one time and tie the first counts
        every = every.sort_values([self.time, self.tie, "_held"], kind="stable", ignore_index=True)
        of_key = every.groupby(self.names, dropna=False, sort=False)["_held"]
        every = every[(of_key.transform("max") == 0) | (of_key.cumsum() > 0)].drop_duplicates([*self.names, self.time, self.tie])
        after = every.groupby(self.names, dropna=False, sort=False)[self.time].shift(-1)
        over = every[after >= self._due(every)]  # these had expired before the next one came
        if len(over):
            yield self._over(over)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self._keep(every[after.isna()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = self._due(held) < pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        if over.any():
            yield self._over(held[over])
        self._keep(held[~over])

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, keys: list[str], time: str, tie: str, value: str, path: str, days: int = 180, late: str = "36 hours", buckets: int = 512) -> DataFrame:
    """(keys, time, tie, value, expired_at) of every row that no newer row of its key followed within ``days`` days.

    A timer fires when the watermark passes a row's last day, so a key that falls
    silent expires although nothing of it is read again; its state is then gone.
    With the same ``path`` and ``buckets`` a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    rows = stream.select(*keys, F.col(time).cast("timestamp").alias(time), F.col(tie).cast("long").alias(tie), F.col(value).cast("double").alias("value")).withWatermark(time, late)
    named = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{named}, {time} timestamp, {tie} long, value double, expired_at timestamp"
    with rocksdb(spark):
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        append_batches(dealt.groupBy("_bucket").transformWithStateInPandas(Expiry(named, keys, time, tie, days), schema, "Append", "EventTime"), path)
    return read_batches(spark, path, schema)


def closed_windows(stream: DataFrame, time: str, by: list[str], path: str, width: str = "1 day", late: str = "2 days") -> tuple[DataFrame, StreamingQuery]:
    """Counts of the windows that the watermark has closed, each emitted once and then forgotten; and the query, whose progress tells the rows of state."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    out = counts.select(F.col("w.start").alias("start"), *by, "n")
    query = append_batches(out, path)
    return read_batches(stream.sparkSession, path, out.schema), query


def late_rows(stream: DataFrame, time: str, path: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """The rows that windows of ``width`` leave out, as their window was closed before their batch.

    A batch closes windows by the watermark that the batches before it have set, so
    what it receives is late by the newest time of all batches but the last one. Each batch's newest time is kept beside its late rows, so a restart or a batch that runs again finds what was before it.
    """
    spark = stream.sparkSession

    def split(batch: DataFrame, k: int) -> None:
        marks = f"{path}/marks"
        before = f"{path}/marks/batch=" + "{" + ",".join(f"{j:012d}" for j in range(k - 1)) + "}"
        if k > 1:
            mark = spark.read.parquet(before).agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("mark"))
            found = batch.crossJoin(F.broadcast(mark)).where(F.window(time, width)["end"] <= F.col("mark")).drop("mark")
        else:
            found = batch.where("false")
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={k:012d}")
        batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={k:012d}")

    query = stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_batches(spark, path, stream.schema)


def first_seen(stream: DataFrame, keys: list[str], time: str, path: str, late: str = "2 days") -> tuple[DataFrame, StreamingQuery]:
    """Each key's first row; a repeat within the watermark's delay is left out, and the key forgotten after it."""
    out = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    query = append_batches(out, path)
    return read_batches(stream.sparkSession, path, stream.schema), query
