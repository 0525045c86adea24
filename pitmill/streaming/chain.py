"""Snapshots at given dates as a chain of changes, so that a batch costs what the batch holds.

A fact that arrives belongs to the first date, at or after the day it became known, that earlier
batches have not closed; a date is closed once a later day was known. Only this
change is written. A snapshot is, for each key, the newest known of all changes up to its date: what comes
late, and corrections, change only dates that were open when they came. Compaction folds the
changes up to a date into one row a key and removes the files they were in.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import latest_version


class SnapshotChain:
    """``path``/changes/batch=<k> has the changes of a batch, written over when the batch runs again; ``path``/folded/upto=<k> all of batches up to k, compacted."""

    def __init__(self, spark: SparkSession, path: str, dates: Sequence[date], keys: Sequence[str], known: str):
        self.spark, self.path, self.dates, self.keys, self.known = spark, path.rstrip("/"), sorted(set(dates)), list(keys), known

    def _folders(self, kind: str) -> dict[int, str]:
        """Committed folders of a kind by number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = [str(f.getPath().getParent().toString()) for f in (pattern.getFileSystem(conf).globStatus(pattern) or [])]
        return {int(re.search(r"=(\d+)$", f)[1]): f for f in found}

    def _live(self) -> tuple[int, list[str]]:
        """The last folded batch, and the folders that hold the chain."""
        folded = self._folders("folded")
        upto = max(folded, default=-1)
        later = [f for k, f in sorted(self._folders("changes").items()) if k > upto]
        return upto, ([folded[upto]] if folded else []) + later

    def _newest_known(self, before: int):
        marks = [f for k, f in self._folders("marks").items() if k < before]
        return self.spark.read.parquet(*marks).agg(F.max("known")).first()[0] if marks else None

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch; one that has been folded already is not taken again."""
        if batch_id <= self._live()[0]:
            return
        closed = self._newest_known(batch_id)
        still_open = [d for d in self.dates if closed is None or d >= closed]
        dates = F.array(*(F.lit(d) for d in still_open)) if still_open else F.array().cast("array<date>")
        belongs = F.get(F.filter(dates, lambda d: d >= F.col(self.known)), F.lit(0))
        changes = latest_version(batch.withColumn("snapshot_date", belongs), [*self.keys, "snapshot_date"], self.known)
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id:012d}")
        batch.agg(F.max(self.known).alias("known")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id:012d}")

    def changes(self) -> DataFrame:
        return self.spark.read.parquet(*self._live()[1])

    def snapshot(self, day: date) -> DataFrame:
        """One row a key: the newest known of the changes up to ``day``."""
        rows = self.changes().where(F.col("snapshot_date") <= F.lit(day)).drop("snapshot_date")
        return latest_version(rows, self.keys, self.known).withColumn("snapshot_date", F.lit(day))

    def snapshots(self) -> DataFrame:
        """All dates: a change holds from its date until the next one that is known later; rows go to their dates by number, without a range join."""
        place = F.array_position(F.array(*(F.lit(d) for d in self.dates)), F.col("snapshot_date")).cast("int")
        rows = self.changes().where("snapshot_date IS NOT NULL").withColumn("_p", place)
        w = Window.partitionBy(*self.keys).orderBy("_p", self.known)
        earlier = F.max(self.known).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_old", F.coalesce(earlier > F.col(self.known), F.lit(False))).where("NOT _old")
        rows = rows.withColumn("_next", F.coalesce(F.lead("_p").over(w), F.lit(len(self.dates) + 1))).where("_next > _p")
        spread = rows.drop("snapshot_date", "_old").withColumn("_at", F.explode(F.sequence(F.col("_p"), F.col("_next") - 1)))
        return spread.withColumn("snapshot_date", F.get(F.array(*(F.lit(d) for d in self.dates)), F.col("_at") - 1)).drop("_p", "_next", "_at")

    def compact(self, day: date) -> None:
        """Fold what is at or before ``day``, whose own snapshot is then the oldest, and remove the folders that are no longer read."""
        upto, live = self._live()
        last = max([upto, *self._folders("changes")], default=-1)
        if not live or last == upto:
            return
        rows = self.spark.read.parquet(*live)
        kept = rows.where(F.col("snapshot_date").isNull() | (F.col("snapshot_date") > F.lit(day)))
        folded = self.snapshot(day).select(rows.columns).unionByName(kept)
        folded.write.mode("overwrite").parquet(f"{self.path}/folded/upto={last:012d}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in live:
            old = jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(conf).delete(old, True)
