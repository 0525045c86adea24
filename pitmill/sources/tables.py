"""Tables written along the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or where that is unset below a local scratch folder or the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        top = "file:///tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_factors(facts: DataFrame, path: str, time: str = "trade_date") -> None:
    """Long factor rows by month of their day, sorted for reads of single factors; months that are written replace what was there."""
    from pyspark.sql import functions as F

    rows = facts.withColumn("month", F.date_format(time, "yyyy-MM")).repartition("month").sortWithinPartitions("month", "factor_id", "security_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_factors(spark: SparkSession, path: str, factor_ids: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Reads prune months by the derived partition column and row groups by factor."""
    from pyspark.sql import functions as F

    out = spark.read.parquet(path)
    if first:
        out = out.where((F.col("month") >= first[:7]) & (F.col("trade_date") >= first))
    if last:
        out = out.where((F.col("month") <= last[:7]) & (F.col("trade_date") <= last))
    return out.where(F.col("factor_id").isin(factor_ids)) if factor_ids else out
