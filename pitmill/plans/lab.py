"""The factor lab: saved runs as factors, rankings, blends of factors, bands of fair prices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import divide


def save_run(frame: DataFrame, factor_id: str, path: str) -> None:
    """A run's valid values as rows of the factor ``lab_<factor_id>``, in its own partition; saving again replaces it."""
    rows = frame.where("is_valid").select("trade_date", "security_id", F.lit(f"lab_{factor_id}").alias("factor_id"), F.col("value").alias("factor_value"), F.lit("lab").alias("financial_basis"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_id").parquet(path)


def saved_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("trade_date", "security_id", "factor_id", "factor_value")


def ranking(frame: DataFrame, metadata: DataFrame, limit: int = 100, day: str | None = None) -> DataFrame:
    """The best valid values of a day (else the last valid one), with rank, percentile of all and metadata.

    Only the ``limit`` best rows are numbered; the number of all is counted apart.
    """
    rows = frame.where("is_valid")
    last = rows.agg(F.max("trade_date").alias("trade_date")) if day is None else rows.sparkSession.sql(f"SELECT DATE'{day}' AS trade_date")
    rows = rows.join(F.broadcast(last), "trade_date")
    n = rows.agg(F.count("*").alias("n_ranked"))
    best = rows.orderBy(F.desc("value"), "security_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("value"), "security_id"))
    out = best.withColumn("rank", rank).crossJoin(F.broadcast(n))
    percentile = F.when(F.col("n_ranked") == 1, 100.0).otherwise(divide(F.col("n_ranked") - F.col("rank"), F.col("n_ranked") - 1) * 100)
    return out.withColumn("percentile", percentile).join(metadata, "security_id", "left")


def last_rows(frame: DataFrame, k: int, by: str = "security_id", time: str = "trade_date") -> DataFrame:
    """The last k rows of each security."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time)))).where(F.col("_r") <= k).drop("_r")


def dense_score_observed(frame: DataFrame, neutral: float = 50.0) -> DataFrame:
    """0 to 100 by average rank among the observed rows of a day; imputed rows (is_observed false) get ``neutral``."""
    w = Window.partitionBy("trade_date", "is_observed")
    rank = F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy("trade_date", "is_observed", "value")) - 1) / 2
    n = F.count("*").over(w)
    score = F.when(n == 1, 100.0).otherwise(divide(rank - 1, n - 1) * 100)
    return frame.withColumn("score", F.when(F.col("is_observed"), score).otherwise(neutral))


def entered_and_left(positions: DataFrame, calendar: DataFrame) -> DataFrame:
    """(segment_id, security_id, change): what a rebalance bought that the one before did not hold, and what it no longer holds."""
    held = positions.join(F.broadcast(calendar.select("segment_id", "signal_date")), "signal_date").select("segment_id", "security_id")  # made once: each row tells of its segment and of the next
    at = lambda k, now, old: F.struct((F.col("segment_id") + k).alias("segment_id"), F.lit(now).alias("now"), F.lit(old).alias("old"))
    both = held.select("security_id", F.inline(F.array(at(0, True, None), at(1, None, True)))).groupBy("segment_id", "security_id").agg(F.max("now").alias("now"), F.max("old").alias("old"))
    both = both.join(F.broadcast(calendar.select("segment_id")), "segment_id", "left_semi")
    change = F.when(F.col("old").isNull(), "entered").when(F.col("now").isNull(), "left")
    return both.withColumn("change", change).where("change IS NOT NULL").select("segment_id", "security_id", "change")


def excess_returns(annual: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Annual returns beside the benchmark's: its last value of a year over that of the year before."""
    last = benchmark.groupBy(F.year("trade_date").alias("year")).agg(F.max_by("index_close", "trade_date").alias("_c"))
    own = last.withColumn("benchmark_return", divide("_c", F.lag("_c").over(Window.partitionBy(F.lit(0)).orderBy("year"))) - 1)  # one row a year
    return annual.join(own.drop("_c"), "year", "left").withColumn("excess", F.col("annual_return") - F.col("benchmark_return"))


def long_short(buckets: DataFrame, n: int) -> DataFrame:
    """The best bucket's mean return less the worst one's."""
    at = lambda k: F.max(F.when(F.col("bucket") == k, F.col("mean_return")))
    return buckets.groupBy("trade_date").agg((at(1) - at(n)).alias("long_short"))


#: Weight vectors, and scores of them, that a task holds at once.
VECTORS_AT_ONCE, SCORES_AT_ONCE = 512, 1 << 23


def best_of_day(scores: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether a security (row) is among the best ``positions`` of each vector (column); ties go to earlier rows."""
    n = len(scores)
    wanted = np.minimum(positions, n)
    places = np.unique(n - wanted)
    level = np.partition(scores, places, axis=0)[n - wanted, np.arange(scores.shape[1])]
    above, equal = scores > level, scores == level
    return above | (equal & (np.cumsum(equal, axis=0) <= wanted - above.sum(0)))


def daily_best(panel: DataFrame, vectors: DataFrame, factors: Sequence[str], positions: int | None = 2) -> DataFrame:
    """(vector, trade_date, n, total): number and sum of the following returns of each vector's best securities of a day.

    ``vectors`` are parameters and go to the driver and from there to the tasks. A day's securities lie in one task, as a
    matrix of factors; its product with blocks of the weights gives all scores there, so one row a day and vector leaves the task, never one a security.
    A missing factor or weight makes a score the last one.
    """
    table = vectors.select("vector", *(F.col(f"w_{f}").cast("double") for f in factors), *(["positions"] if positions is None else [])).toPandas()
    weights = table[[f"w_{f}" for f in factors]].to_numpy(float)
    names, most = table["vector"].to_numpy(np.int64), table["positions"].to_numpy(np.int64) if positions is None else np.full(len(table), positions)
    shared = panel.sparkSession.sparkContext.broadcast((weights, names, most))

    def day_rows(day, x: np.ndarray, forward: np.ndarray) -> Iterator[pa.RecordBatch]:
        weights, names, most = shared.value
        known = ~np.isnan(forward)
        step = max(1, min(VECTORS_AT_ONCE, SCORES_AT_ONCE // max(1, len(x))))
        for at in range(0, len(names), step):
            part = slice(at, at + step)
            scores = np.round(x @ weights[part].T, 9)
            scores[np.isnan(scores)] = -np.inf
            best = best_of_day(scores, most[part]) & known[:, None]
            total = np.where(known, forward, 0.0) @ best
            yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array([day] * len(total), pa.date32()), pa.array(best.sum(0).astype(np.int64)), pa.array(total)], ["vector", "trade_date", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            x = np.column_stack([rows.column(f).to_numpy().astype(float) for f in factors])
            yield from day_rows(rows.column("trade_date")[0].as_py(), x, rows.column("forward").to_numpy().astype(float))

        for batch in batches:
            days = batch.column(0).cast(pa.int32()).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(days)) + 1).tolist(), len(days)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and part.num_rows and held[0].column(0)[0] != part.column(0)[0]:
                    yield from flush()
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from flush()

    rows = panel.select("trade_date", "security_id", *(F.col(f).cast("double").alias(f) for f in factors), F.col("forward").cast("double").alias("forward"))
    ordered = rows.repartition("trade_date").sortWithinPartitions("trade_date", "security_id").drop("security_id")
    return ordered.mapInArrow(run, "vector long, trade_date date, n long, total double")


def evaluate_vectors(panel: DataFrame, vectors: DataFrame, factors: Sequence[str], split: str, positions: int | None = 2) -> DataFrame:
    """For each weight vector the mean and t statistic of its best securities' following returns, before and after ``split``.

    ``panel``: (trade_date, security_id, factors, forward); ``vectors``: (vector, a
    weight a factor[, positions]).
    """
    daily = daily_best(panel, vectors, factors, positions).where("n > 0").withColumn("r", F.col("total") / F.col("n"))
    part = F.when(F.col("trade_date") < F.lit(split), "train").otherwise("test")
    out = daily.groupBy("vector", part.alias("part")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("*").cast("double"))).alias("t_stat"))
    return out


def allowed(vectors: DataFrame, factors: Sequence[str], largest: float, least_used: int) -> DataFrame:
    """Weight vectors with no weight over ``largest`` and at least so many factors used."""
    used = sum((F.when(F.col(f"w_{f}") > 0, 1).otherwise(0) for f in factors), F.lit(0))
    return vectors.where((F.greatest(*(F.col(f"w_{f}") for f in factors)) <= largest) & (used >= least_used))


def best_blends(results: DataFrame, vectors: DataFrame, key: str = "new_factor") -> DataFrame:
    """Of each new factor's blends the one with the best mean in training, with its mean in the test."""
    wide = results.groupBy("vector").agg(F.max(F.when(F.col("part") == "train", F.col("mean"))).alias("train"), F.max(F.when(F.col("part") == "test", F.col("mean"))).alias("test"))
    rows = wide.join(F.broadcast(vectors.select("vector", key, "weight", "positions")), "vector")
    best = F.max_by(F.struct("weight", "positions", "train", "test"), F.struct(F.round("train", 9), -F.col("vector")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def fair_prices(current: DataFrame, history: DataFrame, peers: Sequence[str]) -> DataFrame:
    """For each security and factor the median of its own, and of all ``peers``' levels, over its multiple, times the price.

    ``current``: (security_id, factor_id, multiple, close, and a column a level);
    ``history``: (security_id, factor_id, own).
    """
    out, names = current.join(history, ["security_id", "factor_id"], "left"), ["own"]
    for level in peers:
        middle = current.groupBy("factor_id", level).agg(F.round(F.percentile("multiple", 0.5), 9).alias(f"of_{level}"))
        out = out.join(middle, ["factor_id", level])
        names.append(f"of_{level}")
    have = F.array_sort(F.array_compact(F.array(*names)))
    n = F.size(have)
    middle = (F.get(have, F.floor((n - 1) / 2).cast("int")) + F.get(have, F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("target", middle).withColumn("fair_price", F.col("close") * divide("target", "multiple"))


def central_band(bands: DataFrame, profiles: DataFrame, default: Sequence[str], group: str = "sector", least: int = 2, margin: float = 10.0) -> DataFrame:
    """The median fair price over the factors of a security's profile, or of the default factors where the profile has fewer than ``least``.

    ``profiles``: (group, factor_id), a table of parameters.
    """
    rows = bands.where("fair_price IS NOT NULL").join(F.broadcast(profiles.withColumn("_own", F.lit(True))), [group, "factor_id"], "left")
    own = F.coalesce("_own", F.lit(False))
    general = F.col("factor_id").isin(list(default))
    g = rows.groupBy("security_id", "close").agg(F.count_if(own).alias("n_own"), F.percentile(F.when(own, F.col("fair_price")), 0.5).alias("_a"), F.count_if(general).alias("n_default"), F.percentile(F.when(general, F.col("fair_price")), 0.5).alias("_b"))
    enough = F.col("n_own") >= least
    out = g.withColumn("fair_price", F.when(enough, F.col("_a")).otherwise(F.col("_b"))).withColumn("n_factors", F.when(enough, F.col("n_own")).otherwise(F.col("n_default")))
    return out.withColumn("buy_below", F.col("fair_price") * (1 - margin / 100)).withColumn("sell_above", F.col("fair_price") * (1 + margin / 100)).drop("_a", "_b", "n_own", "n_default")


def signal(fair: Column, close: Column, neutral: float = 0.05) -> Column:
    gap = divide(fair, close) - 1
    return F.when(gap > neutral, "undervalued").when(gap < -neutral, "overvalued").when(gap.isNotNull(), "neutral")
