"""Streams in event time over several batches: expiry without a read, closed windows, late rows, repeats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import shared_path
from ..sources.views import read, reports, sql
from ..streaming import event_time as et
from ..streaming import incremental as inc


def _in_order(df, time: str, path: str, parts: int = 4):
    """``df``, written once, as ``parts`` in the order of ``time`` with equal shares of its span."""
    df.write.parquet(path)
    df = df.sparkSession.read.parquet(path)
    ends = df.agg(F.min(time).cast("timestamp").cast("long").alias("a"), F.max(time).cast("timestamp").cast("long").alias("b"))
    part = F.least(F.floor((F.col(time).cast("timestamp").cast("long") - F.col("a")) * parts / (F.col("b") - F.col("a") + 1)), F.lit(parts - 1)).cast("int")
    placed = df.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("a", "b")
    return [placed.where(F.col("_part") == k).drop("_part") for k in range(parts)]


def _events(spark, d):
    return read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _with_stragglers(spark, d):
    """A stream of the events in order of time, but for every 97th, which comes with the last part."""
    e = _events(spark, d)
    path = shared_path(spark, "stragglers")
    parts = [*_in_order(e.where("event_id % 97 <> 0"), "ts", f"{path}/all"), e.where("event_id % 97 = 0")]
    return _stream(spark, parts, f"{path}/in")


def _stream(spark, parts, path: str):
    files = inc.write_in_turn(parts, path)
    return inc.read_stream(spark, f"{path}/part=*", files)


def stream_expired_estimates(spark, d):
    """Estimates that no newer one of the same broker followed within 180 days, as timers report them."""
    path = shared_path(spark, "expiry")
    rows = reports(spark, d).select("security_id", "broker", F.col("report_date").cast("timestamp").alias("report_date"), "report_idx", "estimate")
    stream = _stream(spark, _in_order(rows, "report_date", f"{path}/all"), f"{path}/in")
    out = et.expiries(stream, ["security_id", "broker"], "report_date", "report_idx", "estimate", f"{path}/out")
    return out.select("security_id", "broker", F.to_date("report_date").alias("report_date"), "report_idx", F.col("value").alias("estimate"), F.to_date("expired_at").alias("expired_at"))


def stream_closed_windows(spark, d):
    """Daily counts of the days that the watermark has closed; stragglers are not in them."""
    path = shared_path(spark, "closed")
    out, _ = et.closed_windows(_with_stragglers(spark, d), "ts", ["event_type"], path)
    return out.select("event_type", F.to_date("start").alias("day"), "n")


def stream_late_rows(spark, d):
    """The stragglers that came after their day was closed."""
    path = shared_path(spark, "late")
    return et.late_rows(_with_stragglers(spark, d), "ts", path).select("event_id", "event_type", F.to_date("ts").alias("day"))


def stream_first_seen(spark, d):
    """Each event once, though every tenth comes again with a later part."""
    path = shared_path(spark, "seen")
    e = _events(spark, d)
    later = F.ntile(4).over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    again = e.where("event_id % 10 = 0").withColumn("q", later)
    stream = _stream(spark, [*_in_order(e, "ts", f"{path}/all"), *(again.where(F.col("q") == k + 1).drop("q") for k in range(4))], f"{path}/in")
    out, _ = et.first_seen(stream, ["event_id"], "ts", f"{path}/out", "400 days")
    return out.select("event_id", "event_type", F.to_date("ts").alias("day"))


QUERIES = {f.__name__: f for f in (stream_expired_estimates, stream_closed_windows, stream_late_rows, stream_first_seen)}

#: The last file comes when windows are closed up to the newest time of the first three of its four predecessors, less two days.
_LATE = """WITH o AS (SELECT ts, floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', min(ts) OVER ()))) * 4 / (epoch(date_trunc('second', max(ts) OVER ())) - epoch(date_trunc('second', min(ts) OVER ())) + 1)) AS part FROM events WHERE event_id % 97 <> 0),
m AS (SELECT (SELECT max(ts) FROM o WHERE part < 3) - INTERVAL 2 DAY AS mark, max(ts) - INTERVAL 2 DAY AS last FROM events),
e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, event_id % 97 = 0 AND CAST(ts AS DATE) + INTERVAL 1 DAY <= mark AS late FROM events, m) """
SQL = {
    "stream_expired_estimates": sql(
        "reports",
        """SELECT security_id, broker, report_date, report_idx, estimate, CAST(report_date + 181 AS DATE) AS expired_at FROM r
        WHERE next >= report_date + 181 OR (next IS NULL AND report_date + 181 < (SELECT max(report_date) FROM reports) - INTERVAL 36 HOUR)""",
        r="SELECT security_id, broker, report_date, report_idx, estimate, lead(report_date) OVER (PARTITION BY security_id, broker ORDER BY report_date, report_idx) AS next FROM reports",
    ),
    "stream_closed_windows": _LATE + "SELECT event_type, day, count(*) AS n FROM e, m WHERE NOT late AND day + INTERVAL 1 DAY <= last GROUP BY 1, 2",
    "stream_late_rows": _LATE + "SELECT event_id, event_type, day FROM e WHERE late",
    "stream_first_seen": "SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events",
}
