from datetime import datetime, timedelta

from pitmill.sources.tables import shared_path
from pitmill.streaming import event_time as et
from pitmill.streaming import incremental as inc

DAY = timedelta(days=1)
START = datetime(2024, 1, 1)
ESTIMATE = "security string, broker string, at timestamp, idx long, value double"


def add(spark, path, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={k}")


def test_a_silent_broker_expires_by_timer_also_after_a_restart(spark):
    path = shared_path(spark, "expiry")
    row = lambda broker, day, idx, value: ("S", broker, START + day * DAY, idx, value)
    run = lambda: sorted((r.broker, (r.at - START).days, r.idx, r.value, (r.expired_at - START).days) for r in et.expiries(inc.read_stream(spark, f"{path}/in/part=*"), ["security", "broker"], "at", "idx", "value", f"{path}/out").collect())
    add(spark, f"{path}/in", 0, [row("A", 0, 1, 10.0), row("B", 0, 2, 20.0), row("A", 3, 3, 11.0)], ESTIMATE)
    add(spark, f"{path}/in", 1, [row("B", 100, 4, 21.0), row("B", 100, 5, 22.0)], ESTIMATE)
    assert run() == []
    add(spark, f"{path}/in", 2, [row("C", 190, 6, 30.0)], ESTIMATE)  # no row of A, but A is over
    assert run() == [("A", 3, 3, 11.0, 184)]
    add(spark, f"{path}/in", 3, [row("A", 195, 7, 12.0), row("C", 700, 8, 31.0)], ESTIMATE)
    assert run() == [("A", 3, 3, 11.0, 184), ("A", 195, 7, 12.0, 376), ("B", 100, 5, 22.0, 281), ("C", 190, 6, 30.0, 371)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def events(path, spark, days, k, late=()):
    rows = [(100 * k + i, START + day * DAY + timedelta(hours=i % 24), "x" if i % 2 else "y") for i, day in enumerate([*days, *late])]
    add(spark, path, k, rows, "id long, ts timestamp, kind string")
    return rows


def test_windows_close_once_state_is_freed_and_late_rows_are_told(spark):
    path = shared_path(spark, "windows")
    rows = [events(f"{path}/in", spark, [d for d in range(10 * k, 10 * k + 10) for _ in range(3)], k, late=[0, 1, 39 if k == 4 else 10 * k]) for k in range(5)]
    stream = lambda: inc.read_stream(spark, f"{path}/in/part=*")
    out, query = et.closed_windows(stream(), "ts", ["kind"], f"{path}/closed")
    got = {(r.kind, (r.start - START).days): r.n for r in out.collect()}
    late = {r.id for r in et.late_rows(stream(), "ts", f"{path}/late").collect()}
    want, first_two = {}, {i for k in (2, 3, 4) for i, ts, _ in rows[k] if (ts - START).days < 2}
    assert late == first_two
    for i, ts, kind in (r for part in rows for r in part):
        if i not in late:
            want[kind, (ts - START).days] = want.get((kind, (ts - START).days), 0) + 1
    end = max(ts for part in rows for _, ts, _ in part) - 2 * DAY
    assert got == {k: n for k, n in want.items() if START + (k[1] + 1) * DAY <= end}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 2 * 20 and kept[-1] <= 2 * 4
    again, _ = et.closed_windows(stream(), "ts", ["kind"], f"{path}/closed")  # nothing new after a restart
    assert again.count() == out.count()


def test_repeats_are_left_out_and_keys_forgotten(spark):
    path = shared_path(spark, "repeats")
    for k in range(4):
        events(f"{path}/in", spark, [10 * k + d for d in range(10)], k)
    rows = [(i, START + 39 * DAY, "again") for i in (305, 306)]
    add(spark, f"{path}/in", 9, rows, "id long, ts timestamp, kind string")
    out, query = et.first_seen(inc.read_stream(spark, f"{path}/in/part=*"), ["id"], "ts", f"{path}/out", "5 days")
    got = out.collect()
    assert len(got) == len({r.id for r in got}) == 40 and "again" not in {r.kind for r in got}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] < 25
