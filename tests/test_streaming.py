
import glob
from datetime import date

from pyspark.sql import functions as F

from pitmill.sources.tables import shared_path
from pitmill.streaming import incremental as inc
from pitmill.streaming.chain import SnapshotChain


def files(spark, rows, schema, n):
    path = shared_path(spark, "in")
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.parquet(f"{path}/part={k}")
    return path


def test_sums_over_files_of_one_day_restart_and_replay(spark):
    rows = [(k % 2, 1.0 * k) for k in range(30)]
    source = files(spark, rows, "key int, value double", 3)
    path = shared_path(spark, "sums")
    stream = lambda: inc.read_stream(spark, f"{source}/part=*")
    sums = {"n": F.lit(1).cast("long"), "total": F.col("value")}
    want = [(0, 15, sum(v for k, v in rows if k == 0)), (1, 15, sum(v for k, v in rows if k == 1))]
    assert sorted(map(tuple, inc.keep_sums(stream(), ["key"], sums, path).collect())) == want
    assert sorted(map(tuple, inc.keep_sums(stream(), ["key"], sums, path).collect())) == want  # a restart finds nothing new
    spark.createDataFrame([(1, 100.0), (5, 1.0)], "key int, value double").coalesce(1).write.parquet(f"{source}/part=9")
    more = [want[0], (1, 16, want[1][2] + 100.0), (5, 1, 1.0)]
    assert sorted(map(tuple, inc.keep_sums(stream(), ["key"], sums, path).collect())) == more
    table = inc.MergedTable(spark, f"{path}/table", ["key"], inc.added(["key"], ["n", "total"]))
    last = spark.createDataFrame([(1, 1, 100.0), (5, 1, 1.0)], "key int, n long, total double")
    table.merge(last, 3)  # the last batch once more
    assert sorted(map(tuple, table.read().select("key", "n", "total").collect())) == more


def test_uncommitted_versions_do_not_count(spark):
    path = shared_path(spark, "latest")
    table = inc.MergedTable(spark, path, ["key"], inc.newest(["key"], ["at"]), buckets=3)
    table.merge(spark.createDataFrame([(k, 1, "a") for k in range(9)], "key int, at int, v string"), 0)
    table.merge(spark.createDataFrame([(4, 2, "b"), (5, 0, "late")], "key int, at int, v string"), 1)
    spark.createDataFrame([(4, 9, "x")], "key int, at int, v string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/v000000000007/bucket=0")
    got = {r.key: r.v for r in table.read().collect()}
    assert got == {k: "b" if k == 4 else "a" for k in range(9)}


def test_corrections_do_not_change_older_snapshots(spark):
    path = shared_path(spark, "log")
    dates = spark.sql("SELECT explode(array(DATE'2020-12-31', DATE'2021-12-31')) AS snapshot_date")
    log = inc.SnapshotLog(spark, path, dates, ["key"], "known")
    rows = lambda *r: spark.createDataFrame([(k, v, d) for k, v, d in r], "key int, value int, d string").select("key", "value", F.to_date("d").alias("known"))
    log.append(rows((1, 10, "2020-03-01"), (2, 20, "2020-04-01")), 0)
    log.append(rows((3, 30, "2021-02-01")), 1)
    log.append(rows((1, 99, "2020-06-01"), (2, 21, "2021-03-01")), 2)  # one comes late
    log.write(rows((0, 0, "2020-01-01")).schema, 3, final=True)
    got = {(str(r.snapshot_date), r.key): r.value for r in log.read().collect()}
    assert got == {("2020-12-31", 1): 10, ("2020-12-31", 2): 20, ("2021-12-31", 1): 99, ("2021-12-31", 2): 21, ("2021-12-31", 3): 30}


def test_versions_that_no_replay_needs_are_removed(spark):
    path = shared_path(spark, "versions")
    table = inc.MergedTable(spark, path, ["key"], inc.added(["key"], ["n"]), buckets=2)
    for k in range(5):
        table.merge(spark.createDataFrame([(i, 1) for i in range(8)], "key int, n int"), k)
    table.merge(spark.createDataFrame([(i, 1) for i in range(8)], "key int, n int"), 4)  # once more
    assert {r.n for r in table.read().collect()} == {5}
    kept = {f.split("/v")[-1][:12] for f in table.read().inputFiles()} | {f"{k:012d}" for k in range(5) if glob.glob(f"{path.removeprefix('file://')}/v{k:012d}/bucket=*")}
    assert kept == {f"{3:012d}", f"{4:012d}"}


def known_rows(spark, *r):
    return spark.createDataFrame([(k, v, d) for k, v, d in r], "key int, value int, d string").select("key", "value", F.to_date("d").alias("known"))


def test_a_chain_of_changes_gives_the_snapshots(spark):
    path = shared_path(spark, "chain")
    dates = [date(2020, 12, 31), date(2021, 12, 31), date(2022, 12, 31)]
    chain = SnapshotChain(spark, path, dates, ["key"], "known")
    chain.append(known_rows(spark, (1, 10, "2020-03-01"), (2, 20, "2020-04-01")), 0)
    chain.append(known_rows(spark, (3, 30, "2021-02-01")), 1)
    for _ in range(2):  # the last batch runs again
        chain.append(known_rows(spark, (1, 99, "2020-06-01"), (2, 21, "2021-03-01"), (2, 19, "2020-01-01"), (9, 1, "2023-05-05")), 2)
    want = {("2020-12-31", 1): 10, ("2020-12-31", 2): 20, ("2021-12-31", 1): 99, ("2021-12-31", 2): 21, ("2021-12-31", 3): 30}
    want |= {("2022-12-31", k): v for (d, k), v in want.items() if d == "2021-12-31"}
    got = lambda frame: {(str(r.snapshot_date), r.key): r.value for r in frame.collect()}
    assert got(chain.snapshots()) == want
    for day in dates:
        assert got(chain.snapshot(day)) == {k: v for k, v in want.items() if k[0] == str(day)}
    chain.compact(dates[1])
    assert got(chain.snapshots()) == {k: v for k, v in want.items() if k[0] > "2021"} and chain.changes().count() == 4
    assert not glob.glob(f"{path.removeprefix('file://')}/changes/batch=*")
    chain.append(known_rows(spark, (1, 5, "2020-01-01")), 2)  # folded already
    chain.append(known_rows(spark, (3, 31, "2022-02-01"), (1, 98, "2020-05-01")), 3)
    # when batch 2 came, 2023 was known: all dates are closed
    assert got(chain.snapshot(dates[2])) == {k: v for k, v in want.items() if k[0] == "2022-12-31"}


def test_a_batch_writes_only_its_own_changes(spark):
    path = shared_path(spark, "chain")
    chain = SnapshotChain(spark, path, [date(2020, m, 28) for m in range(1, 13)], ["key"], "known")
    chain.append(known_rows(spark, *((k, k, "2020-01-05") for k in range(500))), 0)
    chain.append(known_rows(spark, (7, 70, "2020-03-05")), 1)
    assert spark.read.parquet(f"{path}/changes/batch={1:012d}").count() == 1 and chain.changes().count() == 501
    assert {r.n for r in chain.snapshots().groupBy("snapshot_date").agg(F.count("*").alias("n")).collect()} == {500}


def test_empty_batches(spark):
    empty = spark.createDataFrame([], "key int, at int")
    table = inc.MergedTable(spark, shared_path(spark, "none"), ["key"], inc.newest(["key"], ["at"]))
    table.merge(empty, 0)
    assert table.read(empty.schema).collect() == []
