"""What small tables do not show: more rows than a page, means at whole numbers, groups of which few rows need a level, parts of several files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitmill.operators import screening
from pitmill.queries import QUERIES, SQL
from pitmill.sources.tables import shared_path
from pitmill.streaming import event_time as et
from pitmill.streaming import incremental as inc

duckdb = pytest.importorskip("duckdb")
N, DAYS = 2600, 22


def whole_means():
    """Lines of 200 suppliers, whose hundredths of 20 days add up to a multiple of 2000; and the means."""
    rng, rows, means = random.Random(1), [], {}
    for k in range(N, N + 200):
        lots = [(rng.randint(90_000, 200_000), rng.randint(1, 50)) for _ in range(19)]
        lots.append((100_000 + -sum(c * q for c, q in lots) % 2000, 1))
        rows += [(k, float(q), c * q / 100, dt.datetime(2000, 1, 3) + dt.timedelta(days=day)) for day, (c, q) in enumerate(lots)]
        means[f"SEC_US_{k}"] = sum(c * q for c, q in lots) // 2000
    return rows, means


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """``N`` suppliers with a line on each of ``DAYS`` days, and 200 more whose traded value of 20 days has a whole mean."""
    folder = str(tmp_path_factory.mktemp("larger"))
    save = lambda df, name: df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    save(spark.createDataFrame(list(enumerate(regions)), "r_regionkey int, r_name string"), "region")
    save(spark.createDataFrame([(k, f"NATION {k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"), "nation")
    save(spark.range(N + 200).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier "), "id").alias("s_name"), (F.col("id") % 25).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")), "supplier")
    lines = spark.range(N * DAYS).select((F.col("id") % N).alias("s"), F.floor(F.col("id") / N).alias("day"))
    many = lines.select(F.col("s").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), (5000 + F.col("s") + F.col("day")).cast("double").alias("l_extendedprice"), F.expr("timestamp'2000-01-03' + make_dt_interval(cast(day as int))").alias("l_shipdate"))
    save(many.unionByName(spark.createDataFrame(whole_means()[0], many.schema)), "lineitem")
    return folder


def of_sql(folder, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cursor = con.execute(SQL[name])
    return [dict(zip((c[0] for c in cursor.description), r, strict=True)) for r in cursor.fetchall()]


def test_a_screen_returns_every_row_with_its_place(spark, tables):
    got = {r.security_id: (r.place, r.n_all) for r in QUERIES["screen_filtered"](spark, tables).collect()}
    assert got == {r["security_id"]: (r["place"], r["n_all"]) for r in of_sql(tables, "screen_filtered")} and len(got) == 2 * (N + 200) // 5


def test_places_go_on_from_part_to_part(spark):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"))
    got = screening.placed(rows.repartition(6), [F.desc("v")]).collect()
    assert sorted((r.place, r.v, r.n_all) for r in got) == [(k + 1, 4999 - k, 5000) for k in range(5000)]
    assert screening.placed(rows.where("v < 0"), [F.desc("v")]).collect() == []


def test_traded_value_is_the_whole_mean(spark, tables):
    got = {r.security_id: r.traded for r in QUERIES["universe"](spark, tables).collect()}
    want = {r["security_id"]: r["traded"] for r in of_sql(tables, "universe")}
    assert got == want and whole_means()[1].items() <= got.items()


def test_scores_take_quantiles_from_aggregates_and_not_from_windows(spark, tables):
    """A window holds the rows of a group; an aggregate returns one row, which is joined back."""
    from pitmill.queries import scoring

    plan = QUERIES["factor_scores"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert len(windows) == 1 + sum("rank(" not in line for line in windows) and not any("percentile(" in line for line in windows)
    assert {r.level for r in QUERIES["factor_scores"](spark, tables).select("level").distinct().collect()} == {"group", "financial"}
    assert QUERIES["factor_scores"](spark, tables).count() == scoring._valued(spark, tables).count()


def test_scores_of_the_last_day_are_those_among_all_days(spark, tables):
    from pitmill.queries import pit_scores

    every = pit_scores._scores(spark, tables)
    last = every.agg(F.max("trade_date")).first()[0]
    assert sorted(map(str, pit_scores._scores(spark, tables, last_only=True).collect())) == sorted(map(str, every.where(F.col("trade_date") == last).collect()))


def test_a_part_of_several_files_is_one_batch(spark):
    """Also where a part has fewer rows than the others have files; every part has the same number of files."""
    path, seen = shared_path(spark, "parts"), {}
    parts = [spark.range(0, 1000), spark.range(2000, 2001), spark.range(5000, 5400), spark.range(9000, 9000)]
    files = inc.write_in_turn(parts, path, rows_a_file=150)
    assert files == 7

    def note(batch, k):
        seen[k] = sorted(r.id for r in batch.collect())

    inc.drain(inc.read_stream(spark, f"{path}/part=*", files), note, f"{path}-checkpoint")
    assert [seen[k] for k in sorted(seen) if seen[k]] == [sorted(r.id for r in part.collect()) for part in parts[:3]]
    assert len(spark.read.parquet(f"{path}/part=0").inputFiles()) == files


def test_keys_that_share_a_bucket_expire_by_themselves(spark):
    """One bucket for all keys: rows that follow in time, that come late but within the delay, repeats, and a key that is null."""
    path, start = shared_path(spark, "bucket"), dt.datetime(2024, 1, 1)
    row = lambda key, day, idx, value: (key, start + dt.timedelta(days=day), idx, value)
    batches = [
        [row("A", 0, 1, 1.0), row("B", 5, 2, 2.0), row(None, 9, 3, 3.0), row("C", 9, 4, 4.0)],
        [row("A", 9, 5, 5.0), row("C", 8, 6, 6.0), row("C", 9, 4, 4.0), row("D", 150, 7, 7.0), row("B", 200, 8, 8.0)],
        [row("E", 193, 9, 9.0), row("D", 340, 10, 10.0), row("F", 400, 11, 11.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, at timestamp, idx long, value double").coalesce(1).write.parquet(f"{path}/in/part={k}")
    out = et.expiries(inc.read_stream(spark, f"{path}/in/part=*"), ["key"], "at", "idx", "value", f"{path}/out", buckets=1)
    got = sorted((str(r.key), r.idx, r.value, (r.expired_at - r.at).days) for r in out.collect())
    assert got == [("A", 5, 5.0, 181), ("B", 2, 2.0, 181), ("B", 8, 8.0, 181), ("C", 4, 4.0, 181), ("D", 7, 7.0, 181), ("E", 9, 9.0, 181), ("None", 3, 3.0, 181)]


def test_the_days_of_a_market_stay_where_they_are(spark):
    """A market's rate comes to its securities' days; these are not gathered by market."""
    from pitmill.operators import capital_cost as cost

    days = spark.range(0, 8000, numPartitions=8).select(F.concat(F.lit("S"), F.col("id") % 100).alias("security_id"), F.expr("date_add(date'2000-01-01', cast(id div 100 as int))").alias("trade_date"), F.lit("M").alias("market"), F.lit("C").alias("country"))
    rates = spark.createDataFrame([("M", dt.date(2000, 1, 11), 1.0), ("M", dt.date(2000, 2, 1), 2.0)], "market string, rate_date date, rate double")
    premiums = spark.createDataFrame([("C", 5.0, 20.0)], "country string, premium double, tax_rate double")
    out = cost.with_rates(days, rates, premiums, "market", "country", cost.Assumptions())
    rows = out.select("trade_date", "risk_free", "rate_flags", F.spark_partition_id().alias("part")).collect()
    assert len(rows) == 8000 and len({r.part for r in rows}) == 8
    assumed = cost.Assumptions().risk_free
    for r in rows:
        want = (assumed, "RISK_FREE_ASSUMED") if r.trade_date < dt.date(2000, 1, 11) else (1.0 if r.trade_date < dt.date(2000, 2, 1) else 2.0, "")
        assert (r.risk_free, r.rate_flags) == want
