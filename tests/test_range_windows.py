"""Binned range windows against brute force and against Spark's own range frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.operators import range_windows
from lagline.operators.range_windows import DAY, HOUR, RangeAgg, choose_bin, delay_features, lagged_last, range_features, rolling_stats, trailing_rate

BASE = dt.datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = "id long, k string, ts timestamp, v double"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, None if s is None else BASE + dt.timedelta(seconds=s), v) for i, (k, s, v) in enumerate(rows)], SCHEMA)


def brute(rows, func, start, end):
    """Expected value per row id."""
    out = {}
    for i, (k, s, _) in enumerate(rows):
        inside = [] if s is None else [(t, j, v) for j, (q, t, v) in enumerate(rows) if q == k and t is not None and s + start <= t <= s + end]
        values = [v for _, _, v in inside if v is not None]
        if func == "count":
            out[i] = len(values)
        elif func == "last":
            out[i] = max(inside)[2] if inside else None
        elif not values:
            out[i] = None
        else:
            out[i] = {"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[func](values)
    return out


FRAMES = [(-6 * HOUR, -2 * HOUR), (-1 * HOUR, 0), (-26 * HOUR, -2 * HOUR), (-168 * HOUR, 0), (-3 * HOUR, 0), (HOUR, 4 * HOUR), (-2 * HOUR, 2 * HOUR)]


@pytest.mark.parametrize("func", ["count", "sum", "avg", "min", "max", "last"])
def test_matches_brute_force(spark, func):
    rng = random.Random(func)
    # Whole quarter hours, so that frame bounds and ties are hit often.
    rows = [(rng.choice("ab"), rng.randrange(0, 60 * 24) * 900, rng.choice([None, *range(1, 50)])) for _ in range(160)]
    rows = [(k, s, None if v is None else float(v)) for k, s, v in rows]
    aggs = [RangeAgg(f"f{i}", func, "v", a, b) for i, (a, b) in enumerate(FRAMES)]
    got = range_features(frame(spark, rows), "ts", {"k": aggs}, tie_break="id").collect()
    assert len(got) == len(rows)
    for i, (a, b) in enumerate(FRAMES):
        want = brute(rows, func, a, b)
        assert {r.id: r[f"f{i}"] for r in got} == pytest.approx(want), (func, a, b)


def test_bin_width_does_not_change_results(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(0, 20 * DAY), float(rng.randrange(100))) for _ in range(300)]
    aggs = {"k": [RangeAgg("a", "avg", "v", -26 * HOUR, -2 * HOUR), RangeAgg("n", "count", "v", -170 * HOUR, -2 * HOUR)]}
    results = [
        {r.id: (r.a, r.n) for r in range_features(frame(spark, rows), "ts", aggs, bin_seconds=b).collect()} for b in (2 * HOUR, HOUR, 1800)
    ]
    # Whole numbers: sums are exact in any order.
    assert results[0] == results[1] == results[2]


def test_equals_native_range_frame(spark, small_tables):
    events = spark.read.parquet(f"{small_tables}/events.parquet").withColumn("c", F.col("value").cast("decimal(12,2)"))
    seconds = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    native = W.partitionBy("event_type").orderBy("us").rangeBetween(-26 * HOUR * 1_000_000, -2 * HOUR * 1_000_000)
    want = seconds.select("event_id", F.sum("c").over(native).alias("s"), F.count("c").over(native).alias("n"))
    got = range_features(events, "ts", {"event_type": [RangeAgg("s", "sum", "c", -26 * HOUR, -2 * HOUR), RangeAgg("n", "count", "c", -26 * HOUR, -2 * HOUR)]})
    assert sorted(map(tuple, got.select("event_id", "s", "n").collect())) == sorted(map(tuple, want.collect()))


def test_bounds_ties_and_nulls(spark):
    rows = [
        ("a", 0, 10.0), ("a", 4 * HOUR, 20.0), ("a", 6 * HOUR, 1.0),  # exactly 6 h and 2 h before the third
        ("a", 6 * HOUR, 2.0), ("b", 6 * HOUR, 3.0), (None, 0, 5.0), (None, 3 * HOUR, 6.0), ("a", None, 7.0), ("a", None, 8.0),
    ]
    aggs = [RangeAgg("avg", "avg", "v", -6 * HOUR, -2 * HOUR), RangeAgg("n", "count", "v", -HOUR, 0)]
    got = {r.id: (r.avg, r.n) for r in range_features(frame(spark, rows), "ts", {"k": aggs}).collect()}
    assert got[2] == (15.0, 2) and got[3] == (15.0, 2)  # both ends belong, ties see each other
    assert got[4] == (None, 1)
    assert got[6] == (5.0, 1)  # rows without a key form one group, as in any window
    assert got[7] == (None, 0) and got[8] == (None, 0)  # no time, no frame


def test_latest_value_may_be_null(spark):
    rows = [("a", 0, 5.0), ("a", HOUR, None), ("a", 4 * HOUR, 1.0), ("a", 4 * HOUR, 9.0), ("a", 8 * HOUR, 0.0)]
    got = {r.id: r.prev for r in lagged_last(frame(spark, rows), "k", "ts", "v", -26 * HOUR, -2 * HOUR, "prev", tie_break="id").collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 9.0}


def test_no_feature_sees_the_last_two_hours(spark):
    """Changing values newer than two hours never changes the delay features of a row."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(0, 3 * DAY), float(rng.randrange(90))) for _ in range(120)]
    probe = max(range(len(rows)), key=lambda i: rows[i][1])
    changed = [(k, s, 999.0 if s > rows[probe][1] - 2 * HOUR else v) for k, s, v in rows]
    pick = lambda data: (
        delay_features(frame(spark, data), "ts", "v", "k", "k", "k", "id").filter(F.col("id") == probe)
        .select("av_airport_delay", "av_carrier_delay", "prev_delay_tailnum", "weekly_flights_tailnum").first()
    )
    assert pick(rows) == pick(changed)


def test_rolling_and_rate_names(spark):
    rows = [("a", 0, 2.0), ("a", HOUR, 4.0), ("a", 5 * HOUR, 6.0)]
    got = {r.id: (r["3h_avg_v"], r["6h_max_v"]) for r in rolling_stats(frame(spark, rows), "k", "ts", ["v"], (3, 6), ("avg", "max")).collect()}
    assert got == {0: (2.0, 2.0), 1: (3.0, 4.0), 2: (6.0, 6.0)}
    rate = {r.id: r.r for r in trailing_rate(frame(spark, rows), "k", "ts", "v", 168 * HOUR, 100.0, "r").collect()}
    assert rate == {0: 0.01, 1: 0.02, 2: 0.03}


def test_bin_choice():
    agg = lambda a, b: RangeAgg("x", "count", "v", a, b)
    assert choose_bin(agg(-6 * HOUR, -2 * HOUR)) == HOUR * 1_000_000
    assert choose_bin(agg(-7000, 0)) == 3500 * 1_000_000
    assert choose_bin(agg(-3601, -7)) == 3594 * 1_000_000
    long = choose_bin(agg(-3 * 365 * DAY, -2 * HOUR))
    assert (3 * 365 * DAY - 2 * HOUR) * 1_000_000 % long == 0 and 1000 <= (3 * 365 * DAY - 2 * HOUR) * 1_000_000 // long <= 2500
    with pytest.raises(ValueError):
        choose_bin(agg(-6 * HOUR, 0), bin_seconds=7000)
    with pytest.raises(ValueError):
        agg(0, 0)
    with pytest.raises(ValueError):
        RangeAgg("x", "median", "v", -1, 0)


@pytest.mark.parametrize("func", ["sum", "min", "last"])
def test_any_bounds_and_very_long_frames(spark, func):
    rng = random.Random(func)
    rows = [(rng.choice("ab"), rng.randrange(0, 4 * 365 * DAY) if i % 3 else rng.randrange(0, 3 * HOUR), float(rng.randrange(50))) for i in range(150)]
    frames = [(-3601, -7), (-61, 0), (-3 * 365 * DAY, -2 * HOUR), (-400 * DAY - 1, -1), (-5 * HOUR - 17, -2 * HOUR)]
    aggs = [RangeAgg(f"f{i}", func, "v", a, b) for i, (a, b) in enumerate(frames)]
    for options in ({}, {"row_id": "id"}):
        got = range_features(frame(spark, rows), "ts", {"k": aggs}, tie_break="id", **options).collect()
        for i, (a, b) in enumerate(frames):
            assert {r.id: r[f"f{i}"] for r in got} == pytest.approx(brute(rows, func, a, b)), (func, a, b)


def test_unused_columns_are_not_read(spark, small_tables):
    from lagline.operators.fills import forward_fill
    from lagline.operators.joins import asof_join
    from lagline.operators.stats import with_previous

    orders = spark.read.parquet(f"{small_tables}/orders.parquet")
    events = spark.read.parquet(f"{small_tables}/events.parquet")
    other = events.select(F.col("ts").alias("seen"), F.col("user_id").alias("who"), F.col("value").alias("reading"), F.col("event_type").alias("kind"))
    read = lambda df: set("".join(p.split(">")[0] for p in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: struct<")[1:]).replace(":", ",").split(",")) & {
        *orders.columns, *events.columns}
    mean = range_features(orders, "o_orderdate", {"o_custkey": [RangeAgg("m", "avg", "o_totalprice", -30 * DAY, -DAY)]})
    assert read(mean.select("o_orderkey", "m")) == {"o_orderkey", "o_orderdate", "o_custkey", "o_totalprice"}
    assert read(asof_join(events, other, "ts", "seen", "user_id", "who").select("event_id", "reading")) == {"event_id", "ts", "user_id", "value"}
    assert read(forward_fill(events, ["user_id"], "ts", ["value"], "event_id").select("event_id", "value")) == {"event_id", "ts", "user_id", "value"}
    assert read(with_previous(events, ["user_id"], "ts", "value", "p", "event_id").select("p")) == {"event_id", "ts", "user_id", "value"}


def test_hot_key_is_spread_over_cells(spark):
    """All rows on one key: the shuffle still has a cell per hour, not one partition."""
    rows = [("hot", i * 600, 1.0) for i in range(600)]
    df = range_features(frame(spark, rows), "ts", {"k": [RangeAgg("n", "count", "v", -6 * HOUR, -2 * HOUR)]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__k0" in plan and "__p" in plan and "SinglePartition" not in plan
    assert df.agg(F.sum("n")).first()[0] == sum(brute(rows, "count", -6 * HOUR, -2 * HOUR).values())


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(range_windows, "_ROWS_PER_TASK", 100, raising=False)
    rows = [("abc"[i % 3], i * 600, float(i % 11)) for i in range(600)]
    got = rolling_stats(frame(spark, rows), "k", "ts", ["v"], (3, 6, 12))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600 and len(sizes) > 10 and max(sizes) < 100
    want = {h: brute(rows, "avg", -h * HOUR, 0) for h in (3, 6, 12)}
    assert all(r[f"{h}h_avg_v"] == pytest.approx(want[h][r.id]) for r in got.collect() for h in want)
