"""Schema, filters, scalar functions, null profiling and imputation on small frames."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.functions.dates import FEDERAL_HOLIDAYS, calendar_date, calendar_text, federal_holidays, hhmm_minutes_diff, holiday_window, holiday_window_dates, parse_date, parse_number
from lagline.functions.scalars import binary_label, bucket_text, cutoff_label, guarded_ratio, hash_score, haversine_km, keep_levels, text_label, threshold_zero
from lagline.operators import fills, filters, profile, schema


def values(df, col="x"):
    return [r[col] for r in df.orderBy("i").select(col).collect()]


def indexed(spark, rows, kind):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")


def test_clock_numbers(spark):
    rows = [(5, 2359), (130, 2130), (0, 0), (130, 1930), (300, 2200), (30, 2010), (1045, 930)]
    df = indexed(spark, rows, "e int, s int")
    assert values(df.select("i", hhmm_minutes_diff("e", "s").alias("x"))) == [6, 240, 0, 90 - 1170, 180 - 1320, 30 - 1210, 75]
    assert values(df.select("i", hhmm_minutes_diff("e", "s", late_start_hour=18).alias("x"))) == [6, 240, 0, 360, 180 - 1320, 260, 75]


def test_holiday_window(spark):
    days = [dt.date(2018, 12, 22) + dt.timedelta(days=d) for d in range(8)] + [dt.date(2016, 12, 28), dt.date(2017, 1, 4), dt.date(2015, 1, 3)]
    df = indexed(spark, [(d,) for d in days], "d date")
    assert values(df.select("i", holiday_window("d").alias("x"))) == [0, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1]
    edges = indexed(spark, [(dt.date(1999, 12, 31),), (dt.date(2020, 1, 1),), (dt.date(2021, 7, 7),), (dt.date(2021, 12, 31),), (dt.date(2041, 1, 1),), (None,)], "d date")
    assert values(edges.select("i", holiday_window("d").alias("x"))) == [1, 1, 1, 1, 1, None]
    far = indexed(spark, [(dt.date(1999, 12, 1),), (dt.date(2021, 8, 1),), (dt.date(2050, 12, 25),)], "d date")
    assert values(far.select("i", holiday_window("d").alias("x"))) == [None, 0, None]
    assert federal_holidays(range(2020, 2022)) == [
        "2020-01-01", "2020-01-20", "2020-02-17", "2020-05-25", "2020-07-03", "2020-07-04", "2020-09-07", "2020-10-12", "2020-11-11", "2020-11-26", "2020-12-25",
        "2021-01-01", "2021-01-18", "2021-02-15", "2021-05-31", "2021-06-18", "2021-06-19", "2021-07-04", "2021-07-05", "2021-09-06", "2021-10-11", "2021-11-11",
        "2021-11-25", "2021-12-24", "2021-12-25"]
    assert tuple(federal_holidays(range(2015, 2020))) == FEDERAL_HOLIDAYS
    assert len(FEDERAL_HOLIDAYS) == 54 and dt.date(2014, 12, 30) in holiday_window_dates(FEDERAL_HOLIDAYS)


def test_dates_and_dirty_text(spark):
    rows = [(2015, 2, 28), (2015, 2, 30), (2016, 11, 3), (2015, 123, 5), (20155, 1, 5), (-15, 1, 5), (2015, None, 5), (2015, 1, -5)]
    df = indexed(spark, rows, "y int, m int, d int")
    assert values(df.select("i", calendar_date("y", "m", "d").alias("x"))) == [dt.date(2015, 2, 28), None, dt.date(2016, 11, 3)] + [None] * 5
    assert values(df.select("i", calendar_text("y", "m", "d").alias("x")))[2:4] == ["2016-11-03", "2015-123-05"]
    dirty = indexed(spark, [("0.02s",), ("",), (" 1.5 ",), ("T",), ("2015-31-04",), ("2015-04-30",)], "t string")
    assert values(dirty.select("i", parse_number("t").alias("x"))) == [None, None, 1.5, None, None, None]
    assert values(dirty.select("i", parse_date("t").alias("x"))) == [None] * 5 + [dt.date(2015, 4, 30)]


def test_scalar_features(spark):
    df = indexed(spark, [(15.0,), (14.9,), (None,), (2.0,)], "v double")
    assert values(df.select("i", binary_label("v").alias("x"))) == [1, 0, None, 0]
    assert values(df.select("i", text_label("v").alias("x"))) == ["Delayed", "On time", "On time", "On time"]
    assert values(df.select("i", threshold_zero("v", 3).alias("x"))) == [15.0, 14.9, 0.0, 0.0]
    assert values(df.select("i", guarded_ratio("v", F.lit(2.0)).alias("x"))) == [7.5, 7.45, 0.0, 1.0]
    assert values(df.select("i", cutoff_label("v", 15.0, strict=True).alias("x"))) == [0, 0, 0, 0]
    assert values(df.select("i", bucket_text(F.lit(2)).alias("x"))) == ["30 min"] * 4
    levels = indexed(spark, [("WN",), ("XX",), (None,)], "c string")
    assert values(levels.select("i", keep_levels("c", ["WN"], "good").alias("x"))) == ["WN", "good", "good"]


def test_haversine_and_hash(spark):
    row = spark.range(1).select(haversine_km(F.lit(33.9425), F.lit(-118.4081), F.lit(40.6399), F.lit(-73.7787)).alias("d"), haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("z")).first()
    assert row.d == pytest.approx(3974, rel=0.01) and row.z == 0
    a = spark.range(2000).select(hash_score("id").alias("s")).collect()
    b = spark.range(2000).repartition(7).select("id", hash_score("id").alias("s")).orderBy("id").collect()
    assert [r.s for r in a] == [r.s for r in b] and all(0 <= r.s < 1 for r in a)
    assert sum(r.s < 0.2 for r in a) == pytest.approx(400, abs=80)


def test_schema_operators(spark):
    df = spark.createDataFrame([("1", "0.02s", "7")], "a string, b string, `c.d` string")
    assert schema.cast_schema(df, {"b": "float", "a": "int"}).first() == (None, 1)
    assert schema.add_prefix(df, "o_").columns == ["o_a", "o_b", "o_c.d"]
    assert schema.reorder_first(df, ["b"]).columns == ["b", "a", "c.d"]
    assert schema.drop_existing(df, ["a", "zz"]).columns == ["b", "c.d"]
    with pytest.raises(ValueError):
        schema.drop_columns(df, ["zz"])
    other = spark.createDataFrame([(1, "x")], "a int, e string")
    assert schema.schema_diff(df, other) == {"only_left": ["b", "c.d"], "only_right": ["e"], "shared": ["a"], "type_changed": [("a", "string", "int")]}
    typed = spark.createDataFrame([(1, 2.0, "x")], "n int, HourlyDew double, s string")
    assert schema.numeric_columns(typed) == ["n", "HourlyDew"] and schema.string_columns(typed) == ["s"]
    assert schema.columns_like(typed, part="Dew") == ["HourlyDew"] and schema.columns_of_type(typed, T.IntegerType) == ["n"]


def test_infer_types(spark):
    rows = [("1", "1.0", "1d", "x", None), ("-2", "3", "2", "1", None), (None, "1e3", "3", "2", None)]
    got = {r.column: r.inferred for r in schema.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string")).collect()}
    assert got == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "string"}


def test_report_types(spark):
    df = spark.createDataFrame([(" SOD  ", 1), ("SOM", 2), ("FM-15 ", 3), ("SODX", 4), (None, 5)], "REPORT_TYPE string, v int")
    daily, monthly, rest = filters.split_by_report_type(df)
    assert [r.v for r in daily.collect()] == [1] and [r.v for r in monthly.collect()] == [2] and sorted(r.v for r in rest.collect()) == [3, 4, 5]


def test_filters(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, None, None), (4, 2, 1)], "i int, a int, b int")
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(filters.keep_different(df, "a", "b")) == [4]
    assert ids(filters.keep_different(df, "a", "b", null_safe=True)) == [2, 4]
    assert ids(filters.drop_where(df, F.col("a") == 1)) == [3, 4]
    assert ids(filters.drop_null_rows(df)) == [1, 4] and ids(filters.drop_null_rows(df, ["a"])) == [1, 2, 4]
    assert ids(filters.where_nulls(df, null=["b"], not_null=["a"])) == [2]
    assert ids(filters.filter_min_max(df, "i", 2, 3)) == [2, 3] and ids(filters.filter_min_max(df, "i", 3)) == [3, 4]
    assert ids(filters.first_rows(df, 2, F.col("i").desc())) == [3, 4]
    assert [tuple(r) for r in filters.top_groups(df.fillna(0), "a", "i", 1).collect()] == [(2, 4.0)]


def nulls_small(spark):
    rows = [(None, None if i < 9 else 1.0, None if i < 8 else 1.0, math.nan if i == 0 else 1.0, dt.datetime(2020, 1, 1), None if i < 5 else "x") for i in range(10)]
    return spark.createDataFrame(rows, "empty double, n90 double, n80 double, nan double, t timestamp, s string")


def test_null_profile(spark):
    df = nulls_small(spark)
    shares = {r.column: r.null_percent for r in profile.null_profile(df).collect()}
    assert shares == {"empty": 100.0, "n90": 90.0, "n80": 80.0, "nan": 10.0, "s": 50.0}
    assert profile.null_percent(df, "n80").first()[0] == pytest.approx(80.0)
    assert profile.drop_by_null_percent(df, 90).columns == ["n80", "nan", "t", "s"]
    assert profile.drop_by_null_percent(df, 90, inclusive=False).columns == ["n90", "n80", "nan", "t", "s"]
    assert profile.drop_by_null_percent(df, 80, inclusive=False).columns == ["n80", "nan", "t", "s"]
    assert profile.drop_empty_columns(df).columns == ["n90", "n80", "nan", "t", "s"]
    kept = {r.column for r in profile.coverage_keep(df.withColumnRenamed("n90", "DailySnow")).collect()}
    assert kept == {"DailySnow", "nan", "t", "s"}


def test_describe(spark):
    df = spark.createDataFrame([(1, "a"), (3, None)], "n int, s string")
    rows = {r.column: tuple(r)[1:] for r in profile.describe_table(df).collect()}
    assert rows == {"n": (2, 2.0, pytest.approx(math.sqrt(2)), "1", "3"), "s": (1, None, None, "a", "a")}


def fill_small(spark):
    day = lambda d: None if d is None else dt.datetime(2020, 1, d)
    rows = [("p", 1, None), ("p", 2, 5.0), ("p", 4, None), ("p", 9, 7.0), ("p", 20, None), ("q", 3, None), ("q", 5, 2.0), ("q", None, None), (None, 1, 8.0), (None, 30, None)]
    return spark.createDataFrame([(i, s, day(d), v) for i, (s, d, v) in enumerate(rows)], "i int, st string, d timestamp, v double")


def test_forward_fill(spark):
    filled = fills.forward_fill(fill_small(spark), ["st"], "d", ["v"], "i")
    assert filled.columns == ["i", "st", "d", "v"]
    assert values(filled, "v") == [None, 5.0, 5.0, 7.0, 7.0, None, 2.0, None, 8.0, 8.0]
    hourly = fills.forward_fill(fill_small(spark), ["st"], "d", ["v"], "i", bin_seconds=3600)
    assert values(hourly, "v") == values(filled, "v")


def test_fill_first_is_the_earliest_value(spark):
    df = fill_small(spark).filter("st = 'p' or st = 'q'")
    assert values(fills.fill_first(df, ["v"], "d", "i"), "v") == [None, 5.0, 5.0, 7.0, 5.0, 5.0, 2.0, 5.0]


def test_zero_fills_and_tracker(spark):
    df = spark.createDataFrame([(i, None if i == 0 else 1.0, None if i < 5 else 2.0) for i in range(200)], "i int, few double, more double")
    sparse = fills.fill_zero_if_sparse(df, ["few", "more"], 1.0)
    assert sparse.filter("few is null").count() == 0 and sparse.filter("more is null").count() == 5
    tracked = {r.column: (r.null_percent_before, r.null_percent_after) for r in fills.track_imputation(df, sparse, ["few", "more"], "s").collect()}
    assert tracked == {"few": (0.5, 0.0), "more": (2.5, 2.5)}
    assert fills.fill_zero(df, ["more"]).filter("more is null").count() == 0
