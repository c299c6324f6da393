from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.operators.gram import correlation_matrix
from lagline.operators import groups, stats

BASE = dt.datetime(2020, 1, 1)


def test_lag_one_autocorrelation(spark):
    rng = random.Random(2)
    data = {"four": 4, "five": 5, "many": 60}
    rows, series = [], {}
    for k, n in data.items():
        series[k] = [float(rng.randrange(40)) for _ in range(n)]
        rows += [(len(rows) + i, k, BASE + dt.timedelta(minutes=24 * i), v) for i, v in enumerate(series[k])]
    rows += [(1000 + i, "flat", BASE + dt.timedelta(minutes=i), 3.0) for i in range(6)] + [(2000, "five", None, 1.0)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v double")
    got = {r.k: r.autocorrelation for r in stats.group_autocorrelation(df, ["k"], "ts", "v", "id").collect()}
    want = {k: np.corrcoef(s[1:], s[:-1])[0, 1] for k, s in series.items() if k != "four"}
    assert got.pop("flat") is None
    assert got == pytest.approx(want)


def test_previous_value_across_bins(spark):
    rows = [(i, "k" if i % 2 else None, BASE + dt.timedelta(hours=(i * 7) % 90), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v double")
    got = {r.id: r.p for r in stats.with_previous(df, ["k"], "ts", "v", "p", "id").collect()}
    want = {}
    for key in ("k", None):
        ordered = sorted((t, i, v) for i, k, t, v in rows if k == key)
        want |= {b[1]: a[2] for a, b in zip([(0, 0, None), *ordered], ordered)}
    assert got == want


def test_autocorrelation_function(spark):
    rng = random.Random(4)
    x = [rng.random() for _ in range(40)]
    df = spark.createDataFrame([(BASE + dt.timedelta(days=i, hours=h), v) for i, v in enumerate(x) for h in (1, 5)], "ts timestamp, v double")
    d = np.array(x) - np.mean(x)
    got = {r.lag: r.autocorrelation for r in stats.autocorrelation_function(df, "ts", "v", 10).collect()}
    assert got == pytest.approx({k: float((d[:-k] * d[k:]).sum() / (d * d).sum()) for k in range(1, 11)})


def test_histogram_equals_numpy(spark):
    rng = random.Random(8)
    x = [rng.gauss(0, 5) for _ in range(500)]
    df = spark.createDataFrame([("g", v) for v in x] + [("one", 2.0), ("one", 2.0), ("g", None)], "k string, v double")
    rows = stats.histogram(df, "v", 20, ["k"]).collect()
    counts, edges = np.histogram(x, 20)
    assert {r.bucket: r.n for r in rows if r.k == "g"} == {i: c for i, c in enumerate(counts) if c}
    assert [(r.bucket, r.n) for r in rows if r.k == "one"] == [(0, 2)]
    assert min(r.low for r in rows if r.k == "g") == pytest.approx(edges[0])


def test_correlations_and_z(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.random()) for _ in range(100)]
    df = spark.createDataFrame(rows, "HourlyA double, HourlyB double, other double")
    want = np.corrcoef(np.array(rows).T)
    got = {(r.a, r.b): r.r for r in stats.pairwise_correlation(df, df.columns).collect()}
    assert got == pytest.approx({("HourlyA", "HourlyB"): want[0, 1], ("HourlyA", "other"): want[0, 2], ("HourlyB", "other"): want[1, 2]})
    lower = stats.family_correlation(df, "Hourly").collect()
    assert [(r.row_name, r.column_name) for r in lower] == [("HourlyB", "HourlyA")]
    z = stats.z_scores(df, ["other"]).agg(F.avg("other_z").alias("m"), F.stddev_samp("other_z").alias("s")).first()
    assert (z.m, z.s) == (pytest.approx(0, abs=1e-9), pytest.approx(1))


def test_dependencies(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, None), ("b", 2, 1), ("c", None, 1), ("c", None, 2)], "k string, x int, y int")
    assert sorted(map(tuple, groups.inconsistent_columns(df, "k", "x").collect())) == [("b", 2)]
    assert sorted(map(tuple, groups.inconsistent_columns(df, "k", "x", "y").collect())) == [("b", 2), ("c", 2)]
    assert [r.k for r in groups.multiple_associations(df, "k", "y").collect()] == ["c"]
    assert groups.percent_different(df, "x", "y").first()[0] == pytest.approx(100 / 6)


def test_inventories(spark):
    df = spark.createDataFrame([(2015, "A"), (2015, "B"), (2016, "A"), (2016, "A"), (2017, None)], "y int, c string")
    assert sorted(map(tuple, groups.missing_categories(df, "y", "c").collect())) == [(2016, "B")]
    assert [tuple(r) for r in groups.category_sets(df, ["y"], "c").collect()] == [(2015, ["A", "B"], 2), (2016, ["A"], 1)]


def test_absence_runs_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(0, 200, 3)]), rng.choice(["a", "b", "c", None])) for _ in range(70)] + [(5, "rare"), (5, "rare")]
    df = spark.createDataFrame(rows, "t int, c string")
    for bucket in (1, 4, 1 << 15):
        runs = groups.absence_runs(df, "t", "c", bucket=bucket).collect()
        seen = {(t, c) for t, c in rows if t is not None and c is not None}
        periods = sorted({t for t, _ in seen})
        missing = {(t, c) for t in periods for c in {c for _, c in seen}} - seen
        listed = [(t, r.absent) for r in runs for t in periods if r.first <= t <= r.last]
        assert len(listed) == len(set(listed)) == sum(r.periods for r in runs) and set(listed) == missing
        # longest: no two runs of a category are next to each other
        ends = {(r.absent, periods.index(r.last)) for r in runs}
        assert not any((r.absent, periods.index(r.first) - 1) in ends for r in runs)
    assert {tuple(r) for r in groups.missing_categories(df, "t", "c").collect()} == missing
    assert groups.absence_runs(df.limit(0), "t", "c").count() == 0


def test_delay_accounting(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 0, 1), (None, 1, 1), (None, 0, 0), (5, 1, 0)], "v int, c int, d int")
    row = groups.null_accounting(df, "v", cancelled=F.col("c") == 1, diverted=F.col("d") == 1).first()
    assert tuple(row) == (4, 2, 1, 1)
    parts = spark.createDataFrame([(5, 5), (0, 5), (None, 5), (2, 2)], "p int, t int")
    assert tuple(groups.delay_component_shares(parts, "p", "t").first()) == (75.0, 50.0, 50.0)


def test_utc_offsets(spark):
    at = lambda h: BASE + dt.timedelta(hours=h)
    known = spark.createDataFrame([("s1", "CA", at(0), at(8)), ("s1", "CA", at(1), at(8)), ("s2", "CA", None, at(8)), ("s3", "HI", None, at(8))], "st string, state string, loc timestamp, utc timestamp")
    offsets = stats.utc_offsets(known, "st", "state", "loc", "utc")
    assert {r.st: r.offset_seconds for r in offsets.collect()} == {"s1": -7 * 3600, "s2": -7 * 3600, "s3": None}
    rows = spark.createDataFrame([("s2", at(3)), ("s3", at(3))], "st string, loc timestamp")
    moved = {r.st: r.us for r in stats.apply_utc_offsets(rows, offsets, "st", "loc", "us").collect()}
    want = int((at(10) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert moved == {"s2": want, "s3": None}


def test_wide_correlations_equal_the_plain_ones(spark):
    rng = random.Random(6)
    names = [f"c{i}" for i in range(12)]
    make = lambda i: [None if rng.random() < i / 20 else 1e9 * (i % 3) + rng.gauss(i, 1 + i) for _ in range(300)]
    columns = [make(i) for i in range(9)] + [[7.0] * 300, [None] * 300, [0.1 if i % 2 else None for i in range(300)]]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{n} double" for n in names)).repartition(3)
    plain = {(r.a, r.b): r.r for r in stats.pairwise_correlation(df, names).collect()}
    wide = {(r.a, r.b): r for r in correlation_matrix(df, names).collect()}
    assert wide.keys() == plain.keys()
    for (a, b), r in wide.items():
        both = [1 for x, y in zip(columns[names.index(a)], columns[names.index(b)]) if x is not None and y is not None]
        assert r.n == len(both)
        if {a, b} & {"c9", "c10", "c11"}:
            assert r.r is None  # constant or unknown
        else:
            assert r.r == pytest.approx(plain[a, b], abs=1e-6)
    assert {(r.column_name, r.row_name) for r in stats.family_correlation(df, "c").collect()} == plain.keys()
    assert all(r.n == 0 and r.r is None for r in correlation_matrix(df.limit(0), names).collect())


def test_sketches_estimate_any_range(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 10).cast("int").alias("day"), (F.col("id") % 7_000).alias("v"))
    sketches = groups.distinct_sketches(df, ["k"], "day", "v")
    for first, last in ((0, 9), (2, 4), (5, 5), (11, 12)):
        exact = {r.k: r.n_v for r in groups.distinct_counts(df.where(F.col("day").between(first, last)), ["k"], ["v"]).collect()}
        got = {r.k: r.n for r in groups.distinct_in_range(sketches, ["k"], first, last).collect()}
        assert got.keys() == exact.keys() and all(got[k] == pytest.approx(exact[k], rel=0.05) for k in exact)
    rough = groups.distinct_counts(df, ["k"], ["v"], approximate=True).first()
    assert rough.n_v == pytest.approx(6667, rel=0.15)
