from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lagline.operators.joins import (
    add_group_stats, asof_join, asof_join_both_ends, attach_lookup, duplicate_keys, join_predictions, missing_from_lookup,
    nearest_neighbor, next_day_join, used_only,
)

BASE = dt.datetime(2024, 3, 1, 0, 0, 0)
HOUR = 3600
at = lambda s: None if s is None else BASE + dt.timedelta(seconds=s)


def sides(spark, events, observations):
    e = spark.createDataFrame([(i, k, at(s)) for i, (k, s) in enumerate(events)], "id long, st string, ts timestamp")
    o = spark.createDataFrame([(i, k, at(s), float(i)) for i, (k, s) in enumerate(observations)], "oid long, station string, ots timestamp, temp double")
    return e, o


def brute(events, observations):
    out = {}
    for i, (k, s) in enumerate(events):
        fits = [(t, j) for j, (q, t) in enumerate(observations) if k is not None and s is not None and q == k and t is not None and s - 4 * HOUR <= t < s - 3 * HOUR]
        out[i] = max(fits)[1] if fits else None
    return out


def test_bounds_duplicates_and_nulls(spark):
    t = 10 * HOUR
    events = [("x", t), ("x", t), ("y", t), (None, t), ("z", t), ("x", None), ("w", t)]
    observations = [
        ("x", t - 4 * HOUR), ("y", t - 3 * HOUR), (None, t - 4 * HOUR + 60), ("z", t - 4 * HOUR + 60), ("z", t - 4 * HOUR + 60),
        ("w", t - 4 * HOUR - 1), ("x", None),
    ]
    e, o = sides(spark, events, observations)
    got = {r.id: r.oid for r in asof_join(e, o, "ts", "ots", "st", "station", tie_break="oid").collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: None, 4: 4, 5: None, 6: None}
    assert got == brute(events, observations)


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    key = lambda: rng.choice(["a", "b", None])
    events = [(key(), rng.randrange(0, 200) * 600) for _ in range(150)]
    observations = [(key(), rng.randrange(0, 200) * 600) for _ in range(150)]
    e, o = sides(spark, events, observations)
    got = {r.id: r.oid for r in asof_join(e, o, "ts", "ots", "st", "station", tie_break="oid").collect()}
    assert got == brute(events, observations)


def test_both_ends(spark):
    e = spark.createDataFrame([(1, "x", "y", at(5 * HOUR))], "id long, o string, d string, ts timestamp")
    _, o = sides(spark, [], [("x", HOUR + 60), ("y", HOUR + 120)])
    row = asof_join_both_ends(e, o, "ts", "ots", {"origin_": "o", "dest_": "d"}, "station", "oid").first()
    assert (row.origin_oid, row.dest_oid, row.origin_station, row.dest_station) == (0, 1, "x", "y")


def test_same_column_names_are_refused(spark):
    e, _ = sides(spark, [("x", 0)], [("x", 0)])
    with pytest.raises(ValueError):
        asof_join(e, e, "ts", "ts", "st", "st")


def test_next_day_join(spark):
    e, _ = sides(spark, [("x", 30 * HOUR), ("x", HOUR), ("q", 30 * HOUR)], [("x", 0)])
    daily = spark.createDataFrame([("x", BASE.date(), 7.0)], "dk string, day date, snow double")
    got = {r.id: r.snow for r in next_day_join(e, daily, "st", F.col("ts"), "dk", "day").collect()}
    assert got == {0: 7.0, 1: None, 2: None}


def test_lookups(spark):
    rows = spark.createDataFrame([(2015, "A"), (2015, "Z"), (2016, "Z"), (2016, "Z"), (2016, None)], "y int, c string")
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "code string, name string")
    assert sorted(map(tuple, missing_from_lookup(rows, "c", names, "code", ["y"]).collect())) == [(2015, "Z"), (2016, "Z")]
    assert sorted(map(tuple, used_only(names, "code", rows, "c").collect())) == [("A", "Alpha")]
    named = attach_lookup(rows, "c", names, "code", ["name"])
    assert named.count() == 5 and named.filter("name = 'Alpha'").count() == 1


def test_group_stats_keep_null_groups(spark):
    rows = spark.createDataFrame([("r", 1), ("r", 2), (None, 3), ("s", 4)], "k string, v int")
    got = {(r.k, r.v): (r.n, r.d) for r in add_group_stats(rows, ["k"], n=F.count(F.lit(1)), d=F.countDistinct("v")).collect()}
    assert got == {("r", 1): (2, 2), ("r", 2): (2, 2), (None, 3): (1, 1), ("s", 4): (1, 1)}


def test_predictions(spark):
    a = spark.createDataFrame([(1, "t", 0.1), (2, "t", 0.2)], "ts int, tail string, p1 double")
    b = spark.createDataFrame([(1, "t", 0.3), (1, "t", 0.4)], "ts int, tail string, p2 double")
    once = b.filter("p2 < 0.35")
    assert sorted(map(tuple, join_predictions([a, once], ["ts", "tail"]).collect())) == [(1, "t", 0.1, 0.3)]
    with pytest.raises(Exception, match="more than once"):
        join_predictions([a, b], ["ts", "tail"]).collect()
    assert [tuple(r) for r in duplicate_keys(b, ["ts", "tail"]).collect()] == [(1, "t", 2)]


def test_nearest(spark):
    pairs = spark.createDataFrame([("a", 3, 2.0), ("a", 1, 2.0), ("a", 9, 5.0), ("b", 4, 0.5)], "k string, s int, d double")
    assert sorted(map(tuple, nearest_neighbor(pairs, "k", "s", "d").collect())) == [("a", 1, 2.0), ("b", 4, 0.5)]
