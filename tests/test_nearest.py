"""Nearest stations against brute force."""

from __future__ import annotations

import math
import random
import re

import pytest

from lagline.operators import nearest


def km(a, b):
    (la, lo), (lb, lp) = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return round(math.asin(min(1.0, math.sqrt(h))) * 2 * 6371.0088, 6)


def crowded(rng):
    """A third of the stations within a few hundred metres, some at the poles and on both sides of the date line, some twice."""
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    spots += [(48.1 + rng.uniform(0, 3e-3), 11.5 + rng.uniform(0, 3e-3)) for _ in range(150)]
    spots += [(90.0, 0.0), (90.0, 77.0), (-90.0, -180.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.999), (10.0, -179.999), (1e-9, 0.0)]
    return spots + rng.sample(spots, 30)


@pytest.mark.parametrize("leaf", [1, 32])
def test_nearest_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    rng = random.Random(leaf)
    spots = crowded(rng)
    asked = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)] + rng.sample(spots, 40)
    asked += [(48.1015, 11.5015), (90.0, 5.0), (-90.0, 5.0), (0.0, 180.0), (10.0, 180.0), (10.0, -180.0), (48.1, 11.5)] * 2
    stations = spark.createDataFrame([(i, *s, "x") for i, s in enumerate(spots)] + [(-1, None, 3.0, "x"), (-2, 91.0, 0.0, "x")], "id int, la double, lo double, nearest string")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)] + [(900, None, 1.0), (901, 3.0, float("nan")), (902, 5.0, 181.0)], "n int, lat double, lon double")
    got = {r.n: (r.nearest, r.distance_km) for r in nearest.nearest_station(points, stations, "lat", "lon", "id", "la", "lo").collect()}
    assert len(got) == len(asked) + 3 and {got[900], got[901], got[902]} == {(None, None)}
    for n, p in enumerate(asked):
        want = min((km(p, s), i) for i, s in enumerate(spots))
        assert got[n] == (want[1], pytest.approx(want[0], abs=2e-6)) or abs(km(p, spots[got[n][0]]) - want[0]) <= 2e-6, (p, got[n], want)


def test_no_stations_and_no_points(spark):
    stations = spark.createDataFrame([(7, 1.0, 2.0)], "id long, la double, lo double")
    points = spark.createDataFrame([(1, 3.0, 4.0)], "n int, lat double, lon double")
    ask = lambda p, s: nearest.nearest_station(p, s, "lat", "lon", "id", "la", "lo")
    assert ask(points, stations.limit(0)).select("nearest", "distance_km").first() == (None, None)
    assert ask(points, stations).first().nearest == 7
    assert ask(points.limit(0), stations).count() == 0


def test_plan_crosses_nothing(spark):
    rng = random.Random(9)
    stations = spark.createDataFrame([(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(300)], "id int, la double, lo double")
    points = spark.createDataFrame([(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(30)], "n int, lat double, lon double")
    plan = nearest.nearest_station(points, stations, "lat", "lon", "id", "la", "lo")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_is_gathered_per_point(spark):
    rng = random.Random(3)
    at = lambda n: [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(n)]
    stations = spark.createDataFrame(at(300), "id int, la double, lo double")
    found = nearest.nearest_station(spark.createDataFrame(at(50), "n int, lat double, lon double"), stations, "lat", "lon", "id", "la", "lo")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ObjectHashAggregate\(keys=\[[^\]]*lat#", plan)
