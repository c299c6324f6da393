from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.operators import ranks
from lagline.operators.folds import assign_blocks, block_bounds, block_frames
from lagline.operators.ranks import boxplot_stats, exact_quantiles, percent_ranks, row_number_folds, value_ranks, values_at, with_percent_rank
from lagline.operators.sampling import balance_by_keep, balance_by_ratio, hash_split, sample_at_most, sample_exactly
from lagline.functions.scalars import hash_score
from lagline.session import materialize


@pytest.mark.parametrize("distinct", [1, 2, 40, 5000])
def test_percent_rank_equals_the_window(spark, distinct):
    rng = random.Random(distinct)
    # A third of all rows share one value.
    rows = [(i, 7 if rng.random() < 1 / 3 else rng.randrange(distinct)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v int")
    want = {r.id: r.p for r in df.select("id", F.percent_rank().over(W.orderBy("v")).alias("p")).collect()}
    got = {r.id: r.percent_rank for r in with_percent_rank(df, "v").collect()}
    assert got == want


def test_nulls_and_tiny_tables(spark):
    df = spark.createDataFrame([(None,), (None,), (3,), (5,)], "v int")
    assert sorted(((r.v, r.n, r.n_before) for r in value_ranks(df, "v").collect()), key=str) == [(3, 1, 2), (5, 1, 3), (None, 2, 0)]
    one = spark.createDataFrame([(4,)], "v int")
    assert [tuple(r) for r in percent_ranks(one, "v").collect()] == [(4, 1, 0.0)]
    assert percent_ranks(one.filter("v > 9"), "v").collect() == []


def test_ranks_per_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = sorted(((r.k, r.v, r.b) for r in df.select("k", "v", (F.rank().over(W.partitionBy("k").orderBy("v")) - 1).alias("b")).collect()), key=str)
    assert sorted(((r.k, r.v, r.n_before) for r in value_ranks(df, "v", ["k"], buckets=8).collect()), key=str) == want


def test_ranges_grow_with_the_rows_and_split_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ranks, "_RANGE_ROWS", 100)
    rng = random.Random(11)
    # Key "a" holds most values, null keys and null values occur, and value 1.5 has a third of the rows.
    data = [("a", 1.5 if i % 3 == 0 else rng.random() * 9) for i in range(1500)] + [(rng.choice([None, "b", "c"]), rng.choice([None, -0.0, float("inf"), 2.0])) for _ in range(90)]
    df = spark.createDataFrame(data, "k string, v double")
    want = sorted(((r.k, r.v, r.b) for r in df.select("k", "v", (F.rank().over(W.partitionBy("k").orderBy("v")) - 1).alias("b")).distinct().collect()), key=str)
    made = []
    monkeypatch.setattr(ranks, "materialize", lambda rows, name: made.append(materialize(rows, name)) or made[-1])
    ranked = value_ranks(df, "v", ["k"])
    assert sorted(((r.k, abs(r.v) if r.v == 0 else r.v, r.n_before) for r in ranked.collect()), key=str) == sorted(((k, abs(v) if v == 0 else v, b) for k, v, b in want), key=str)
    sizes = {r["__range"]: r["count"] for r in made[-1].groupBy("__range").count().collect()}
    assert len(sizes) >= 10 and max(sizes.values()) <= 200
    assert made[-1].where("k = 'a'").select("__range").distinct().count() >= 9


def test_quantiles_equal_numpy(spark):
    rng = random.Random(6)
    data = {k: [rng.choice([1.0, 2.0, rng.random() * 50]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 501))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    for r in exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), ["k"]).collect():
        assert r.quantile == pytest.approx(np.quantile(data[r.k], r.probability)), (r.k, r.probability)


def test_decimals(spark):
    df = spark.createDataFrame([(i, f"{i % 10}.5") for i in range(40)], "i int, s string").select(F.col("s").cast("decimal(12,2)").alias("v"))
    assert exact_quantiles(df, "v", (0.5,)).first().quantile == 5.0
    assert {(str(r.v), r.n_before) for r in value_ranks(df, "v").collect()} == {(f"{i}.50", 4 * i) for i in range(10)}
    with pytest.raises(ValueError):
        values_at(df, "v", {"first": lambda n: F.lit(0)})


def test_boxplot(spark):
    df = spark.createDataFrame([(float(v), 1) for v in [*range(1, 12), 100]], "v double, c int")
    row = {r.column: r for r in boxplot_stats(df, ["v", "c"]).collect()}["v"]
    assert (row.q1, row.median, row.q3) == (3.75, 6.5, 9.25) and (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 11.0, 1)


def test_block_bounds():
    bounds = block_bounds(5, 0.8)
    train = [b for b in bounds if b.role == "train"]
    assert train[0].low == 0 and all(a.high == b.low for a, b in zip(train, train[1:]))
    assert bounds[-1].role == "validation" and bounds[-1].high == pytest.approx(1.0)
    assert bounds[1].high - bounds[1].low == pytest.approx(0.04)


@pytest.mark.parametrize("blocks, split", [(3, 0.8), (5, 0.7), (1, 0.5)])
def test_blocks_equal_percent_rank_filters(spark, blocks, split):
    rng = random.Random(blocks)
    base = dt.datetime(2020, 1, 1)
    rows = [(i, None if i % 40 == 0 else base + dt.timedelta(hours=rng.randrange(150))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    ranked = df.select("id", F.percent_rank().over(W.orderBy("ts")).alias("p")).collect()
    want = set()
    for b in block_bounds(blocks, split):
        want |= {(r.id, b.fold, b.role) for r in ranked if (r.p >= b.low if b.role == "train" else r.p > b.low) and r.p <= b.high}
    assert {(r.id, r.fold, r.role) for r in assign_blocks(df, "ts", blocks, split).collect()} == want
    frames = block_frames(df, "ts", blocks, split)
    got = {(r.id, i, role) for i, pair in enumerate(frames) for role, part in zip(("train", "validation"), pair) for r in part.collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 7, 101])
def test_blocks_of_evenly_spaced_rows(spark, n):
    """Percentiles that hit the bounds exactly or miss them by a rounding step."""
    df = spark.range(n)
    ranked = df.select("id", F.percent_rank().over(W.orderBy("id")).alias("p")).collect()
    for blocks, split in ((2, 1.0), (10, 0.5)):
        want = {(r.id, b.fold, b.role) for b in block_bounds(blocks, split) for r in ranked if (r.p >= b.low if b.role == "train" else r.p > b.low) and r.p <= b.high}
        assert {(r.id, r.fold, r.role) for r in assign_blocks(df, "id", blocks, split).collect()} == want, (blocks, split)


def test_values_at(spark):
    rng = random.Random(4)
    data = {k: [rng.choice([None, 3, rng.randrange(1000)]) for _ in range(n)] for k, n in (("a", 1), ("b", 50), (None, 700))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v int")
    places = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "none": lambda n: n}
    got = {(r.k, r.id): r.value for r in values_at(df, "v", places, ["k"], buckets=8).collect()}
    want = {}
    for k, vs in data.items():
        ordered = sorted(vs, key=lambda v: (v is not None, v))
        want |= {(k, "first"): ordered[0], (k, "middle"): ordered[len(vs) // 2], (k, "last"): ordered[-1]}
    assert got == want
    overall = {r.id: r.value for r in values_at(df, "v", places, buckets=8).collect()}
    ordered = sorted((v for vs in data.values() for v in vs), key=lambda v: (v is not None, v))
    assert overall == {"first": ordered[0], "middle": ordered[len(ordered) // 2], "last": ordered[-1]}


def test_row_on_a_boundary_is_in_two_train_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "t int")  # percentiles 0, 0.1, ... 1
    folds = assign_blocks(df, "t", 2, 1.0).filter("role = 'train' and t = 5")
    assert sorted(r.fold for r in folds.collect()) == [0, 1]


def test_row_number_folds(spark):
    df = spark.range(103).withColumn("id", F.col("id") * 7)
    sizes = {r.fold: r["count"] for r in row_number_folds(df, "id", 5).groupBy("fold").count().collect()}
    assert sum(sizes.values()) == 103 and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5


def test_no_window_over_the_whole_table(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 50)
    for built in (with_percent_rank(df, "v"), assign_blocks(df, "v", 3)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        # The only single-partition windows see one row per bucket.
        for line in plan.splitlines():
            assert not ("Window" in line and "percent_rank" in line)


def test_sampling(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    kept = balance_by_keep(df, "label", hash_score("id"), 0.2)
    assert kept.filter("label = 1").count() == 1000 and kept.filter("label = 0").count() == pytest.approx(800, abs=120)
    even = balance_by_ratio(df, "label", hash_score("id"))
    assert even.filter("label = 1").count() == 1000 and even.filter("label = 0").count() == pytest.approx(1000, abs=130)
    assert sample_at_most(df, "id", 10**6).count() == 5000 and sample_at_most(df, "id", 500).count() == pytest.approx(500, abs=90)
    train, rest = hash_split(df, "id")
    assert train.count() + rest.count() == 5000 and train.intersect(rest).count() == 0


@pytest.mark.parametrize("gathered", [0, 50_000])
def test_order_statistics_are_exact(spark, monkeypatch, gathered):
    """Ties, one value only, few values, nulls and infinities; with nothing gathered, brackets close by counting alone."""
    monkeypatch.setattr(ranks, "_GATHERED", gathered)
    monkeypatch.setattr(ranks, "_GRID", 8)
    rng = random.Random(gathered)
    columns = {
        "a": [rng.gauss(0, 1) for _ in range(900)], "b": [float(rng.choice([1, 2, 2, 2, 7])) for _ in range(900)], "c": [5.0] * 900,
        "d": [None if rng.random() < 0.3 else rng.expovariate(1) for _ in range(900)], "e": [None] * 899 + [3.0], "f": [None] * 900,
        "g": [float("inf"), float("-inf"), 0.0] * 300,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    places = {str(p): (lambda size, p=p: F.floor((size - 1) * p)) for p in (0, 0.1, 0.25, 0.5, 0.9, 0.999, 1)} | {"outside": lambda size: size}
    for nulls_first in (False, True):
        got = {(c, i): (at, size, v) for c, i, at, size, v in ranks.order_statistics(df, {c: F.col(c) for c in columns}, places, nulls_first)}
        for c, values in columns.items():
            known = sorted(v for v in values if v is not None)
            every = [None] * (900 - len(known)) + known if nulls_first else known
            for p in (0, 0.1, 0.25, 0.5, 0.9, 0.999, 1):
                at = int((len(every) - 1) * p)
                assert got.get((c, str(p))) == ((at, len(every), every[at]) if every else None)
            assert (c, "outside") not in got


def test_exact_samples(spark):
    df = spark.range(3000).select("id", (F.col("id") % 5).alias("v"))
    sample = {n: {r.id for r in sample_exactly(df, "id", n).collect()} for n in (0, 1, 10, 500, 2999, 3000, 9000)}
    assert [len(s) for s in sample.values()] == [0, 1, 10, 500, 2999, 3000, 3000]
    assert sample[10] < sample[500] < sample[2999]
    assert {r.id for r in sample_exactly(df.repartition(7), "id", 500).collect()} == sample[500] != {r.id for r in sample_exactly(df, "id", 500, seed=1).collect()}
    # rows that share their key, and so their whole hash
    same = spark.range(100).select(F.lit("k").alias("key"), "id")
    assert sample_exactly(same, "key", 30).count() == 30 and sample_exactly(same.limit(0), "key", 5).count() == 0
