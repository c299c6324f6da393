from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lagline.session import ensure_checkpoint_dir, materialize
from lagline.operators.joins import join_predictions
from lagline.sources import sinks, tables
from lagline.streaming import ingest
from lagline.streaming.ingest import hourly_counts, ingest_by_hour, ingest_compacted, read_ingested, stream_parquet


def test_parquet_modes_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2018), (2, 2019)], "v int, YEAR int")
    sinks.write_parquet(df, path, partition_by=["YEAR"])
    with pytest.raises(Exception, match="already exists"):
        sinks.write_parquet(df, path)
    sinks.write_parquet(df.unionByName(df), path, mode="overwrite", partition_by=["YEAR"])
    pruned = tables.read_parquet(spark, path).filter("YEAR = 2019")
    assert [r.v for r in pruned.collect()] == [2, 2]
    assert "PartitionFilters: [isnotnull(YEAR" in pruned._jdf.queryExecution().executedPlan().toString()


def test_glob_with_date_filter_reaches_the_scan(spark, tmp_path):
    for i in (1, 2):
        spark.createDataFrame([(i, dt.date(2015, i, 1))], "v int, DATE date").write.parquet(str(tmp_path / f"w{i}.parquet"))
    df = tables.read_parquet_before(spark, str(tmp_path / "w*.parquet"), "DATE", dt.date(2015, 2, 1))
    assert [r.v for r in df.collect()] == [1]
    assert "LessThan(DATE" in df._jdf.queryExecution().executedPlan().toString()


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    path = str(tmp_path / "x.csv")
    assert tables.read_csv(spark, path).dtypes == [("a", "string"), ("b", "string")]
    assert tables.read_csv(spark, path, infer=True).dtypes == [("a", "int"), ("b", "string")]
    assert tables.read_csv(spark, path, schema="a bigint, b string").collect()[1] == (2, None)
    sinks.write_metric_csv(tables.rows_to_table(spark, [(0.3, 5)], "Cutoff double, TP long"), str(tmp_path / "m"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "m"), schema="Cutoff double, TP long").collect()] == [(0.3, 5)]


def test_votes_and_names(spark, tmp_path):
    votes = tables.rows_to_table(spark, [("a", 3), ("4: ORIGIN = ORD", 1)], "feature string, votes int")
    sinks.write_votes(votes, str(tmp_path / "v"))
    assert [tuple(r) for r in tables.read_votes(spark, str(tmp_path / "v"), 2).collect()] == [("a", 3)]
    (tmp_path / "o.json").write_text(json.dumps({"a": 3, "2: DAY_OF_WEEK = 01": 2}))
    assert sorted(map(tuple, tables.read_votes_object(spark, str(tmp_path / "o.json")).collect())) == [("2: DAY_OF_WEEK = 01", 2), ("a", 3)]
    (tmp_path / "n.csv").write_text("x, y,z\n")
    assert [tuple(r) for r in tables.read_name_list(spark, str(tmp_path / "n.csv")).collect()] == [(0, "x"), (1, "y"), (2, "z")]


def test_text_fields(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1\t2\n3\t4\n")
    fields = tables.split_text_lines(spark, str(tmp_path / "in.txt"))
    sinks.write_text_fields(fields, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\t2", "3\t4"]


def test_materialize_cuts_lineage(spark):
    kept = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert kept.count() == 10 and "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = lambda a, b: spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 3)) for i in range(a, b)], "id int, ts timestamp")
    rows(0, 10).write.parquet(source)
    run = lambda: ingest_by_hour(stream_parquet(spark, source, spark.read.parquet(source).schema), "ts", out, state).awaitTermination()
    run()
    rows(10, 15).write.mode("append").parquet(source)
    run()
    run()
    # three batches at most, each with at most four files an hour however many files and tasks it read
    assert all(len(list((tmp_path / "out").glob(f"hour={h}/*.parquet"))) <= 8 for h in ("2024-01-01-00", "2024-01-01-01", "2024-01-01-02"))
    stored = spark.read.schema("id int, hour string").parquet(out)
    assert sorted(r.id for r in stored.collect()) == list(range(15))
    assert {r.hour: r.n for r in hourly_counts(stored).collect()} == {"2024-01-01-00": 5, "2024-01-01-01": 5, "2024-01-01-02": 5}


def test_bucketed_tables_join_and_group_without_a_shuffle(spark, tmp_path):
    left = spark.range(500).select((F.col("id") * 7 % 501).alias("a key"), F.col("id").alias("x"))
    right = spark.range(400).select(F.col("id").alias("a key"), (F.col("id") * 2).alias("y"), F.lit(dt.datetime(2020, 1, 1)).alias("t"))
    for name, df in (("l", left), ("r", right)):
        sinks.write_bucketed(df, str(tmp_path / name), ["a key"], 4)
        assert len(list((tmp_path / name).glob("*.parquet"))) <= 4
    l, r = (tables.read_bucketed(spark, str(tmp_path / name)) for name in ("l", "r"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, grouped = join_predictions([l, r], ["a key"]), l.groupBy("a key").agg(F.sum("x").alias("s"))
        for df in (joined, grouped):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        want = join_predictions([left, right], ["a key"])
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect())) and joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="already exists"):
        sinks.write_bucketed(left, str(tmp_path / "l"), ["a key"], 4)
    sinks.write_bucketed(right.limit(0), str(tmp_path / "l"), ["a key"], 2, mode="overwrite")
    assert tables.read_bucketed(spark, str(tmp_path / "l")).collect() == []


def test_compacting_ingest_bounds_files_over_many_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shape = "id int, ts timestamp"
    rows = [(i, None if i % 10 == 9 else dt.datetime(2024, 1, 1, i % 3)) for i in range(60)]
    for b in range(12):
        spark.createDataFrame(rows[5 * b : 5 * b + 5], shape).coalesce(1).write.mode("append").parquet(source)
    ingest_compacted(stream_parquet(spark, source, spark.read.schema(shape).parquet(source).schema, 1), "ts", out, state, 2, 5).awaitTermination()
    assert len(ingest._versions(spark, out)) == 2 and ingest._versions(spark, out)[-1] >= 11
    pieces = ingest._pieces(spark, out, ingest._versions(spark, out)[-1])
    assert set(pieces) == {"2024-01-01-00", "2024-01-01-01", "2024-01-01-02", "none"}
    assert all(sum(n for _, n in held) <= 5 for held in pieces.values())
    # what is on disk is at most the last manifest's files and those of the one before
    assert all(len(list((tmp_path / "out/data").glob(f"piece=*/period={h}/*.parquet"))) <= 12 for h in pieces)
    stored = read_ingested(spark, out, shape)
    assert sorted((r.id, r.ts) for r in stored.collect()) == rows and sum(r.n for r in hourly_counts(stored, "period").collect()) == 60


def test_a_failed_batch_is_replayed_without_loss_or_repeats(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shape = "id int, ts timestamp"
    assert read_ingested(spark, out, shape).collect() == []
    run = lambda: ingest_compacted(stream_parquet(spark, source, spark.read.schema(shape).parquet(source).schema), "ts", out, state, 2, 3).awaitTermination()
    add = lambda a, b: spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 5)) for i in range(a, b)], shape).coalesce(1).write.mode("append").parquet(source)
    add(0, 10)
    run()
    add(10, 20)
    real = ingest._written

    def dies(*args):
        raise RuntimeError("lost after the rows, before the manifest")

    monkeypatch.setattr(ingest, "_written", dies)
    with pytest.raises(Exception, match="lost after the rows"):
        run()
    assert sorted(r.id for r in read_ingested(spark, out, shape).collect()) == list(range(10))
    monkeypatch.setattr(ingest, "_written", real)
    # committed, but the stream did not note it
    monkeypatch.setattr(ingest, "_sweep", dies)
    with pytest.raises(Exception, match="lost after the rows"):
        run()
    monkeypatch.undo()
    run()
    add(20, 25)
    run()
    assert sorted(r.id for r in read_ingested(spark, out, shape).collect()) == list(range(25))
