from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lagline.models.classifiers import decision_tree, fit_folds, fit_stages, grid_search, lasso_regression, load_model, perceptron, random_forest, save_model, score
from lagline.models.evaluate import cutoff_sweep
from lagline.models.features import base_levels, feature_map, feature_stages, level_index, principal_components
from lagline.models.selection import coefficient_table, importance_table, stable_features, top_features
from lagline.models.trees import can_cut, cut_forest
from lagline.operators.folds import block_frames
from lagline.session import materialize_even


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    base = dt.datetime(2020, 1, 1)
    data = []
    for i in range(600):
        c, x = rng.choice(["WN", "AA", "DL"]), rng.random()
        data.append((i, base + dt.timedelta(hours=i), c, x, rng.random(), 1.0 if x + (c == "WN") * 0.4 + rng.random() * 0.3 > 0.9 else 0.0))
    return spark.createDataFrame(data, "id int, ts timestamp, carrier string, x double, noise double, label double").cache()


def test_folds_learn_and_name_features(spark, rows):
    folds = block_frames(rows, "ts", 3, 0.8)
    stages = lambda _: [*feature_stages(["carrier"], ["x", "noise"]), lasso_regression(maxIter=20)]
    models, scored, trained = fit_folds(folds, stages, keep=["id", "label"])
    assert len(models) == 3 and scored.columns == ["id", "label", "prob_pos", "prediction", "fold"]
    assert scored.count() == sum(v.count() for _, v in folds) and trained.count() == sum(t.count() for t, _ in folds)
    best = {r.Cutoff: r.Precision for r in cutoff_sweep(scored, "prob_pos", "label", [0.0, 0.5]).collect()}
    assert best[0.5] > best[0.0] + 10
    frames = [m.transform(t) for m, (t, _) in zip(models, folds)]
    named = feature_map(frames[0])
    # The last level is the base: it has no position, and unseen levels and nulls count as it.
    assert [r.feature for r in named.orderBy("position").collect()] == ["carrier = AA", "carrier = DL", "x", "noise"]
    assert [tuple(r) for r in base_levels(models[0], spark).collect()] == [("carrier", "WN")]
    odd = rows.limit(3).withColumn("carrier", F.lit("new")).unionByName(rows.limit(3).withColumn("carrier", F.lit(None).cast("string")))
    assert {tuple(v[:2]) for v in (r.feat_vec.toArray() for r in models[0].transform(odd).collect())} == {(0.0, 0.0)}
    stable = {r.feature: r.votes for r in stable_features(coefficient_table(spark, models, frames)).collect()}
    assert stable["x"] == 3 and stable.get("noise", 0) < 3


def test_trees_forest_and_perceptron(spark, rows):
    plain = feature_stages(["carrier"], ["x", "noise"], scaled=False, one_hot=False)
    for classifier in (decision_tree(), random_forest(numTrees=5)):
        model = fit_stages(rows, [*plain, classifier])
        ranked = importance_table(spark, model, model.transform(rows))
        assert top_features(ranked, 1).first().feature == "x" and ranked.count() == 3
    mlp = fit_stages(rows, [*feature_stages([], ["x", "noise"]), perceptron(2, (4,))])
    assert score(mlp, rows, keep=["id"]).filter(~F.col("prob_pos").between(0, 1)).count() == 0


def test_saved_model_scores_the_same(rows, tmp_path):
    model = fit_stages(rows, [*feature_stages(["carrier"], ["x"]), lasso_regression()])
    save_model(model, str(tmp_path / "m"))
    a = score(model, rows, keep=["id"]).orderBy("id").collect()
    assert a == score(load_model(str(tmp_path / "m")), rows, keep=["id"]).orderBy("id").collect()


def test_grid(rows):
    folds = block_frames(rows, "ts", 2, 0.8)
    features = feature_stages(["carrier"], ["x"], scaled=False, one_hot=False)
    result = grid_search(folds, features, lambda s: random_forest(**s), {"numTrees": (2, 4), "maxDepth": (2,)}, "label", [i / 10 for i in range(10)]).collect()
    assert sorted((r.numTrees, r.maxDepth) for r in result) == [(2, 2), (4, 2)] and all(r.precision is not None for r in result)


def test_components_and_levels(spark, rows):
    model, projected = principal_components(rows, ["x", "noise"], 2)
    assert sum(model.stages[-1].explainedVariance) == pytest.approx(1.0) and projected.count() == rows.count()
    assert [tuple(r) for r in level_index(rows, "carrier").orderBy("idx").collect()] == [("AA", 0.0), ("DL", 1.0), ("WN", 2.0)]


def test_forest_keeps_nodes_of_rows_and_grows_the_same_trees(rows):
    plain = feature_stages(["carrier"], ["x", "noise"], scaled=False, one_hot=False)
    kept = random_forest(numTrees=5, maxDepth=8)
    assert kept.getCacheNodeIds()
    trees = [fit_stages(rows, [*plain, c]).stages[-1].toDebugString.split("\n", 1)[1] for c in (kept, random_forest(numTrees=5, maxDepth=8, cacheNodeIds=False))]
    assert trees[0] == trees[1]


def test_training_rows_are_dealt_evenly(spark, rows):
    lopsided = spark.range(120_000, numPartitions=1).unionByName(spark.range(120_000, 121_000, numPartitions=8))
    even = materialize_even(lopsided)
    sizes = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) < 10
    assert even.distinct().count() == 121_000
    assert materialize_even(rows.coalesce(1)).rdd.getNumPartitions() == 1


def test_folds_and_grid_fit_on_even_rows(spark, monkeypatch):
    from lagline.models import classifiers

    seen = []
    monkeypatch.setattr(classifiers, "fit_stages", lambda train, stages, plain=classifiers.fit_stages: seen.append(train.rdd.getNumPartitions()) or plain(train, stages))
    many = spark.range(130_000, numPartitions=1).select(
        "id", F.timestamp_seconds("id").alias("ts"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 97 > 40).cast("double").alias("label"))
    fold = [(many, many.limit(500))]
    fit_folds(fold, lambda _: [*feature_stages([], ["x"]), lasso_regression()], keep=["id", "label"])
    assert seen == [4]
    grid_search(fold, feature_stages([], ["x"], scaled=False), lambda s: random_forest(**s), {"numTrees": (2,), "maxDepth": (2,)}, "label", [0.5])
    assert seen[-1] == 4


def test_a_cut_forest_is_the_forest_of_that_depth(spark, rows):
    plain = feature_stages(["carrier"], ["x", "noise"], scaled=False, one_hot=False)
    vectors = fit_stages(rows, plain).transform(rows).select("id", "features", "label").cache()
    deep, depths = random_forest(numTrees=6, maxDepth=12), [0, 1, 3, 6, 12, 14]
    model = deep.fit(vectors)
    for depth, cut in zip(depths, cut_forest(spark, model, depths)):
        alone = random_forest(numTrees=6, maxDepth=min(depth, 12)).fit(vectors)
        assert can_cut(deep, model, depth)
        assert cut.toDebugString.split("\n", 1)[1] == alone.toDebugString.split("\n", 1)[1] and cut.getMaxDepth() == depth
        assert [tuple(r) for r in score(cut, vectors, keep=["id"]).orderBy("id").collect()] == [tuple(r) for r in score(alone, vectors, keep=["id"]).orderBy("id").collect()]
    # Where a level does not fit into the memory of a pass, nodes are split in another order and a fit of its own is needed.
    assert not can_cut(random_forest(numTrees=6, maxMemoryInMB=0), model, 3)


def test_grid_fits_forests_of_all_depths_once(rows, monkeypatch):
    from lagline.models import classifiers

    folds = block_frames(rows, "ts", 2, 0.8)
    features = feature_stages(["carrier"], ["x", "noise"], scaled=False, one_hot=False)
    search = lambda trees, depths, **more: grid_search(
        folds, features, lambda s: random_forest(**s, **more), {"numTrees": trees, "maxDepth": depths}, "label", [i / 10 for i in range(10)]).collect()
    alone = [r for d in (2, 4, 7) for r in search((3, 5), (d,))]
    fits = []
    monkeypatch.setattr(classifiers, "fit_stages", lambda train, stages, plain=classifiers.fit_stages: fits.extend(s for s in stages if hasattr(s, "getNumTrees")) or plain(train, stages))
    assert sorted(map(tuple, search((3, 5), (2, 4, 7)))) == sorted(map(tuple, alone))
    assert sorted((f.getNumTrees(), f.getMaxDepth()) for f in fits) == [(3, 7), (3, 7), (5, 7), (5, 7)]
    fits.clear()
    search((3,), (2, 4), maxMemoryInMB=0)
    assert sorted(f.getMaxDepth() for f in fits) == [2, 2, 4, 4]


def test_even_rows_lie_next_to_rows_alike(spark, rows):
    mixed = spark.range(120_000, numPartitions=3).select((F.col("id") * 7919 % 1000).alias("x"))
    parts = materialize_even(mixed, near=["x"]).rdd.glom().collect()
    assert sum(map(len, parts)) == 120_000 and all(p == sorted(p) for p in parts)
    few = [r.noise for r in materialize_even(rows.coalesce(1), near=["noise"]).collect()]
    assert few == [r.noise for r in rows.coalesce(1).collect()]
