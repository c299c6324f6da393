from __future__ import annotations

import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lagline.models import evaluate as ev
from lagline.models.selection import levels_from_votes, stable_features


def sweep_rows(df):
    return [tuple(r) for r in df.orderBy("Cutoff").collect()]


def test_sweep_by_hand(spark):
    df = spark.createDataFrame([(0.3, 1), (0.3, 0), (0.5, 1), (0.1, 1), (0.6, 0), (None, 1)], "p double, label int")
    got = sweep_rows(ev.cutoff_sweep(df, "p", "label", [0.9, 0.0, 0.3, 0.5]))
    assert got == [
        (0.0, 3, 2, 60.0, 75.0), (0.3, 2, 2, 50.0, 50.0), (0.5, 1, 1, 50.0, 25.0), (0.9, 0, 0, None, 0.0),
    ]


def points(spark, rows):
    return spark.createDataFrame([(float(c), 0, 0, p, r) for c, p, r in rows], "Cutoff double, TP long, FP long, Precision double, Recall double")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 10.0, 100.0), (1, 20.0, 90.0), (2, 40.0, 70.0)], 30.0),
        ([(0, 10.0, 100.0), (1, 20.0, 80.0), (2, 40.0, 60.0)], 20.0),  # exactly 80: no strict crossing, so the first pair, which ends there
        ([(0, 10.0, 70.0), (1, 20.0, 60.0)], 0.0),  # never above 80: the first pair, extended
        ([(0, 10.0, 90.0), (1, 20.0, 70.0), (2, 30.0, 85.0), (3, 40.0, 75.0)], 35.0),  # two crossings: the last
    ],
)
def test_precision_at_recall(spark, rows, want):
    assert ev.precision_at_recall(points(spark, rows)).first()[0] == pytest.approx(want)


def test_clean_sweep(spark):
    rows = [(0, 16.0, 100.0), (1, 0.5, 50.0), (2, 40.0, 0.5), (3, 95.0, 20.0), (4, None, 0.0), (5, None, None)]
    assert [r.Cutoff for r in ev.clean_sweep(points(spark, rows)).orderBy("Cutoff").collect()] == [0.0, 5.0]


# Published sweep points (cutoff, TP, FP, precision, recall).
PUBLISHED = [
    (0.0, 561947, 2820439, 16.61392283435421, 100.0),
    (0.3, 536696, 2360346, 18.525654788574002, 95.50651573902877),
]


def test_published_points_follow_from_their_counts(spark):
    spread = [(0.2, 1, PUBLISHED[0][1] - PUBLISHED[1][1]), (0.2, 0, PUBLISHED[0][2] - PUBLISHED[1][2]), (0.4, 1, PUBLISHED[1][1]), (0.4, 0, PUBLISHED[1][2])]
    counts = spark.createDataFrame(spread, "p double, label int, n int")
    rows = counts.select("p", "label", F.explode(F.sequence(F.lit(1), "n")))
    for got, want in zip(sweep_rows(ev.cutoff_sweep(rows, "p", "label", [0.0, 0.3])), PUBLISHED):
        assert got == pytest.approx(want)


def test_metrics_equal_the_evaluator(spark):
    df = spark.range(500).select((F.col("id") * 7 % 3 == 0).cast("double").alias("prediction"), (F.col("id") * 11 % 4 == 0).cast("double").alias("label"))
    row = ev.classification_metrics(df, "prediction", "label").first()
    names = {"accuracy": "accuracy", "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall", "f1": "f1"}
    for ours, theirs in names.items():
        assert row[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df)), ours
    for ours, theirs in (("precision_1", "precisionByLabel"), ("recall_1", "recallByLabel")):
        assert row[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs, metricLabel=1.0).evaluate(df)), ours


def test_ensemble_and_final_metrics(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.43, 1), (0.4, 0.4, 0.465, 0), (0.4, 0.4, 0.4, 1)], "mlp_prob_pos double, eng_lr_prob_pos double, rf_prob_pos double, label int")
    scored = ev.ensemble(df)
    assert [r.final for r in scored.collect()] == [1, 1, 0]
    row = ev.final_label_metrics(scored, "final", "label").first()
    assert (row.TP, row.FP, row.positives, row.precision, row.recall, row.f1, row.f2) == (1, 1, 2, 50.0, 50.0, 50.0, 50.0)


def test_model_comparison(spark):
    a = points(spark, [(0, 10.0, 100.0), (1, 20.0, 60.0)])
    b = points(spark, [(0, 10.0, 100.0), (1, 30.0, 60.0), (2, 99.0, 50.0)])
    assert {r.model: r.precision for r in ev.compare_models({"a": a, "b": b}).collect()} == pytest.approx({"a": 15.0, "b": 20.0})


def test_error_and_fallback(spark):
    df = spark.createDataFrame([(10.0, 4.0, 3, 1.0), (None, 2.0, 0, 7.0)], "pred double, act double, n int, wide double")
    assert tuple(ev.error_stats(df, "pred", "act").first()) == (6.0, None)
    assert [r.x for r in df.select(ev.sparse_fallback_mean(df, "pred", "n", "wide").alias("x")).collect()] == [10.0, 7.0]
    assert df.select(ev.one_tailed_z(F.lit(18.0), F.lit(6.0), F.lit(4)).alias("z")).first().z == 1.0


def test_votes(spark):
    votes = spark.createDataFrame(
        [("3: ORIGIN = ORD", 2), ("4: ORIGIN = LAX", 3), ("5: ORIGIN = JFK", 1), ("DEST_ORIGIN", 2), ("12: DEST = A = B", 2), ("DEP", 1)], "feature string, votes int"
    )
    got = {r.column: (r.is_numeric, r.levels) for r in levels_from_votes(votes).collect()}
    assert got == {"ORIGIN": (False, ["LAX", "ORD"]), "DEST_ORIGIN": (True, []), "DEST": (False, ["A = B"])}
    weights = spark.createDataFrame([(0, "a", 0.5), (1, "a", -0.5), (0, "b", 0.5), (1, "b", 0.001)], "fold int, feature string, weight double")
    assert [tuple(r) for r in stable_features(weights).collect()] == [("a", 2)]


def test_ranking_quality_equals_the_evaluator_and_brute_force(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(3)
    rows = [("free", rng.random(), float(rng.random() < 0.3)) for _ in range(400)] + [("tied", rng.randrange(6) / 5, float(rng.random() < 0.5)) for _ in range(300)]
    rows += [("one", 0.5, 1.0), ("one", 0.7, 1.0), (None, 0.1, 0.0), (None, 0.9, 1.0), ("free", None, 1.0), ("free", 0.2, None)]
    df = spark.createDataFrame(rows, "k string, s double, y double")
    got = {r.k: r for r in ev.ranking_quality(df, "s", "y", ["k"]).collect()}
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert got["free"].auc == pytest.approx(evaluator.evaluate(df.where("k = 'free'").dropna()), abs=1e-12)
    for k in ("free", "tied", None):
        pairs = [(s, y) for key, s, y in rows if key == k and s is not None and y is not None]
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        assert got[k].auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg), abs=1e-12)
        precision = lambda at: sum(p >= at for p in pos) / (sum(p >= at for p in pos) + sum(n >= at for n in neg))
        assert got[k].average_precision == pytest.approx(sum(precision(p) for p in pos) / len(pos), abs=1e-12)
    assert got["one"].auc is None and got["one"].average_precision == 1.0
    assert ev.ranking_quality(df.where("k = 'tied'"), "s", "y").first().auc == pytest.approx(got["tied"].auc, abs=1e-12)
