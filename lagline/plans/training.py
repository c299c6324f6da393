"""Classifiers fitted on the given tables. Fits are iterative: SQL states what must hold of their scores, not the scores."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lagline.functions.scalars import hash_score
from lagline.models.classifiers import (
    FINAL_FOREST,
    FOREST_GRID,
    FORESTS,
    HIDDEN_LAYERS,
    decision_tree,
    fit_folds,
    fit_stages,
    grid_search,
    lasso_regression,
    load_model,
    perceptron,
    random_forest,
    save_model,
    score,
    wide_layers,
)
from lagline.models.evaluate import (
    PROBABILITY_CUTOFFS,
    classification_metrics,
    clean_sweep,
    cutoff_sweep,
    ensemble,
    final_label_metrics,
    precision_at_recall,
    sweep_scores,
)
from lagline.models.features import base_levels, feature_map, feature_stages, principal_components
from lagline.models.selection import coefficient_table, importance_table, stable_features, top_features
from lagline.operators.folds import block_frames
from lagline.operators.joins import join_predictions
from lagline.operators.range_windows import delay_features
from lagline.operators.sampling import balance_by_keep
from lagline.plans import windows  # noqa: F401 - its queries are part of the SQL here
from lagline.plans.common import REGISTRY, flights, query
from lagline.plans.evaluation import _blocks_sql
from lagline.session import materialize, materialize_even, shared_path

CATEGORICAL = ["carrier", "hour", "weekday"]
NUMERIC = [
    "av_carrier_delay", "prev_delay_tailnum", "weekly_flights_tailnum", "hourly_flights_origin", "airport_average_hourly", "airport_congestion",
]
KEEP = ["event_id", "ts", "tail", "delay", "label"]
CUTOFFS = tuple(i / 20 for i in range(20))


def forest_features():
    """Features of the published forests: numeric columns only, as their bins are fewer than the levels of some category."""
    return feature_stages([], NUMERIC, scaled=False)


def training_rows(spark, sf_dir):
    """Flights with lagged features, calendar categories and the label "delay of at least 50"."""
    built = delay_features(flights(spark, sf_dir), "ts", "delay", "carrier", "carrier", "tail", "event_id")
    return built.withColumns(
        {
            "delay": F.col("delay").cast("double"),
            "hour": F.hour("ts").cast("string"),
            "weekday": F.dayofweek("ts").cast("string"),
            "label": (F.col("delay") >= 50).cast("double"),
        }
    )


def _folds(spark, sf_dir, blocks: int = 3):
    rows = materialize(training_rows(spark, sf_dir), "training")
    return rows, block_frames(rows, "ts", blocks, 0.8)


def _single_fold(spark, sf_dir):
    _, folds = _folds(spark, sf_dir, 1)
    (train, validation), = folds
    return materialize_even(train, "train"), validation


def _balance(df):
    return balance_by_keep(df, "label", hash_score("event_id"), 0.5)


@query("lasso_validation_sweep")
def lasso_validation_sweep(spark, sf_dir):
    """Lasso regression per fold, validation scores of all folds swept over the cutoffs."""
    _, folds = _folds(spark, sf_dir)
    _, scored, _ = fit_folds(folds, lambda _: [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()], _balance, KEEP)
    return cutoff_sweep(scored, "prob_pos", "label", PROBABILITY_CUTOFFS)


@query("lasso_overfit_check")
def lasso_overfit_check(spark, sf_dir):
    """Precision at 80 % recall on validation and on training rows."""
    _, folds = _folds(spark, sf_dir)
    _, scored, trained = fit_folds(folds, lambda _: [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()], _balance, KEEP)
    both = scored.withColumn("part", F.lit("validation")).unionByName(trained.withColumn("part", F.lit("train")))
    return precision_at_recall(clean_sweep(cutoff_sweep(both, "prob_pos", "label", CUTOFFS, ["part"])), 80.0, ["part"])


_LABELLED_SQL = "SELECT fold, role, CASE WHEN CAST(value AS DECIMAL(12,2)) >= 50 THEN 1 ELSE 0 END AS label FROM ({}) JOIN events USING (event_id)"


@query(
    "fold_fit_totals",
    f"""SELECT role AS part, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS "TP", CAST(sum(1 - label) AS BIGINT) AS "FP", true AS probability
FROM ({_LABELLED_SQL.format(_blocks_sql('events', 'event_id', 'ts', 3, 0.8))}) GROUP BY 1, 2""",
)
def fold_fit_totals(spark, sf_dir):
    """Lasso per fold, every training and validation row of a fold scored once: at cutoff 0 the sweep counts its classes."""
    _, folds = _folds(spark, sf_dir)
    _, scored, trained = fit_folds(folds, lambda _: [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()], keep=KEEP)
    both = scored.withColumn("part", F.lit("validation")).unionByName(trained.withColumn("part", F.lit("train")))
    keys = ["part", "fold"]
    swept = cutoff_sweep(both, "prob_pos", "label", (0.0,), keys).select(*keys, "TP", "FP")
    counts = both.groupBy(*keys).agg(F.countDistinct("event_id").alias("n"), F.bool_and(F.col("prob_pos").between(0, 1)).alias("probability"))
    return counts.join(swept, keys).select(*keys, "n", "TP", "FP", "probability")


@query(
    "fit_confusion_totals",
    f"""SELECT model, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, true AS agrees
FROM ({_LABELLED_SQL.format(_blocks_sql('events', 'event_id', 'ts', 1, 0.8))}), (VALUES ('lasso'), ('tree'), ('forest'), ('perceptron')) m(model)
WHERE role = 'validation' GROUP BY 1""",
)
def fit_confusion_totals(spark, sf_dir):
    """Every kind of classifier on one fold: hits and misses add up to the classes, and the prediction is the likelier class."""
    train, validation = _single_fold(spark, sf_dir)
    kinds = {
        "lasso": [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()],
        "tree": [*feature_stages(CATEGORICAL, NUMERIC, scaled=False, one_hot=False), decision_tree()],
        "forest": [*forest_features(), random_forest(**FORESTS[2])],
        "perceptron": [*feature_stages([], NUMERIC), perceptron(len(NUMERIC), HIDDEN_LAYERS[1], maxIter=10)],
    }
    scored = None
    for name, stages in kinds.items():
        rows = score(fit_stages(train, stages), validation, keep=["event_id", "label"]).withColumn("model", F.lit(name))
        scored = rows if scored is None else scored.unionByName(rows)
    n = lambda said, is_: F.count(F.when((F.col("prediction") == said) & (F.col("label") == is_), 1))
    totals = scored.groupBy("model").agg(
        F.countDistinct("event_id").alias("n"), n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"),
        F.bool_and(F.when(F.col("prediction") == 1, F.col("prob_pos") >= 0.5).otherwise(F.col("prob_pos") <= 0.5)).alias("agrees"))
    return totals.select("model", "n", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), "agrees")


@query("lasso_stable_features")
def lasso_stable_features(spark, sf_dir):
    """Features that the published lasso keeps in at least four of five blocks (none, if the data carry no signal)."""
    _, folds = _folds(spark, sf_dir, 5)
    models, _, _ = fit_folds(folds, lambda _: [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()], _balance, KEEP)
    frames = [model.transform(train) for model, (train, _) in zip(models, folds)]
    return stable_features(coefficient_table(spark, models, frames), min_votes=4)


# Levels of the categories but for the last of each, and the numeric columns, in the order of the feature vector.
_FEATURES_SQL = """
WITH lv AS (
  SELECT 0 AS g, 'carrier' AS c, event_type AS o FROM events UNION SELECT 1, 'hour', CAST(hour(ts) AS VARCHAR) FROM events
  UNION SELECT 2, 'weekday', CAST(dayofweek(ts) + 1 AS VARCHAR) FROM events),
ranked AS (SELECT *, max(o) OVER (PARTITION BY g) AS base FROM lv),
cat AS (SELECT g, o, c || ' = ' || o AS feature, base FROM ranked WHERE o <> base)
"""
_NUMERIC_SQL = ", ".join(f"(3, '{i}', '{name}')" for i, name in enumerate(NUMERIC))


@query(
    "feature_names",
    _FEATURES_SQL + f"""SELECT row_number() OVER (ORDER BY g, o) - 1 AS position, feature, base FROM (
  SELECT g, o, feature, base FROM cat UNION ALL SELECT g, o, name, NULL FROM (VALUES {_NUMERIC_SQL}) AS n(g, o, name))""",
)
def feature_names_query(spark, sf_dir):
    """Position, name and base level of every assembled feature."""
    rows = materialize(training_rows(spark, sf_dir), "training")
    model = fit_stages(rows, feature_stages(CATEGORICAL, NUMERIC))
    named = feature_map(model.transform(rows))
    base = base_levels(model, spark)
    column = F.split("feature", " = ")[0]
    return named.join(base, column == F.col("column"), "left").select("position", "feature", "base")


@query(
    "feature_vectors",
    _FEATURES_SQL + f""", w AS ({REGISTRY['delay_features'].sql}),
cells AS (
  SELECT event_id, g, o, CASE WHEN o = CASE g WHEN 0 THEN event_type WHEN 1 THEN CAST(hour(ts) AS VARCHAR) ELSE CAST(dayofweek(ts) + 1 AS VARCHAR) END
         THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM events, cat
  UNION ALL {" UNION ALL ".join(f"SELECT event_id, 3, '{i}', CAST({name} AS DOUBLE) FROM w" for i, name in enumerate(NUMERIC))}),
s AS (SELECT g, o, stddev_samp(v) AS sd FROM cells GROUP BY 1, 2)
SELECT event_id, list(round(CASE WHEN sd > 0 THEN v / sd ELSE 0 END, 4) ORDER BY g, o) AS features FROM cells JOIN s USING (g, o) GROUP BY 1""",
)
def feature_vectors(spark, sf_dir):
    """Indexed, one-hot encoded, assembled and scaled features as arrays, rounded."""
    rows = materialize(training_rows(spark, sf_dir), "training")
    transformed = fit_stages(rows, feature_stages(CATEGORICAL, NUMERIC)).transform(rows)
    return transformed.select("event_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).alias("features"))


@query("decision_tree_metrics")
def decision_tree_metrics(spark, sf_dir):
    train, validation = _single_fold(spark, sf_dir)
    model = fit_stages(train, [*feature_stages(CATEGORICAL, NUMERIC, scaled=False, one_hot=False), decision_tree()])
    return classification_metrics(score(model, validation, keep=KEEP), "prediction", "label")


@query("forest_metrics")
def forest_metrics(spark, sf_dir):
    """The three published forest settings, one line of metrics each."""
    train, validation = _single_fold(spark, sf_dir)
    result = None
    for i, settings in enumerate(FORESTS):
        model = fit_stages(train, [*forest_features(), random_forest(**settings)])
        line = classification_metrics(score(model, validation, keep=KEEP), "prediction", "label").withColumn("model", F.lit(i))
        result = line if result is None else result.unionByName(line)
    return result


@query("forest_importances")
def forest_importances(spark, sf_dir):
    """The most important features of a forest."""
    train, _ = _single_fold(spark, sf_dir)
    model = fit_stages(train, [*forest_features(), random_forest(**FORESTS[0])])
    return top_features(importance_table(spark, model, model.transform(train)), 20)


@query("forest_grid")
def forest_grid(spark, sf_dir):
    """The published grid of trees and depth, every combination rated on five blocks by precision at 80 % recall."""
    _, folds = _folds(spark, sf_dir, 5)
    features = feature_stages(CATEGORICAL, NUMERIC, scaled=False, one_hot=False)
    return grid_search(folds, features, lambda settings: random_forest(**settings), FOREST_GRID, "label", CUTOFFS)


@query("final_forest_metrics")
def final_forest_metrics(spark, sf_dir):
    """The forest of the final model."""
    train, validation = _single_fold(spark, sf_dir)
    model = fit_stages(train, [*feature_stages(CATEGORICAL, NUMERIC, scaled=False, one_hot=False), random_forest(**FINAL_FOREST)])
    return classification_metrics(score(model, validation, keep=KEEP), "prediction", "label")


@query("perceptron_layouts")
def perceptron_layouts(spark, sf_dir):
    """The four published layouts and the wide one, on the numeric features."""
    train, validation = _single_fold(spark, sf_dir)
    swept = None
    for i, hidden in enumerate((*HIDDEN_LAYERS, wide_layers(len(NUMERIC)))):
        model = fit_stages(train, [*feature_stages([], NUMERIC), perceptron(len(NUMERIC), hidden, maxIter=20 if i == len(HIDDEN_LAYERS) else 50)])
        line = classification_metrics(score(model, validation, keep=KEEP), "prediction", "label").withColumn("layout", F.lit(i))
        swept = line if swept is None else swept.unionByName(line)
    return swept


@query("principal_components")
def principal_components_query(spark, sf_dir):
    rows = materialize(training_rows(spark, sf_dir), "training")
    parts = None
    for k in (2, 5):
        _, projected = principal_components(rows, NUMERIC, k)
        found = projected.select("event_id", F.lit(k).alias("k"), vector_to_array("components").alias("components"))
        parts = found if parts is None else parts.unionByName(found)
    return parts


# A column of one value has no correlation and adds none.
_CORRELATIONS_SQL = " + ".join(f"power(coalesce(nullif(corr({a}, {b}), 'nan'::DOUBLE), 0), 2)" for a in NUMERIC for b in NUMERIC)


@query(
    "component_variances",
    f"""SELECT round(CAST({" + ".join(f"(stddev_samp({c}) > 0)::INTEGER" for c in NUMERIC)} AS DOUBLE), 6) AS total, round({_CORRELATIONS_SQL}, 6) AS total_squared, true AS descending
FROM (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)} FROM ({REGISTRY['delay_features'].sql}))""",
)
def component_variances(spark, sf_dir):
    """All principal components: their variances add up to those of the columns, their squares to the squared correlations."""
    rows = materialize(training_rows(spark, sf_dir), "training")
    _, projected = principal_components(rows, NUMERIC, len(NUMERIC))
    part = vector_to_array("components")
    spread = projected.agg(F.array(*(F.var_samp(part[i]) for i in range(len(NUMERIC)))).alias("v"))
    add = lambda of: F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + of(x)), 6)
    return spread.select(
        add(lambda x: x).alias("total"), add(lambda x: x * x).alias("total_squared"),
        F.forall(F.sequence(F.lit(1), F.lit(len(NUMERIC) - 1)), lambda i: F.get("v", i) <= F.get("v", i - 1) + 1e-9).alias("descending"))


@query("model_round_trip", "SELECT event_id, CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0 END AS label, 0.0::DOUBLE AS difference, true AS probability FROM events")
def model_round_trip(spark, sf_dir):
    """A fitted model saved and loaded: every row is scored the same by both, with a probability."""
    rows = materialize(training_rows(spark, sf_dir), "training")
    path = shared_path(spark, "model")
    fitted = fit_stages(rows, [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()])
    save_model(fitted, path)
    before = score(fitted, rows, "was", ["event_id"]).drop("prediction")
    after = score(load_model(path), rows, keep=["event_id", "label"])
    return after.join(before, "event_id").select(
        "event_id", "label", F.abs(F.col("prob_pos") - F.col("was")).alias("difference"), F.col("prob_pos").between(0, 1).alias("probability"))


@query("trained_ensemble")
def trained_ensemble(spark, sf_dir):
    """Perceptron, lasso and forest trained on one fold, joined on their key and weighted."""
    _, folds = _folds(spark, sf_dir, 1)
    (train, validation), = folds
    train = materialize(_balance(train), "balanced")
    stages = {
        "mlp_prob_pos": [*feature_stages([], NUMERIC), perceptron(len(NUMERIC), (4, 4))],
        "eng_lr_prob_pos": [*feature_stages(CATEGORICAL, NUMERIC), lasso_regression()],
        "rf_prob_pos": [*forest_features(), random_forest(**FORESTS[0])],
    }
    frames = []
    for name, model_stages in stages.items():
        keep = ["event_id", "label"] if not frames else ["event_id"]
        frames.append(score(fit_stages(train, model_stages), validation, name, keep).drop("prediction"))
    joined = ensemble(join_predictions(frames, ["event_id"]))
    sweeps = clean_sweep(sweep_scores(joined, {**{n: n for n in stages}, "ensemble": "score"}, "label", CUTOFFS))
    rated = precision_at_recall(sweeps, 80.0, ["model"])
    final = final_label_metrics(joined, "final", "label").select(F.lit("ensemble").alias("m"), "recall", "f1", "f2")
    return rated.join(final, F.col("model") == F.col("m"), "left").drop("m")
