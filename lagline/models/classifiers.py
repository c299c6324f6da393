"""Classifiers on blocked time-series folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.functions.scalars import positive_probability
from lagline.models.evaluate import cutoff_sweep, precision_at_recall, ranking_quality
from lagline.models.trees import can_cut, cut_forest
from lagline.session import materialize, materialize_even, shared_path

# Settings of the published models.
LASSO = {"maxIter": 5, "regParam": 0.005, "elasticNetParam": 1.0}
FORESTS = (
    {"numTrees": 25, "maxBins": 10, "maxDepth": 5, "minInstancesPerNode": 1},
    {"numTrees": 50, "maxBins": 20, "maxDepth": 10, "minInstancesPerNode": 2},
    {"numTrees": 10, "maxBins": 50, "maxDepth": 3, "minInstancesPerNode": 3},
)
FINAL_FOREST = {"numTrees": 50, "maxDepth": 30, "minInstancesPerNode": 1000, "minInfoGain": 0.0001}
FOREST_GRID = {"numTrees": (10, 20, 30), "maxDepth": (5, 10, 15)}
HIDDEN_LAYERS = ((8,), (4,), (4, 4), (16, 8, 4))


def lasso_regression(label: str = "label", features: str = "features", **settings) -> LogisticRegression:
    """Logistic regression with an L1 penalty: a classifier and a feature selector."""
    return LogisticRegression(labelCol=label, featuresCol=features, **{**LASSO, **settings})


def decision_tree(label: str = "label", features: str = "features", **settings) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, featuresCol=features, **{"seed": 42, **settings})


def random_forest(label: str = "label", features: str = "features", **settings) -> RandomForestClassifier:
    """Every row's node in every tree is kept from level to level; the trees are the same as if each row came down from the root anew."""
    return RandomForestClassifier(labelCol=label, featuresCol=features, **{"seed": 42, "cacheNodeIds": True, **settings})


def perceptron(inputs: int, hidden: Sequence[int] = (4,), label: str = "label", features: str = "features", **settings) -> MultilayerPerceptronClassifier:
    """Perceptron with two output classes and the given hidden layers."""
    return MultilayerPerceptronClassifier(
        layers=[inputs, *hidden, 2], labelCol=label, featuresCol=features, **{"seed": 42, "maxIter": 50, **settings}
    )


def wide_layers(inputs: int) -> tuple[int, int]:
    """Hidden layers of the wide perceptron: two layers of ten more units than there are inputs."""
    return (inputs + 10, inputs + 10)


def fit_stages(train: DataFrame, stages: Sequence) -> PipelineModel:
    """Fit the stages in order; a plain function among them makes its stage of the training rows."""
    return Pipeline(stages=[s if hasattr(s, "uid") else s(train) for s in stages]).fit(train)


def score(model: PipelineModel, df: DataFrame, name: str = "prob_pos", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows with the probability of class 1; vector columns are left out."""
    transformed = model.transform(df)
    return transformed.select(*(keep or df.columns), positive_probability().alias(name), F.col("prediction"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_folds(
    folds: Sequence[tuple[DataFrame, DataFrame]],
    make_stages: Callable[[DataFrame], Sequence],
    balance: Callable[[DataFrame], DataFrame] | None = None,
    keep: Sequence[str] | None = None,
) -> tuple[list[PipelineModel], DataFrame, DataFrame]:
    """(models, validation scores, train scores) of fitting the stages on every fold.

    Every stage, indexing and scaling included, is fitted on the fold's own training rows. These are
    balanced and materialised once, as the fit scans them many times; scores of all folds are
    stacked with a ``fold`` column and stay lazy.
    """
    models, scored, trained = [], None, None
    for i, (train, validation) in enumerate(folds):
        rows = materialize_even(balance(train) if balance else train)
        model = fit_stages(rows, make_stages(rows))
        models.append(model)
        new = score(model, validation, keep=keep).withColumn("fold", F.lit(i))
        old = score(model, rows, keep=keep).withColumn("fold", F.lit(i))
        scored = new if scored is None else scored.unionByName(new)
        trained = old if trained is None else trained.unionByName(old)
    return models, scored, trained


def _same_but_depth(classifiers: Sequence) -> list[list[int]]:
    """Positions of classifiers in groups: forests that differ in depth only, the deepest first; any other classifier alone."""
    groups = {}
    for i, classifier in enumerate(classifiers):
        others = i
        if isinstance(classifier, RandomForestClassifier):
            others = frozenset((param.name, repr(value)) for param, value in classifier.extractParamMap().items() if param.name != "maxDepth")
        groups.setdefault(others, []).append(i)
    return [sorted(group, key=lambda i: -classifiers[i].getMaxDepth()) if len(group) > 1 else group for group in groups.values()]


def grid_search(
    folds: Sequence[tuple[DataFrame, DataFrame]],
    features: Sequence,
    make_classifier: Callable[[Mapping], object],
    grid: Mapping[str, Sequence],
    label: str,
    cutoffs: Sequence[float],
    recall: float = 80.0,
    parallel: int = 4,
) -> DataFrame:
    """(settings..., precision, auc): every combination of ``grid`` rated on all blocked folds.

    A combination is rated over the stacked validation rows of its fits, by the precision at the given recall and by the area under the
    curve. Feature stages do not depend on the grid: they are fitted once per fold and their rows written. Forests that differ in depth only
    are one fit: the shallower ones are the deepest, cut where their own fits would have ended. At most ``parallel`` fits run at once, each in a
    scheduler pool of its own, so that one fit's last tasks do not idle the cluster; every fit is distributed, and holds at most its
    model on the driver. Fits run fold by fold, the grid's last settings first, so large fits keep their rows in memory beside small ones.
    The first error ends those not yet begun. Scores are written as (settings, label, score), and one pass over them rates all combinations.
    """
    spark, names, combinations = folds[0][0].sparkSession, list(grid), list(product(*grid.values()))
    path = shared_path(spark, "grid-scores")
    make = lambda i: make_classifier(dict(zip(names, combinations[i])))

    def prepare(fold) -> tuple[DataFrame, DataFrame]:
        train, validation = fold
        rows = materialize(train)
        fitted = fit_stages(rows, features)
        vectors = lambda part: fitted.transform(part).select("features", label)
        return materialize_even(vectors(rows), near=[vector_to_array("features"), label]), materialize(vectors(validation))

    def rate(task) -> None:
        number, ((at, (train, validation)), group) = task
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % parallel}")
        try:
            deepest = fit_stages(train, [make(group[0])])
            models = {group[0]: deepest}
            forest = deepest.stages[-1]
            cut = [i for i in group[1:] if can_cut(make(i), forest, make(i).getMaxDepth())]
            if cut:
                models |= zip(cut, cut_forest(spark, forest, [make(i).getMaxDepth() for i in cut]))
            for i in group:
                scored = score(models.get(i) or fit_stages(train, [make(i)]), validation, keep=[label])
                settings = (F.lit(v).alias(n) for n, v in zip(names, combinations[i]))
                scored.select(*settings, label, "prob_pos").write.parquet(f"{path}/fit={i * len(folds) + at}")
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    def run_all(work: Callable, items: Sequence) -> list:
        with ThreadPoolExecutor(parallel) as pool:
            runs = [pool.submit(inheritable_thread_target(spark)(work), item) for item in items]
            try:
                for run in as_completed(runs):
                    run.result()
            except BaseException:
                pool.shutdown(wait=False, cancel_futures=True)
                raise
        return [run.result() for run in runs]

    prepared = run_all(prepare, folds)
    groups = _same_but_depth([make(i) for i in range(len(combinations))])[::-1]
    run_all(rate, list(enumerate(product(enumerate(prepared), groups))))
    scores = spark.read.parquet(path)
    rated = precision_at_recall(cutoff_sweep(scores, "prob_pos", label, cutoffs, names), recall, names)
    return rated.join(ranking_quality(scores, "prob_pos", label, names).select(*names, "auc"), names)
