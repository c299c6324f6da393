"""Feature selection from fitted models and vote tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.models.features import feature_names

# Fixed value: squared weight above which a feature counts as significant.
MIN_SQUARED_WEIGHT = 1e-4


def coefficient_table(spark: SparkSession, models: Sequence[PipelineModel], transformed: Sequence[DataFrame], vector: str = "feat_vec") -> DataFrame:
    """(fold, feature, weight) of fitted linear models; as many rows as there are coefficients."""
    rows = []
    for fold, (model, frame) in enumerate(zip(models, transformed)):
        weights = model.stages[-1].coefficients.toArray().tolist()
        rows += [(fold, name, weight) for name, weight in zip(feature_names(frame, vector), weights)]
    return spark.createDataFrame(rows, "fold int, feature string, weight double")


def stable_features(weights: DataFrame, min_votes: int = 2, min_squared: float = MIN_SQUARED_WEIGHT) -> DataFrame:
    """(feature, votes): features significant in at least ``min_votes`` folds."""
    significant = weights.filter(F.col("weight") * F.col("weight") > min_squared)
    votes = significant.groupBy("feature").agg(F.countDistinct("fold").cast("int").alias("votes"))
    return votes.filter(F.col("votes") >= min_votes)


def importance_table(spark: SparkSession, model: PipelineModel, transformed: DataFrame, vector: str = "features") -> DataFrame:
    """(feature, importance) of a fitted tree or forest, highest first."""
    importances = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(feature_names(transformed, vector), importances))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def top_features(importances: DataFrame, n: int) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def levels_from_votes(votes: DataFrame, min_votes: int = 2) -> DataFrame:
    """(column, is_numeric, levels) of the features with enough votes.

    A name ``i: COLUMN = LEVEL`` selects a level of a category, a bare name is a numeric feature
    and has no levels.
    """
    named = votes.filter(F.col("votes") >= min_votes).select(F.regexp_replace("feature", r"^\d+: ", "").alias("name"))
    parts = F.split("name", " = ", 2)
    split = named.select(parts[0].alias("column"), F.get(parts, F.lit(1)).alias("level"))
    return split.groupBy("column").agg(
        (F.count("level") == 0).alias("is_numeric"), F.sort_array(F.collect_set("level")).alias("levels")
    )
