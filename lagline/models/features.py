"""Feature stages for classifiers and readable names of the features they produce."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import PCA, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known_levels(cols: Sequence[str], suffix: str = "_known") -> Callable[[DataFrame], SQLTransformer]:
    """A stage made of the training rows: levels they do not have, and nulls, become the last level, which is the base.

    Levels are a bounded domain, as each becomes a position of the feature vector.
    """

    def build(train: DataFrame) -> SQLTransformer:
        cases = []
        for c in cols:
            levels = sorted(r[0] for r in train.select(F.col(c).cast("string").alias(c)).filter(F.col(c).isNotNull()).distinct().collect())
            quoted = ["'" + level.replace("\\", "\\\\").replace("'", "\\'") + "'" for level in levels] or ["''"]
            cases.append(f"CASE WHEN CAST(`{c}` AS STRING) IN ({', '.join(quoted)}) THEN CAST(`{c}` AS STRING) ELSE {quoted[-1]} END AS `{c}{suffix}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(cases)} FROM __THIS__")

    return build


def index_stage(cols: Sequence[str], order: str = "alphabetAsc", invalid: str = "error", suffix: str = "_idx", source: str = "_known") -> StringIndexer:
    """Category -> index, by name or by falling frequency; levels come from ``known_levels``, others are an error."""
    return StringIndexer(inputCols=[c + source for c in cols], outputCols=[c + suffix for c in cols], stringOrderType=order, handleInvalid=invalid)


def one_hot_stage(cols: Sequence[str], drop_last: bool = True, suffix: str = "_idx") -> OneHotEncoder:
    return OneHotEncoder(inputCols=[c + suffix for c in cols], outputCols=[c + "_hot" for c in cols], dropLast=drop_last)


def assemble_stage(cols: Sequence[str], output: str = "features", invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid=invalid)


def scale_stage(source: str = "feat_vec", output: str = "features") -> StandardScaler:
    """Unit deviation without centring, so sparse vectors stay sparse."""
    return StandardScaler(inputCol=source, outputCol=output, withStd=True, withMean=False)


def feature_stages(categorical: Sequence[str], numeric: Sequence[str], scaled: bool = True, one_hot: bool = True) -> list[Estimator | Transformer | Callable]:
    """Known levels, index, one-hot, assemble and scale, as one list of stages to be fitted on training rows only."""
    stages: list = []
    inputs = []
    if categorical:
        stages += [known_levels(categorical), index_stage(categorical)]
        inputs = [c + "_idx" for c in categorical]
        if one_hot:
            stages.append(one_hot_stage(categorical))
            inputs = [c + "_hot" for c in categorical]
    inputs += list(numeric)
    if scaled:
        return [*stages, assemble_stage(inputs, "feat_vec"), scale_stage()]
    return [*stages, assemble_stage(inputs)]


def principal_components(df: DataFrame, cols: Sequence[str], k: int, output: str = "components"):
    """(fitted model, projected rows) of a PCA over standardised columns."""
    model = Pipeline(stages=[assemble_stage(cols, "feat_vec", "skip"), scale_stage("feat_vec", "__scaled"), PCA(k=k, inputCol="__scaled", outputCol=output)]).fit(df)
    return model, model.transform(df).drop("feat_vec", "__scaled")


def feature_names(transformed: DataFrame, vector: str = "feat_vec") -> list[str]:
    """Name of every vector position: the column, or ``column = level`` for a one-hot position."""
    attrs = transformed.schema[vector].metadata["ml_attr"]["attrs"]
    flat = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
    names = []
    for attr in flat:
        column, hot, level = attr["name"].partition("_hot_")
        names.append(f"{column} = {level}" if hot else attr["name"])
    return names


def feature_map(transformed: DataFrame, vector: str = "feat_vec") -> DataFrame:
    """(position, feature) of an assembled vector; as many rows as the vector is long."""
    names = feature_names(transformed, vector)
    return transformed.sparkSession.createDataFrame(list(enumerate(names)), "position int, feature string")


def base_levels(model, spark) -> DataFrame:
    """(column, base): the level per category that one-hot encoding leaves out, by the encoder's own sizes."""
    labels, rows = {}, []
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            labels.update(zip(stage.getOutputCols(), stage.labelsArray))
        if hasattr(stage, "categorySizes") and stage.getDropLast():
            rows += [(c.removesuffix("_idx"), labels[c][size - 1]) for c, size in zip(stage.getInputCols(), stage.categorySizes)]
    return spark.createDataFrame(rows, T.StructType().add("column", "string").add("base", "string"))


def level_index(df: DataFrame, col: str, name: str = "idx", by_frequency: bool = False) -> DataFrame:
    """(``col``, idx): index of every level, from 0, in alphabetic order or by falling frequency (then alphabetic).

    Reduced to the distinct levels before numbering. Levels are a bounded domain, as each becomes a
    position of the feature vector.
    """
    levels = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    order = W.orderBy(F.col("__n").desc(), col) if by_frequency else W.orderBy(col)
    return levels.select(col, (F.row_number().over(order) - 1).cast("double").alias(name))


def scale_by_deviation(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """x / sample deviation per column, as the scaling stage computes it, as plain columns."""
    spread = df.agg(F.struct(*(F.stddev_samp(c).alias(c) for c in cols)).alias("spread")).scalar()
    marked = df.select("*", spread.alias("__spread"))
    return marked.withColumns({c + suffix: F.col(c) / F.nullif(F.col(f"__spread.{c}"), F.lit(0.0)) for c in cols}).drop("__spread")
