"""Null profiling and table descriptions: one aggregate over all columns, reshaped to one row each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _per_column(df: DataFrame, cols: Sequence[str], stats: Mapping[str, object]) -> DataFrame:
    """(column, stats...) where each stat maps a column name to an aggregate."""
    packed = [F.struct(F.lit(c).alias("column"), *(make(c).alias(n) for n, make in stats.items())).alias(f"c{i}") for i, c in enumerate(cols)]
    return df.agg(*packed).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(cols))))))


def _missing(df: DataFrame, name: str, count_nan: bool) -> Column:
    missing = F.col(name).isNull()
    if count_nan and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(name)
    return missing


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, count_nan: bool = False) -> DataFrame:
    """(column, n_null, null_percent)."""
    cols = list(cols) if cols is not None else df.columns
    rows = _per_column(
        df, cols, {"n_null": lambda c: F.count(F.when(_missing(df, c, count_nan), 1)), "n_rows": lambda c: F.count(F.lit(1))}
    )
    percent = F.col("n_null") * F.lit(100.0) / F.nullif(F.col("n_rows"), F.lit(0))
    return rows.select("column", "n_null", percent.alias("null_percent"))


def null_profile(df: DataFrame, count_nan: bool = True, skip_times: bool = True) -> DataFrame:
    """(column, n_null, null_percent), highest first; NaN counts as missing, time columns may be skipped."""
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    cols = [f.name for f in df.schema.fields if not (skip_times and isinstance(f.dataType, times))]
    return null_counts(df, cols, count_nan).orderBy(F.col("null_percent").desc(), "column")


def null_percent(df: DataFrame, col: str) -> DataFrame:
    """One row with the null share of one column."""
    return df.agg((F.avg(F.col(col).isNull().cast("double")) * 100).alias("null_percent"))


def columns_above_null_percent(df: DataFrame, threshold: float = 90, inclusive: bool = True) -> list[str]:
    """Names of sparse columns; only the per-column shares come to the driver."""
    share = F.col("null_percent")
    return [r.column for r in null_counts(df).filter(share >= threshold if inclusive else share > threshold).collect()]


def drop_by_null_percent(df: DataFrame, threshold: float = 90, inclusive: bool = True) -> DataFrame:
    return df.drop(*columns_above_null_percent(df, threshold, inclusive))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value."""
    return drop_by_null_percent(df, 100)


def coverage_keep(df: DataFrame, share: float = 0.25, always: str = "Daily") -> DataFrame:
    """(column, n) of columns with at least ``share`` of the best column's values, or named ``always``."""
    counts = _per_column(df, df.columns, {"n": lambda c: F.count(F.col(c))})
    best = counts.agg(F.max("n").alias("best")).scalar()
    return counts.filter((F.col("n") >= best * share) | F.col("column").contains(always))


def describe_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, stddev, min, max), one row per column, highest count first.

    Mean and deviation are null for columns that are not numeric; min and max are text.
    """
    cols = list(cols) if cols is not None else df.columns
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    number = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    rows = _per_column(
        df, cols,
        {
            "count": lambda c: F.count(F.col(c)),
            "mean": lambda c: F.avg(number(c)),
            "stddev": lambda c: F.stddev_samp(number(c)),
            "min": lambda c: F.min(c).cast("string"),
            "max": lambda c: F.max(c).cast("string"),
        },
    )
    return rows.orderBy(F.col("count").desc(), "column")
