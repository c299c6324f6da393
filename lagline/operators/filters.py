"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; rows where it is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def where_nulls(df: DataFrame, null: Sequence[str] = (), not_null: Sequence[str] = ()) -> DataFrame:
    """Rows null in all of ``null`` and filled in all of ``not_null``."""
    for name in null:
        df = df.filter(F.col(name).isNull())
    for name in not_null:
        df = df.filter(F.col(name).isNotNull())
    return df


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(subset) if subset else None)


def keep_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def drop_values(df: DataFrame, col: str, values: Sequence, keep_nulls: bool = False) -> DataFrame:
    """Rows whose value is not listed; as in SQL a null is neither listed nor unlisted and goes, unless ``keep_nulls``."""
    unlisted = ~F.col(col).isin(list(values))
    return df.filter(unlisted | F.col(col).isNull() if keep_nulls else unlisted)


def keep_containing(df: DataFrame, col: str, part: str) -> DataFrame:
    return df.filter(F.col(col).contains(part))


def keep_different(df: DataFrame, a: str, b: str, null_safe: bool = False) -> DataFrame:
    """Rows where two columns differ; ``null_safe`` also counts a null on one side as a difference."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) != F.col(b))


def filter_min_max(df: DataFrame, col: str, low: float, high: float | None = None) -> DataFrame:
    """Rows in the closed band [low, high], open above without ``high``."""
    return df.filter(F.col(col) >= low if high is None else F.col(col).between(low, high))


def split_by_report_type(df: DataFrame, col: str = "REPORT_TYPE", daily: str = "SOD", monthly: str = "SOM") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily, monthly, other) observations; the type is trimmed before comparing, rows without one are in the last part."""
    trimmed = df.withColumn(col, F.trim(col))
    return (
        trimmed.filter(F.col(col) == daily),
        trimmed.filter(F.col(col) == monthly),
        trimmed.filter(F.col(col).isNull() | ~F.col(col).isin(daily, monthly)),
    )


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows of a total order (a distributed top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def top_groups(df: DataFrame, key: str, value: str, n: int, name: str = "mean_value", ascending: bool = False) -> DataFrame:
    """The n groups with the highest (or lowest) average; equal averages in key order."""
    averages = df.groupBy(key).agg(F.avg(value).alias(name))
    order = F.col(name).asc() if ascending else F.col(name).desc()
    return averages.orderBy(order, F.col(key)).limit(n)
