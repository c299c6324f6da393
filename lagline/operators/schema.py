"""Projection and schema operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the listed columns; all must exist."""
    missing = set(cols) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*cols)


def drop_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop those of the listed columns that are present."""
    return df.drop(*cols)


def cast_schema(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Cast and keep only the mapped columns, in mapping order.

    Values that do not fit become null, or raise when ``strict``.
    """
    cast = lambda c, t: F.col(c).cast(t) if strict else F.col(c).try_cast(t)
    return df.select(*(cast(c, t).alias(c) for c, t in types.items()))


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Prefix every column name in one projection."""
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def reorder_first(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chosen columns first, the rest in their old order."""
    return df.select(*(F.col(f"`{c}`") for c in (*cols, *(c for c in df.columns if c not in set(cols)))))


def columns_of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.StringType)


def columns_like(df: DataFrame, part: str | None = None, prefix: str | None = None, pattern: str | None = None) -> list[str]:
    """Columns whose name contains ``part``, starts with ``prefix`` and matches ``pattern``, where given."""
    return [
        c
        for c in df.columns
        if (part is None or part in c) and (prefix is None or c.startswith(prefix)) and (pattern is None or re.search(pattern, c))
    ]


def with_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(exprs))


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null, as_long, as_double, inferred) for string columns, from one pass.

    The narrowest type that fits every non-null value wins; a column of nulls stays a string.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        # Casts alone accept more than literals do, such as "1.0" as a long or "1d" as a double.
        text = F.trim(c)
        whole = F.when(text.rlike(_INTEGER), text).try_cast("bigint")
        real = F.when(text.rlike(_REAL), text).try_cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.col(c)).alias("non_null"),
                F.count(whole).alias("as_long"),
                F.count(real).alias("as_double"),
            ).alias(f"c{i}")
        )
    rows = df.agg(*aggs).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(cols))))))
    fits = lambda n: (F.col(n) == F.col("non_null")) & (F.col("non_null") > 0)
    kind = F.when(fits("as_long"), "bigint").when(fits("as_double"), "double").otherwise("string")
    return rows.withColumn("inferred", kind)


def dimensions(df: DataFrame) -> DataFrame:
    """One row (n_columns, n_rows)."""
    return df.agg(F.lit(len(df.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n_rows"))


def track_dimensions(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(position, step, n_columns, n_rows) for the states of a table after each step."""
    rows = [dimensions(df).select(F.lit(i).alias("position"), F.lit(s).alias("step"), "n_columns", "n_rows") for i, (s, df) in enumerate(steps)]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def schema_diff(a: DataFrame, b: DataFrame) -> dict[str, list]:
    """Columns of one side only, shared columns, and shared columns whose types differ."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    shared = [c for c in a.columns if c in right]
    return {
        "only_left": [c for c in a.columns if c not in right],
        "only_right": [c for c in b.columns if c not in left],
        "shared": shared,
        "type_changed": [(c, left[c], right[c]) for c in shared if left[c] != right[c]],
    }
