"""Imputation of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.functions.dates import MICROS_PER_SECOND, epoch_micros
from lagline.operators.profile import null_counts
from lagline.operators.range_windows import HOUR, bin_start, null_time_bin


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls of the listed columns become 0, in one projection."""
    return df.fillna(0, subset=list(cols))


def fill_zero_if_sparse(df: DataFrame, cols: Sequence[str], below_percent: float = 1.0) -> DataFrame:
    """Zero-fill only those columns with less than ``below_percent`` nulls.

    The null shares come from a scalar subquery, so the plan stays one query.
    """
    shares = df.agg(F.struct(*(F.avg(F.col(c).isNull().cast("double") * 100).alias(c) for c in cols)).alias("shares"))
    marked = df.select("*", shares.scalar().alias("__shares"))
    filled = {
        c: F.when(F.col(c).isNull() & (F.col(f"__shares.{c}") < below_percent), F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c in cols
    }
    return marked.withColumns(filled).drop("__shares")


def fill_first(df: DataFrame, cols: Sequence[str], order: str, tie_break: str) -> DataFrame:
    """Replace nulls by the earliest value of the column, from that value's time on.

    This is what a running "first non-null" over the whole table gives. It only depends on the
    earliest filled row per column, a scalar subquery here, so nothing is sorted. Rows without an
    order value come last.
    """
    late = F.col(order).isNull()
    rank = F.struct(late.alias("late"), F.col(order).alias("at"), F.col(tie_break).alias("tie"))
    firsts = df.agg(
        F.struct(
            *(
                F.min(F.when(F.col(c).isNotNull(), F.struct(rank.alias("rank"), F.col(c).alias("value")))).alias(c)
                for c in cols
            )
        ).alias("firsts")
    )
    marked = df.select("*", firsts.scalar().alias("__firsts"))
    filled = {}
    for c in cols:
        first = F.col(f"__firsts.{c}")
        reached = late | (F.col(order) >= first["rank"]["at"])
        filled[c] = F.coalesce(F.col(c), F.when(reached, first["value"]))
    return marked.withColumns(filled).drop("__firsts")


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], tie_break: str, bin_seconds: int = HOUR
) -> DataFrame:
    """Replace nulls by the nearest earlier value of the same key.

    Keys are cut into time bins. Each bin starts from the last value of the bins before it, taken
    from a table with one row per key and bin, so a hot key is filled by many tasks. Rows without
    an order value are left as they are.
    """
    width = bin_seconds * MICROS_PER_SECOND
    keys = list(keys)
    key_names = [f"__k{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, key_names)]
    at = epoch_micros(order)
    own = {c: f"__r{i}" for i, c in enumerate(df.columns) if c not in cols}
    rows = df.select(
        *key_cols, at.alias("__t"), F.col(tie_break).alias("__tie"), F.lit(1).alias("__side"),
        F.coalesce(bin_start(at, width), null_time_bin()).alias("__p"),
        *(F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)), *(F.col(f"`{c}`").alias(n) for c, n in own.items()),
    )
    timed = df.select(*key_cols, at.alias("__t"), F.col(tie_break).alias("__tie"), *(F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)))
    latest = [
        F.max(F.when(F.col(f"__v{i}").isNotNull(), F.struct("__t", "__tie", F.col(f"__v{i}").alias("value")))).alias(f"__b{i}")
        for i in range(len(cols))
    ]
    bins = timed.filter(F.col("__t").isNotNull()).groupBy(*key_names, bin_start(F.col("__t"), width).alias("__p")).agg(*latest)
    before = W.partitionBy(*key_names).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = bins.select(
        *key_names, "__p", F.col("__p").alias("__t"), F.lit(0).alias("__side"),
        *(F.last(F.col(f"__b{i}.value"), ignorenulls=True).over(before).alias(f"__v{i}") for i in range(len(cols))),
    )
    stacked = rows.unionByName(starts, allowMissingColumns=True)
    running = W.partitionBy(*key_names, "__p").orderBy("__side", "__t", "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    value = lambda i: F.when(F.col("__t").isNull(), F.col(f"__v{i}")).otherwise(F.last(f"__v{i}", ignorenulls=True).over(running))
    filled = stacked.select("__side", *own.values(), *(value(i).alias(f"__f{i}") for i in range(len(cols)))).filter(F.col("__side") == 1)
    position = {c: i for i, c in enumerate(cols)}
    return filled.select(*(F.col(f"__f{position[c]}").alias(c) if c in position else F.col(own[c]).alias(c) for c in df.columns))


def track_imputation(before: DataFrame, after: DataFrame, cols: Sequence[str], step: str) -> DataFrame:
    """(step, column, null_percent_before, null_percent_after) from one aggregate on each side."""
    old = null_counts(before, cols).select("column", F.col("null_percent").alias("null_percent_before"))
    new = null_counts(after, cols).select("column", F.col("null_percent").alias("null_percent_after"))
    return old.join(new, "column").select(F.lit(step).alias("step"), "column", "null_percent_before", "null_percent_after")
