"""Correlations, histograms, autocorrelation and other statistics, all over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.functions.dates import MICROS_PER_SECOND, epoch_micros
from lagline.operators.gram import correlation_matrix
from lagline.operators.range_windows import DAY, HOUR, bin_start
from lagline.operators.schema import columns_like


# With more columns, pairs are summed as matrices instead of by three aggregates each.
FEW_COLUMNS = 8


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate over rows with both values; null where a side is constant.

    The built-in aggregate divides by zero there and fails under ANSI rules.
    """
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def mean_and_spread(df: DataFrame, value: str, mean: str = "mean_value", spread: str = "std_value") -> DataFrame:
    return df.agg(F.avg(value).alias(mean), F.stddev_samp(value).alias(spread))


def indicator_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*(F.sum(c).alias(c) for c in cols))


def array_sums(df: DataFrame, col: str, name: str = "total") -> DataFrame:
    """(position, total): sum per position over an array column, combined before the shuffle."""
    return df.select(F.posexplode(col).alias("position", "__x")).groupBy("position").agg(F.sum("__x").alias(name))


def scalar_aggregates(df: DataFrame, **aggregates) -> DataFrame:
    """One row of named aggregates, such as the latest date or the mean of some rows."""
    return df.agg(*(expr.alias(name) for name, expr in aggregates.items()))


def pairwise_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of columns, all pairs in one pass."""
    pairs = list(combinations(cols, 2))
    packed = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*packed).select(F.inline(F.array(*(F.col(f"p{i}") for i in range(len(pairs))))))


def family_correlation(df: DataFrame, part: str) -> DataFrame:
    """Lower triangle of the correlation matrix of all columns whose name contains ``part``."""
    cols = columns_like(df, part)
    lower = pairwise_correlation(df, cols) if len(cols) <= FEW_COLUMNS else correlation_matrix(df, cols)
    return lower.select(F.col("b").alias("row_name"), F.col("a").alias("column_name"), "r")


def histogram(df: DataFrame, col: str, buckets: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bucket, low, high, n): equal-width buckets between the group's own minimum and maximum.

    The last bucket holds the maximum; empty buckets have no row.
    """
    keys = list(keys)
    value = F.col(col).cast("double")
    present = df.filter(F.col(col).isNotNull()).select(*keys, value.alias("__x"))
    range_ = F.struct(F.min("__x").alias("low"), F.max("__x").alias("high")).alias("__range")
    if keys:
        ranges = present.groupBy(*keys).agg(range_)
        renamed = ranges.select(*(F.col(k).alias(f"__j_{k}") for k in keys), "__range")
        ranged = present.join(renamed, [present[k].eqNullSafe(renamed[f"__j_{k}"]) for k in keys])
    else:
        ranged = present.select("*", present.agg(range_).scalar().alias("__range"))
    width = (F.col("__range.high") - F.col("__range.low")) / buckets
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("__x") - F.col("__range.low")) / F.nullif(width, F.lit(0.0))), F.lit(buckets - 1)))
    counted = ranged.groupBy(*keys, "__range", place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda i: F.col("__range.low") + width * i
    return counted.select(*keys, "bucket", edge(F.col("bucket")).alias("low"), edge(F.col("bucket") + 1).alias("high"), "n")


def with_previous(
    df: DataFrame, keys: Sequence[str], time: str, value: str, name: str, tie_break: str, bin_seconds: int = HOUR
) -> DataFrame:
    """Add the previous row's value within (keys), by time.

    Groups are cut into time bins; each bin starts from the last row of the bins before it (one row
    per group and bin), so ``lag`` never needs a whole group in one task. Needs non-null times.
    """
    keys = list(keys)
    width = bin_seconds * MICROS_PER_SECOND
    own = {c: f"__r{i}" for i, c in enumerate(df.columns)}
    narrow = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), epoch_micros(time).alias("__t"),
                       F.col(tie_break).alias("__tie"), F.col(value).alias("__v"), *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    key_names = [f"__k{i}" for i in range(len(keys))]
    rows = narrow.select("*", bin_start(F.col("__t"), width).alias("__p"), F.lit(1).alias("__side"))
    latest = F.max(F.struct("__t", "__tie", F.col("__v").alias("value"))).alias("__last")
    bins = rows.groupBy(*key_names, "__p").agg(latest)
    before = W.partitionBy(*key_names).orderBy("__p")  # one row per group and bin
    starts = bins.select(*key_names, "__p", F.lit(0).alias("__side"), F.lag("__last.value").over(before).alias("__v"))
    stacked = rows.unionByName(starts, allowMissingColumns=True)
    running = W.partitionBy(*key_names, "__p").orderBy("__side", "__t", "__tie")
    lagged = stacked.withColumn("__prev", F.lag("__v").over(running)).filter(F.col("__side") == 1)
    return lagged.select(*(F.col(n).alias(c) for c, n in own.items()), F.col("__prev").alias(name))


def group_autocorrelation(
    df: DataFrame, keys: Sequence[str], time: str, value: str, tie_break: str, more_than: int = 4, bin_seconds: int = HOUR
) -> DataFrame:
    """(keys, n, autocorrelation): lag-1 autocorrelation of groups with more than ``more_than`` rows.

    Null when either side of the pairs is constant. Rows lacking time, value or a key are left out.
    """
    keys = list(keys)
    clean = df.select(*keys, time, value, tie_break).dropna("any")
    pairs = with_previous(clean, keys, time, value, "__prev", tie_break, bin_seconds)
    r = correlation(F.col(value).cast("double"), F.col("__prev").cast("double"))
    grouped = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r.alias("autocorrelation"))
    return grouped.filter(F.col("n") > more_than)


def day_autocorrelation(df: DataFrame, key: str, time: str, value: str, tie_break: str, more_than: int = 4) -> DataFrame:
    """``group_autocorrelation`` per key and calendar day."""
    dated = df.withColumn("date_day", F.date_trunc("day", F.col(time)).cast("date"))
    return group_autocorrelation(dated, [key, "date_day"], time, value, tie_break, more_than)


def autocorrelation_function(df: DataFrame, time: str, value: str, lags: int = 50) -> DataFrame:
    """(lag, autocorrelation) of the daily mean series for lags 1..``lags``.

    The table is reduced to one row per day first; only that series is numbered and self-joined.
    """
    daily = df.groupBy(F.to_date(time).alias("day")).agg(F.avg(F.col(value).cast("double")).alias("x"))
    daily = daily.filter(F.col("day").isNotNull() & F.col("x").isNotNull())
    # One row per calendar day: bounded by the time span, so one window task is enough.
    numbered = daily.select("day", "x", F.row_number().over(W.orderBy("day")).alias("pos"))
    mean = daily.agg(F.avg("x").alias("mean")).scalar()
    centred = numbered.select("pos", (F.col("x") - mean).alias("d"))
    shifted = centred.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col("pos"), F.col("d").alias("earlier"))
    shifted = shifted.select("lag", "earlier", (F.col("pos") + F.col("lag")).alias("pos"))
    power = centred.agg(F.sum(F.col("d") * F.col("d")).alias("power")).scalar()
    sums = shifted.join(centred, "pos").groupBy("lag").agg(F.sum(F.col("earlier") * F.col("d")).alias("cross"))
    return sums.select("lag", (F.col("cross") / power).alias("autocorrelation"))


def z_scores(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add (x - mean) / sample deviation per column; the two numbers come from a scalar subquery."""
    moments = df.agg(
        F.struct(*(F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in cols)).alias("moments")
    )
    marked = df.select("*", moments.scalar().alias("__moments"))
    scored = {c + suffix: (F.col(c) - F.col(f"__moments.{c}.mean")) / F.nullif(F.col(f"__moments.{c}.std"), F.lit(0.0)) for c in cols}
    return marked.withColumns(scored).drop("__moments")


def class_balance(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, positives, positive_share)."""
    positives = F.count(F.when(F.col(label) > 0, 1))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), positives.alias("positives"), (positives / F.count(F.lit(1))).alias("positive_share")
    )


def utc_offsets(df: DataFrame, station: str, state: str, local: str, utc: str, seconds: str = "offset_seconds") -> DataFrame:
    """(station, state, offset): largest local minus UTC difference per station, else of its state.

    Two small aggregates: per station, then per state over the stations.
    """
    gap = (epoch_micros(local) - epoch_micros(utc)) / MICROS_PER_SECOND
    per_station = df.groupBy(station, state).agg(F.max(gap).cast("long").alias("__own"))
    per_state = per_station.groupBy(state).agg(F.max("__own").alias("__state_max")).withColumnRenamed(state, "__state")
    joined = per_station.join(per_state, per_station[state] == per_state["__state"], "left")
    return joined.select(station, state, F.coalesce("__own", "__state_max").alias(seconds))


def apply_utc_offsets(df: DataFrame, offsets: DataFrame, station: str, local: str, name: str, seconds: str = "offset_seconds") -> DataFrame:
    """Add the UTC time in epoch microseconds of a local time, null where no offset is known."""
    known = offsets.select(F.col(station).alias("__station"), F.col(seconds).alias("__offset"))
    joined = df.join(known, F.col(station) == F.col("__station"), "left")
    return joined.withColumn(name, epoch_micros(local) - F.col("__offset") * MICROS_PER_SECOND).drop("__station", "__offset")
