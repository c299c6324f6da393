"""Joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.functions.dates import MICROS_PER_SECOND, epoch_micros
from lagline.operators.range_windows import HOUR, bin_start, null_time_bin
from lagline.operators.schema import add_prefix


def asof_join(
    events: DataFrame,
    observations: DataFrame,
    event_time: str,
    observation_time: str,
    event_key: str,
    observation_key: str,
    min_age: int = 3 * HOUR,
    max_age: int = 4 * HOUR,
    tie_break: str | None = None,
) -> DataFrame:
    """Left join of each event to the latest observation of its key aged in ``(min_age, max_age]`` seconds.

    With departure time t and the default ages the observation lies in ``[t - 4h, t - 3h)``. Every
    event gives exactly one row; without a match, or with a null key, the observation columns are
    null. Of several observations at one time the one with the greatest ``tie_break`` wins.

    Both sides are stacked and cut into (key, time bin) cells as wide as the age window; an
    observation, moved forward by ``min_age``, is sent to its own cell and the next one. The answer
    is a running "last observation" per cell: one shuffle, no pair of rows is ever built, and a
    station with very many rows is spread over its cells.
    """
    width = (max_age - min_age) * MICROS_PER_SECOND
    clash = set(events.columns) & set(observations.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; prefix one side first")
    # Plain columns under other names: the optimiser drops those that nobody asks for from shuffle and scan.
    own, theirs = ({c: f"__{side}{i}" for i, c in enumerate(df.columns)} for side, df in (("e", events), ("o", observations)))
    shifted = epoch_micros(observation_time) + min_age * MICROS_PER_SECOND
    tie = F.col(tie_break) if tie_break else F.lit(0)
    seen = (
        observations.select(
            F.col(observation_key).alias("__k"), shifted.alias("__s"), F.lit(1).alias("__side"), tie.alias("__tie"),
            *(F.col(f"`{c}`").alias(n) for c, n in theirs.items()),
        )
        .filter(F.col("__k").isNotNull() & F.col("__s").isNotNull())
        .select("*", F.explode(F.array(bin_start(F.col("__s"), width), bin_start(F.col("__s"), width) + width)).alias("__p"))
    )
    asked = events.select(
        F.col(event_key).alias("__k"), epoch_micros(event_time).alias("__s"), F.lit(0).alias("__side"),
        *(F.col(f"`{c}`").alias(n) for c, n in own.items()),
        # Rows without key or time match nothing; spread them instead of gathering them in one cell.
        F.when(F.col(event_key).isNotNull(), F.coalesce(bin_start(epoch_micros(event_time), width), null_time_bin()))
        .otherwise(null_time_bin()).alias("__p"),
    )
    stacked = asked.unionByName(seen, allowMissingColumns=True)
    # At equal moved time the event comes first: an observation exactly min_age old is too young.
    order = W.partitionBy("__k", "__p").orderBy("__s", "__side", "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = lambda c: F.last(F.when(F.col("__side") == 1, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(order)["v"]
    answered = stacked.select(
        "__side", "__s", *own.values(), latest("__s").alias("__at"), *(latest(n).alias(f"{n}_last") for n in theirs.values())).filter(F.col("__side") == 0)
    fresh = F.col("__at") >= F.col("__s") - width
    return answered.select(
        *(F.col(n).alias(c) for c, n in own.items()), *(F.when(fresh, F.col(f"{n}_last")).alias(c) for c, n in theirs.items()))


def asof_join_both_ends(
    events: DataFrame, observations: DataFrame, event_time: str, observation_time: str,
    keys: Mapping[str, str], observation_key: str, tie_break: str | None = None, **ages: int,
) -> DataFrame:
    """``asof_join`` once per prefix of ``keys`` (prefix -> event key), with prefixed observation columns."""
    result = events
    for prefix, event_key in keys.items():
        named = add_prefix(observations, prefix)
        result = asof_join(
            result, named, event_time, prefix + observation_time, event_key, prefix + observation_key,
            tie_break=prefix + tie_break if tie_break else None, **ages,
        )
    return result


def next_day_join(
    events: DataFrame, daily: DataFrame, event_key: str, event_date: Column, daily_key: str, daily_date: str
) -> DataFrame:
    """Left join of the summary of day d to the events of day d + 1 of the same key."""
    moved = daily.withColumns({"__k": F.col(daily_key), "__d": F.date_add(F.col(daily_date), 1)})
    dated = events.withColumn("__on", event_date.cast("date"))
    joined = dated.join(moved, (dated[event_key] == moved["__k"]) & (dated["__on"] == moved["__d"]), "left")
    return joined.drop("__k", "__d", "__on")


def missing_from_lookup(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, key) whose key the lookup does not have.

    Reduced to distinct keys before the anti join, so a frequent key costs one row.
    """
    keys = df.select(*by, key).filter(F.col(key).isNotNull()).distinct()
    return keys.join(lookup.select(F.col(lookup_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def used_only(df: DataFrame, key: str, users: DataFrame, user_key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``users`` (semi join on its distinct keys)."""
    used = users.select(F.col(user_key).alias("__key")).distinct()
    return df.join(used, F.col(key) == F.col("__key"), "left_semi")


def attach_lookup(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, cols: Sequence[str]) -> DataFrame:
    """Left join of a dimension; Spark broadcasts it only while it is below the session's size limit."""
    dim = lookup.select(F.col(lookup_key).alias("__key"), *cols)
    return df.join(dim, F.col(key) == F.col("__key"), "left").drop("__key")


def attach_group_averages(table: DataFrame, df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Inner join of the per-key average of ``df`` to a table of distinct keys."""
    averages = df.groupBy(key).agg(F.avg(value).alias(name))
    return table.join(averages, key)


def add_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Aggregate per group and join back.

    The aggregate combines before its shuffle and has one row per group, so unlike a whole-group
    window no task ever holds a large group.
    """
    keys = list(keys)
    grouped = df.groupBy(*keys).agg(*(expr.alias(name) for name, expr in stats.items()))
    renamed = grouped.select(*(F.col(k).alias(f"__j_{k}") for k in keys), *stats)
    joined = df.join(renamed, [df[k].eqNullSafe(renamed[f"__j_{k}"]) for k in keys], "left")
    return joined.drop(*(f"__j_{k}" for k in keys))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def join_predictions(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of per-model prediction tables on their common key, which must be unique in each table.

    A key that occurs twice in a table would multiply rows; it fails the query instead. The check is an aggregate on the join's own
    key, so each table is still shuffled once.
    """
    keys = list(keys)

    def unique(frame: DataFrame) -> DataFrame:
        others = [c for c in frame.columns if c not in keys]
        counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*others)).alias("__row"))
        checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("join_predictions: a key occurs more than once"))).otherwise(F.col("__row"))
        return counted.withColumn("__row", checked).select(*keys, *(F.col("__row")[c].alias(c) for c in others))

    joined = unique(frames[0])
    for frame in frames[1:]:
        joined = joined.join(unique(frame), keys)
    return joined


def nearest_neighbor(pairs: DataFrame, key: str, neighbor: str, distance: str, name: str = "nearest") -> DataFrame:
    """Closest neighbour per key of a table of pairs; equal distances go to the smaller neighbour."""
    return pairs.groupBy(key).agg(
        F.min_by(neighbor, F.struct(distance, neighbor)).alias(name), F.min(distance).alias(distance)
    )
