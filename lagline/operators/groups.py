"""Group aggregates, category inventories and functional-dependency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.operators.ranks import value_ranks
from lagline.session import materialize


def group_means(df: DataFrame, keys: Sequence[str], value: str, mean: str = "mean_value", maximum: str | None = None) -> DataFrame:
    aggs = [F.avg(value).alias(mean)]
    if maximum:
        aggs.append(F.max(value).alias(maximum))
    return df.groupBy(*keys).agg(*aggs)


def frequency(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per group (or overall, without keys) as ``n_<value>``.

    Exact counts first reduce to distinct (group, value) pairs, so a large group is spread over its
    values; ``approximate`` keeps one sketch per group instead.
    """
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(*keys).agg(*(count(v).alias(f"n_{v}") for v in values))


def distinct_sketches(df: DataFrame, keys: Sequence[str], period: str | Column, value: str, lg_size: int = 12) -> DataFrame:
    """(keys, period, sketch): a mergeable distinct-count sketch per group and period, to be written once and asked for any range of periods.

    A sketch takes some 2^``lg_size`` bytes at most; its relative error is about 1 / sqrt(2^``lg_size``). Null values count as none.
    """
    at = F.col(period) if isinstance(period, str) else period
    return df.groupBy(*keys, at.alias("period")).agg(F.hll_sketch_agg(value, lg_size).alias("sketch"))


def distinct_in_range(sketches: DataFrame, keys: Sequence[str], first, last) -> DataFrame:
    """(keys, n): estimated distinct values per group between two periods, both included, from stored sketches alone."""
    chosen = sketches.where(F.col("period").between(F.lit(first), F.lit(last)))
    return chosen.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct combinations, such as a lookup table."""
    return df.select(*cols).distinct()


def category_sets(df: DataFrame, keys: Sequence[str], category: str, values: str = "members", size: str = "n_members") -> DataFrame:
    """Sorted set of categories per group and its size, largest first.

    For categories from a bounded domain (carriers, airports). Reduced to distinct pairs first, so
    the set is built from as many rows as it has members.
    """
    pairs = df.select(*keys, category).filter(F.col(category).isNotNull()).distinct()
    sets = pairs.groupBy(*keys).agg(F.sort_array(F.collect_set(category)).alias(values))
    return sets.withColumn(size, F.size(values)).orderBy(F.col(size).desc(), *keys)


def latest_per_group(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """Rows with their group's greatest value, ties kept (rank 1); groups without any value keep their rows.

    The greatest value is aggregated before the shuffle and joined back, so a large group is never ordered in one task.
    """
    keys = list(keys)
    marked = df.withColumn("__value", F.col(value) if isinstance(value, str) else value)
    best = marked.groupBy(*keys).agg(F.max("__value").alias("__best")).select(*(F.col(k).alias(f"__j_{k}") for k in keys), "__best")
    same = [marked[k].eqNullSafe(best[f"__j_{k}"]) for k in keys] + [marked["__value"].eqNullSafe(best["__best"])]
    return marked.join(best, same, "left_semi").drop("__value")


def absence_runs(df: DataFrame, period: str, category: str, name: str = "absent", bucket: int = 1 << 15) -> DataFrame:
    """(``name``, first, last, periods): every longest run of periods that have rows, but none of the category.

    Periods are numbered in order, whatever their number, and the distinct (category, number) pairs are cut into buckets of numbers. Runs
    inside a bucket lie between neighbours there; those over bucket borders come from one row per category and bucket. So neither a
    category nor the set of periods is ever gathered, and absences are found without listing them. Null periods and categories are
    left out.
    """
    pairs = materialize(df.select(F.col(period).alias("__p"), F.col(category).alias("__c")).dropna("any").distinct(), "pairs")
    numbers = materialize(value_ranks(pairs.select("__p").distinct(), "__p").select("__p", F.col("n_before").cast("long").alias("__no")), "periods")
    seen = materialize(pairs.join(numbers, "__p").select("__c", "__no", F.floor(F.col("__no") / bucket).alias("__b")), "seen")

    inside = W.partitionBy("__c", "__b").orderBy("__no")
    between = seen.select("__c", (F.lag("__no").over(inside) + 1).alias("__from"), (F.col("__no") - 1).alias("__to"))
    edges = seen.groupBy("__c", "__b").agg(F.min("__no").alias("__low"), F.max("__no").alias("__high"))
    by_bucket = W.partitionBy("__c").orderBy("__b")  # one row per category and bucket
    across = edges.select("__c", (F.coalesce(F.lag("__high").over(by_bucket), F.lit(-1)) + 1).alias("__from"), (F.col("__low") - 1).alias("__to"))
    last = numbers.agg(F.max("__no").alias("last")).scalar()
    after = edges.groupBy("__c").agg((F.max("__high") + 1).alias("__from")).select("__c", "__from", last.alias("__to"))
    runs = between.unionByName(across).unionByName(after).where(F.col("__from") <= F.col("__to"))
    at = lambda no, as_: numbers.select(F.col("__no").alias(no), F.col("__p").alias(as_))
    return runs.join(at("__from", "first"), "__from").join(at("__to", "last"), "__to").select(
        F.col("__c").alias(name), "first", "last", (F.col("__to") - F.col("__from") + 1).alias("periods"))


def missing_categories(df: DataFrame, period: str, category: str, name: str = "absent") -> DataFrame:
    """(period, ``name``): categories seen in the table but not in that period, as rows: ``absence_runs`` listed period by period.

    As many rows as there are absences; the runs are the compact form.
    """
    known = df.select(period, category).dropna("any").select(period).distinct()
    periods = value_ranks(known, period).select(period, F.col("n_before").cast("long").alias("__no"))
    number = lambda edge: periods.select(F.col(period).alias(edge), F.col("__no").alias(f"__{edge}"))
    runs = absence_runs(df, period, category, name).join(number("first"), "first").join(number("last"), "last")
    return runs.select(name, F.explode(F.sequence("__first", "__last")).alias("__no")).join(periods, "__no").select(period, name)


def inconsistent_columns(df: DataFrame, key: str, *others: str) -> DataFrame:
    """Keys that occur with more than one combination of the other columns, with that number.

    Null is a value like any other in a combination.
    """
    combos = df.select(key, *others).distinct()
    return combos.groupBy(key).agg(F.count(F.lit(1)).alias("n_combinations")).filter(F.col("n_combinations") > 1)


def multiple_associations(df: DataFrame, key: str, associated: str) -> DataFrame:
    """Keys with more than one distinct non-null associated value."""
    counts = df.groupBy(key).agg(F.countDistinct(associated).alias("n"))
    return counts.filter(F.col("n") > 1).select(key)


def percent_different(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of all rows whose two values differ (a null never differs)."""
    return df.agg((F.count(F.when(F.col(a) != F.col(b), 1)) * F.lit(100.0) / F.count(F.lit(1))).alias("percent_different"))


def delay_component_shares(df: DataFrame, component: str, total: str) -> DataFrame:
    """One row: share of rows where the component is present, non-zero, and equal to the total delay."""
    share = lambda condition: F.count(F.when(condition, 1)) * F.lit(100.0) / F.count(F.lit(1))
    part = F.col(component)
    return df.agg(
        share(part.isNotNull()).alias("percent_present"),
        share(part != 0).alias("percent_nonzero"),
        share(part == F.col(total)).alias("percent_equal_total"),
    )


def null_accounting(df: DataFrame, value: str, **reasons: Column) -> DataFrame:
    """One row explaining the nulls of a column: total, one count per reason, and the unexplained rest.

    A null row counts for the first reason that holds, so the counts add up.
    """
    is_null = F.col(value).isNull()
    aggs = [F.count(F.when(is_null, 1)).alias("n_null")]
    earlier = F.lit(False)
    for name, condition in reasons.items():
        holds = F.coalesce(condition, F.lit(False))
        aggs.append(F.count(F.when(is_null & holds & ~earlier, 1)).alias(name))
        earlier = earlier | holds
    aggs.append(F.count(F.when(is_null & ~earlier, 1)).alias("unexplained"))
    return df.agg(*aggs)
