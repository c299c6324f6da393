"""Sampling and class balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.functions.scalars import hash_score


def sample_fraction(df: DataFrame, key: str | Column, fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, chosen by their key, so the sample does not depend on partitioning."""
    return df.filter(hash_score(key, seed) < fraction)


def sample_at_most(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows, all of them when the table has no more.

    The fraction is a scalar subquery and the choice depends on the key only, so the sample is the
    same however the table is partitioned.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.filter(hash_score(key, seed) < F.lit(float(rows)) / F.nullif(total, F.lit(0)))


def sample_exactly(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows, or all if there are fewer: those whose keys have the smallest hashes, the same under any partitioning.

    The hash at which the sample ends is found by exact counts per prefix of the hash, in two steps of 16 bits each; of the
    rows that share its 32 bits, one in four thousand million, only as many as are missing are taken in order. Nothing else is sorted. Rows of one key are
    told apart by their other columns, which must have an order; the key is meant to be a row id.
    """
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))

    def border(counted: DataFrame, length: int, before: Column) -> DataFrame:
        """One row: the prefix in which the sample ends and the rows before it."""
        counts = counted.groupBy(F.substring("__h", 1, length).alias("at")).agg(F.count(F.lit(1)).alias("__n"))
        running = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # one row per prefix of 16 bits
        placed = counts.select("at", (before + F.coalesce(F.sum("__n").over(running), F.lit(0))).alias("before"))
        return placed.where(F.col("before") < rows).agg(F.max(F.struct("at", "before")).alias("border"))

    coarse = border(hashed, 4, F.lit(0)).scalar()
    near = hashed.where(F.substring("__h", 1, 4) == coarse["at"])
    fine = border(near, 8, coarse["before"]).scalar()
    marked = hashed.select("*", fine.alias("__border"))
    at = F.substring("__h", 1, 8)
    below = marked.where(at < F.col("__border.at")).drop("__h", "__border")
    last = marked.where(at == F.col("__border.at"))
    order = W.orderBy("__h", *(F.col(f"`{c}`") for c in df.columns))  # rows that share 32 bits of their hash
    ends = last.withColumn("__no", F.row_number().over(order)).where(F.col("__no") <= rows - F.col("__border.before"))
    return below.unionByName(ends.drop("__h", "__border", "__no"))


def balance_by_keep(df: DataFrame, label: str, score: Column, keep: float = 0.2) -> DataFrame:
    """All positive rows and the negative rows whose uniform ``score`` is below ``keep``."""
    return df.filter((F.col(label) > 0) | ((F.col(label) < 1) & (score < keep)))


def balance_by_ratio(df: DataFrame, label: str, score: Column) -> DataFrame:
    """Positives and as many negatives, sampled at the odds p / (1 - p) of the table itself."""
    odds = df.agg((F.count(F.when(F.col(label) > 0, 1)) / F.nullif(F.count(F.when(F.col(label) < 1, 1)), F.lit(0))).alias("odds"))
    marked = df.select("*", F.coalesce(odds.scalar(), F.lit(1.0)).alias("__odds"))
    return marked.filter((F.col(label) > 0) | ((F.col(label) < 1) & (score < F.col("__odds")))).drop("__odds")


def random_split(df: DataFrame, key: str | Column, weights: list[float], seed: int = 42) -> list[DataFrame]:
    """Split by weights, for data without time order; the key decides, so parts are disjoint whatever the partitioning."""
    score, total, low, parts = hash_score(key, seed), sum(weights), 0.0, []
    for i, weight in enumerate(weights):
        high = low + weight / total
        parts.append(df.filter(score >= low) if i == len(weights) - 1 else df.filter((score >= low) & (score < high)))
        low = high
    return parts


def hash_split(df: DataFrame, key: str, train: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, rest) decided by the key, repeatable after lost tasks."""
    score = hash_score(key, seed)
    return df.filter(score < train), df.filter(score >= train)
