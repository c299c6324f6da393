"""Blocked time-series cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.functions.dates import epoch_micros
from lagline.operators.ranks import order_statistics, values_at


@dataclass(frozen=True)
class Block:
    """Percentile range of one fold and role; only validation excludes its lower end."""

    fold: int
    role: str
    low: float
    high: float

    def holds(self, rank: Column) -> Column:
        above = rank >= self.low if self.role == "train" else rank > self.low
        return above & (rank <= self.high)


def block_bounds(blocks: int = 5, split: float = 0.8) -> list[Block]:
    """Train ranges tile the percentiles up to the last validation slice; each is followed by its validation slice.

    A row exactly on an inner boundary belongs to two train ranges.
    """
    slice_size = (1 - split) * 1 / blocks
    area = 1 - slice_size
    result = []
    for i in range(blocks):
        start, stop = area * i / blocks, area * (i + 1) / blocks
        result += [Block(i, "train", start, stop), Block(i, "validation", stop, stop + slice_size)]
    return result


# Largest position k of n sorted rows whose percentile k / (n - 1) does not exceed, or lies below, a share.
# The product may be off by a rounding step, so its neighbours are compared the way percentiles are.
def _last_at_most(share: float):
    def place(size: Column) -> Column:
        steps = F.greatest(size - 1, F.lit(1))
        near = F.floor(steps * share)
        return F.least(F.when((near + 1) / steps <= share, near + 1).when(near / steps <= share, near).otherwise(near - 1), size - 1)

    return place


def _last_below(share: float):
    def place(size: Column) -> Column:
        steps = F.greatest(size - 1, F.lit(1))
        near = F.ceil(steps * share)
        return F.least(F.when(near / steps < share, near).when((near - 1) / steps < share, near - 1).otherwise(near - 2), size - 1)

    return place


def _edges(df: DataFrame, time: str, bounds: list[Block]) -> DataFrame:
    """One row with two edges per block: the last time before it and the last time in it.

    Percentile is a step function of time, so a block is a time range and no row needs its own rank.
    An edge is a struct around its time, null where no row lies there.
    """
    places = {}
    for i, b in enumerate(bounds):
        places[f"{i} before"] = _last_below(b.low) if b.role == "train" else _last_at_most(b.low)
        places[f"{i} last"] = _last_at_most(b.high)
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # Microseconds of any year a calendar is kept for are whole numbers that a double holds.
        listed = [(id_, int(at) if at is not None else None) for _, id_, _, _, at in order_statistics(df, {time: epoch_micros(time)}, places, nulls_first=True)]
        found = df.sparkSession.createDataFrame(listed, "id string, micros long").select("id", F.timestamp_micros("micros").cast(kind).alias("value"))
    else:
        found = values_at(df, time, places)
    edge = lambda name: F.max(F.when(F.col("id") == name, F.struct(F.col("value").alias("at"))))
    return found.agg(F.struct(*(edge(name).alias(name.replace(" ", "_")) for name in places)).alias("edges"))


def _within(time: Column, before: Column, last: Column) -> Column:
    """Later than ``before`` (a missing edge: from the start) and not later than ``last``; null times come first."""
    after = before.isNull() | (time.isNotNull() & (before["at"].isNull() | (time > before["at"])))
    until = last.isNotNull() & (time.isNull() | (last["at"].isNotNull() & (time <= last["at"])))
    return F.coalesce(after, F.lit(False)) & F.coalesce(until, F.lit(False))


def assign_blocks(df: DataFrame, time: str, blocks: int = 5, split: float = 0.8) -> DataFrame:
    """``df`` with ``fold`` and ``role``; one output row per block that holds the row.

    The data itself is neither sorted nor shuffled: the edges of the blocks come from a scalar subquery.
    """
    bounds = block_bounds(blocks, split)
    marked = df.select("*", _edges(df, time, bounds).scalar().alias("__edges"))
    hits = [
        F.when(
            _within(F.col(time), F.col(f"__edges.{i}_before"), F.col(f"__edges.{i}_last")),
            F.struct(F.lit(b.fold).alias("fold"), F.lit(b.role).alias("role")),
        )
        for i, b in enumerate(bounds)
    ]
    # Plain explode and filter stay in generated code; array functions with lambdas would not.
    placed = marked.select(*df.columns, F.explode(F.array(*hits)).alias("__hit")).filter(F.col("__hit").isNotNull())
    return placed.select(*df.columns, "__hit.fold", "__hit.role")


def block_ranges(df: DataFrame, time: str, blocks: int = 5, split: float = 0.8) -> DataFrame:
    """(fold, role, first_time, last_time): two rows per fold."""
    placed = assign_blocks(df.select(time), time, blocks, split)
    return placed.groupBy("fold", "role").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def block_frames(
    df: DataFrame, time: str, blocks: int = 5, split: float = 0.8, times: DataFrame | None = None
) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) per fold as filters with literal bounds, so they reach the scan.

    Runs one job for the edges of the blocks; only those come to the driver. ``times`` may name a
    cheaper table with the same times, such as the rows before features were added.
    """
    bounds = block_bounds(blocks, split)
    edges = _edges(df if times is None else times, time, bounds).first()["edges"]
    literal = lambda edge: F.lit(edge["at"]).cast(df.schema[time].dataType)

    def rows(i: int) -> DataFrame:
        before, last = edges[f"{i}_before"], edges[f"{i}_last"]
        if last is None:
            return df.filter(F.lit(False))
        within = F.col(time).isNull() if last["at"] is None else F.col(time) <= literal(last)
        if before is None:
            return df.filter(F.col(time).isNull() | within)
        after = F.col(time).isNotNull() if before["at"] is None else F.col(time) > literal(before)
        return df.filter(after & within)

    return [(rows(2 * i), rows(2 * i + 1)) for i in range(blocks)]


def split_by_year(df: DataFrame, year: str | Column, holdout: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(earlier years, hold-out year, later years and rows without one); each row is in one part.

    A partition prune when the table is stored by that column.
    """
    year = F.col(year) if isinstance(year, str) else year
    return df.filter(year < holdout), df.filter(year == holdout), df.filter(year.isNull() | (year > holdout))
