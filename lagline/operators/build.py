"""The table build as one call, and the evaluation of its scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from lagline.models.evaluate import clean_sweep, cutoff_sweep, precision_at_recall
from lagline.operators.fills import fill_zero
from lagline.operators.folds import assign_blocks
from lagline.operators.joins import asof_join_both_ends
from lagline.operators.profile import drop_by_null_percent
from lagline.operators.range_windows import delay_features
from lagline.operators.schema import numeric_columns


def build_features(
    flights: DataFrame, observations: DataFrame, time: str, observation_time: str, ends: Mapping[str, str], station: str, tie_break: str,
    delay: str, carrier: str, tail: str, row_id: str, sparse_percent: float = 90, blocks: int = 5, split: float = 0.8,
) -> DataFrame:
    """Weather at both ends, sparse columns dropped, gaps filled, lagged features, training and validation blocks.

    ``ends`` maps a column prefix to the flights' station column (the first one is the origin); ``observations`` have the columns ``station``,
    ``observation_time`` and readings. One row per block that holds the flight. Lazy but for the null shares, one row per
    column, which decide what is dropped.
    """
    joined = asof_join_both_ends(flights, observations, time, observation_time, dict(ends), station, tie_break)
    kept = drop_by_null_percent(joined, sparse_percent)
    readings = [c for c in numeric_columns(kept) if c not in flights.columns]
    filled = fill_zero(kept, readings)
    featured = delay_features(filled, time, delay, next(iter(ends.values())), carrier, tail, row_id)
    return assign_blocks(featured, time, blocks, split)


def evaluate(scored: DataFrame, score: str, label: str, cutoffs: Sequence[float], recall: float = 80.0, by: Sequence[str] = ()) -> DataFrame:
    """Precision at the given recall per group of ``by``, from a cleaned sweep over the cutoffs."""
    return precision_at_recall(clean_sweep(cutoff_sweep(scored, score, label, list(cutoffs), list(by))), recall, list(by))
