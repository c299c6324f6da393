"""Column functions for cleaning, labels and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from lagline.functions.dates import as_column


def binary_label(delay: str | Column, threshold: float = 15) -> Column:
    """1 when the delay reaches the threshold, 0 below it, null for a null delay."""
    return (as_column(delay) >= threshold).cast("int")


def text_label(delay: str | Column, threshold: float = 15, late: str = "Delayed", on_time: str = "On time") -> Column:
    return F.when(as_column(delay) >= threshold, late).otherwise(on_time)


def composite_label(
    delay: str | Column, flag: str | Column, difference: str | Column, threshold: float = 15, low: float = 0, high: float = 120,
) -> Column:
    """1 when late or flagged, as long as the time difference to the earlier flight lies within [low, high]."""
    late = (as_column(delay) >= threshold) | (as_column(flag) == 1)
    return F.when(late & as_column(difference).between(low, high), 1).otherwise(0)


def threshold_zero(value: str | Column, threshold: float) -> Column:
    """The value where it reaches the threshold, else 0."""
    value = as_column(value)
    return F.when(value >= threshold, value).otherwise(0)


def guarded_ratio(num: str | Column, den: str | Column, minimum: float = 2) -> Column:
    """num / den where both reach ``minimum``, else 0."""
    num, den = as_column(num), as_column(den)
    return F.when((num >= minimum) & (den >= minimum), num / den).otherwise(0.0)


def keep_levels(value: str | Column, levels: Sequence, other: str) -> Column:
    """Listed levels as they are, all others and nulls as ``other``."""
    value = as_column(value).cast("string")
    return F.when(value.isin([str(level) for level in levels]), value).otherwise(other)


def contains_flag(text: str | Column, part: str) -> Column:
    return F.when(as_column(text).contains(part), 1).otherwise(0)


def bucket_text(group: str | Column, width: int = 15, unit: str = "min") -> Column:
    """Label of a delay group, such as ``30 min`` for group 2."""
    return F.concat((as_column(group) * width).cast("string"), F.lit(f" {unit}"))


def squared(value: str | Column) -> Column:
    value = as_column(value)
    return value * value


def positive_probability(probability: str | Column = "probability") -> Column:
    """Probability of class 1 out of a classifier's vector."""
    return vector_to_array(as_column(probability))[1]


def cutoff_label(score: str | Column, cutoff: float, strict: bool = False) -> Column:
    """1 when the score reaches (``strict``: exceeds) the cutoff, else 0."""
    score = as_column(score)
    return F.when(score > cutoff if strict else score >= cutoff, 1).otherwise(0)


def weighted_score(weights: Mapping[str, float]) -> Column:
    """Sum of weight times column, added in the order given."""
    total = None
    for name, weight in weights.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def hash_score(key: str | Column, seed: int = 42) -> Column:
    """A uniform score in [0, 1) of 53 bits that depends on the key only.

    Unlike ``rand`` it does not change with partitioning or when lost tasks run again.
    """
    return F.shiftrightunsigned(F.xxhash64(as_column(key), F.lit(seed)), 11) / F.lit(float(1 << 53))


def haversine_km(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column) -> Column:
    """Great-circle distance in kilometres between points in degrees."""
    lat1, lon1, lat2, lon2 = (F.radians(as_column(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.sqrt(a), F.lit(1.0))) * (2 * 6371.0088)
