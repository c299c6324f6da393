"""Correlations of wide tables: all pairs of columns in one scan.

A batch of rows is a matrix X with nulls set to 0 and a mask M of known values. The products M'M, X'M, (X*X)'M and X'X hold, for every pair of
columns, the count, sums, squares and products over the rows that know both, so pairwise nulls cost nothing extra. A task adds up its batches and
gives one row per pair at its end; these are summed by pair. The plan has one aggregate of a few columns, however many pairs there are, and a
task's memory depends on the number of columns only.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

# Below this share of the mean square, what is left of a variance is rounding: the column is constant there.
_ROUNDING = 1e-13
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _pair_sums(width: int, centre: list[float]):
    def run(batches):
        one, other = np.tril_indices(width, -1)
        known, sums, squares, products = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            mask = np.column_stack([~np.asarray(c.is_null()) for c in batch.columns]).astype(np.float64)
            x = np.column_stack([c.fill_null(m).to_numpy() for c, m in zip(batch.columns, centre)]) - np.array(centre)
            known += mask.T @ mask
            sums += x.T @ mask
            squares += (x * x).T @ mask
            products += x.T @ x
        columns = [known[one, other], sums[one, other], sums[other, one], squares[one, other], squares[other, one], products[one, other]]
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(one))), *map(pa.array, columns)], names=["pair", *_SUMS])

    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, r): rows that know both columns, and their Pearson correlation, of every pair; null where a side is constant.

    Values are taken relative to one known value of each column, so large offsets do not cost digits. A NaN makes its pairs NaN.
    """
    cols = list(cols)
    values = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)))
    # Any value near the others will do; it changes only how much is rounded away.
    near = values.limit(1000).agg(*(F.first(c, ignorenulls=True).alias(c) for c in values.columns)).first()
    centre = [v if v is not None and np.isfinite(v) else 0.0 for v in near]
    pairs = [(cols[j], cols[i]) for i, j in zip(*np.tril_indices(len(cols), -1))]
    names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "p long, a string, b string")
    sums = values.mapInArrow(_pair_sums(len(cols), centre), "pair long, " + ", ".join(f"{s} double" for s in _SUMS))
    total = sums.groupBy("pair").agg(*(F.sum(s).alias(s) for s in _SUMS))
    mean = lambda s: F.col(s) / F.nullif(F.col("n"), F.lit(0.0))
    spread = lambda s, ss: mean(ss) - mean(s) * mean(s)
    varies = lambda s, ss: (spread(s, ss) > mean(ss) * _ROUNDING) | F.isnan(mean(ss))
    r = F.when(varies("x", "xx") & varies("y", "yy"), (mean("xy") - mean("x") * mean("y")) / F.sqrt(spread("x", "xx") * spread("y", "yy")))
    # The lower triangle names the later column first: x belongs to b.
    return names.join(total, F.col("p") == F.col("pair"), "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r.alias("r"))
