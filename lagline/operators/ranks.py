"""Exact global ranks, row-number folds and quantiles without a single-task window.

Single positions: approximate quantiles only choose cut points that divide the values into buckets of
similar size; counts per bucket are exact whatever the cuts, and a wanted position is looked up in the
one bucket that holds it. Full rankings are sample sorts over as many ranges as the rows need, and each
range starts at the total of all earlier ones. Only totals pass through one window. Rows of equal value
are counted into one before they are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.session import materialize

_BUCKETS = 256
# Distinct values a range of a full ranking aims at; beyond the largest number of ranges they grow instead, and their sorts may spill.
_RANGE_ROWS = 500_000
_MOST_RANGES = 100_000


def _with_buckets(df: DataFrame, col: str, keys: list[str], buckets: int) -> DataFrame:
    """``df`` with ``__bucket``: the number of cut points below the value, 0 for nulls."""
    value = F.col(col)
    if isinstance(df.schema[col].dataType, T.DecimalType):
        value = value.cast("double")  # keeps the order, which is all that buckets need
    # A rough sketch is enough: cut points decide the balance of the buckets, never a result.
    cuts = F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(4 * buckets))
    if keys:
        # One row of cut points per key; keys with only nulls have none.
        splits = df.groupBy(*keys).agg(cuts.alias("__cuts"))
        marked = _attach(df, splits, keys, "left")
    else:
        marked = df.select("*", df.agg(cuts.alias("__cuts")).scalar().alias("__cuts"))
    return marked.select(*df.columns, _smaller_cuts(F.col("__cuts"), value, buckets).alias("__bucket"))


def _smaller_cuts(cuts: Column, value: Column, buckets: int) -> Column:
    """How many of the sorted cut points are smaller than the value, by halving; 0 for a null value."""
    steps, step = [], 1
    while step < buckets:
        steps.insert(0, step)
        step *= 2
    halve = lambda found, step: found + F.when(F.get(cuts, found + step - 1) < value, step).otherwise(0)
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), halve)


def _attach(df: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` with nulls equal, keeping the columns of both sides once."""
    renamed = small.select(*(F.col(k).alias(f"__j_{k}") if k in keys else F.col(k) for k in small.columns))
    return df.join(renamed, [df[k].eqNullSafe(renamed[f"__j_{k}"]) for k in keys], how).drop(*(f"__j_{k}" for k in keys))


def running_sums(counts: DataFrame, col: str, names: Sequence[str], keys: Sequence[str] = (), buckets: int = 1, suffix: str = "_before") -> DataFrame:
    """``counts`` (one row per key and value of ``col``) with the sum of each of ``names`` over the smaller values of the key; nulls are smallest.

    A sample sort: Spark samples splitters for as many ranges as the rows need (``buckets`` at least) and deals the rows by them; a key with
    many values is cut into several ranges, small keys share one. The dealt rows are stored with their range, since a range sampled anew after
    a lost executor could differ. Totals per key and range, one row for half a million, give each range its start; inside it the sums are local.
    """
    keys, names = list(keys), list(names)
    order = [F.col(c).asc_nulls_first() for c in [*keys, col]]
    ranged = materialize(counts.select(*keys, col, *names), "counts")
    ranges = max(buckets, min(_MOST_RANGES, -(-ranged.count() // _RANGE_ROWS)))
    if ranges > 1:
        ranged = materialize(ranged.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    else:
        ranged = ranged.withColumn("__range", F.lit(0))
    totals = ranged.groupBy(*keys, "__range").agg(*(F.sum(n).alias(f"__t_{n}") for n in names))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    # The first range starts at nothing, and without others no totals need be added up.
    start = lambda n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) if ranges > 1 else F.lit(0).cast(totals.schema[n].dataType)
    offsets = totals.select(*keys, "__range", *(start(f"__t_{n}").alias(n) for n in names), F.lit(0).alias("__order"))
    stacked = ranged.withColumn("__order", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    running = W.partitionBy(*keys, "__range").orderBy("__order", F.col(col).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ranked = stacked.withColumns({n + suffix: F.sum(n).over(running) for n in names})
    return ranked.filter(F.col("__order") == 1).select(*keys, col, *names, *(n + suffix for n in names))


def value_ranks(df: DataFrame, col: str, keys: Sequence[str] = (), buckets: int = 1) -> DataFrame:
    """(keys, ``col``, n, n_before): rows per distinct value and rows with a smaller value.

    Nulls sort first, as in Spark's default ordering.
    """
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, col, ["n"], keys, buckets)


def values_at(
    df: DataFrame, col: str, positions: Mapping[str, Callable[[Column], Column]], keys: Sequence[str] = (), buckets: int = _BUCKETS
) -> DataFrame:
    """(keys, id, position, size, value): the values at wanted places of the sorted column.

    ``positions`` maps an id to a function of the group's row count that gives a position from 0;
    positions outside the group have no row. Nulls come first. For few groups, however large: the
    whole column is only counted per bucket, and just the buckets that hold a position are ordered.
    """
    if isinstance(df.schema[col].dataType, T.DecimalType):
        raise ValueError("cast decimals to double first")
    keys = list(keys)
    marked = _with_buckets(df.select(*keys, F.col(col).alias("__value")), "__value", keys, buckets).withColumnRenamed("__bucket", "__coarse")
    totals = marked.groupBy(*keys, "__coarse").agg(F.count(F.lit(1)).alias("__n"))
    ordered = W.partitionBy(*keys).orderBy("__coarse")
    earlier, every = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sized = totals.select(
        *keys, "__coarse", "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("size")
    )
    wanted = F.array(*(F.struct(F.lit(i).alias("id"), place(F.col("size")).cast("long").alias("position")) for i, place in positions.items()))
    hits = sized.select(*keys, "__coarse", "__n", "__before", "size", F.inline(wanted)).select(
        *keys, "__coarse", "id", "position", "size", (F.col("position") - F.col("__before")).alias("__place"), "__n"
    )
    hits = hits.filter((F.col("__place") >= 0) & (F.col("__place") < F.col("__n"))).drop("__n")
    if keys:
        inside = _attach(marked, hits.select(*keys, "__coarse").distinct(), [*keys, "__coarse"], "left_semi")
    else:
        chosen = hits.agg(F.collect_set("__coarse").alias("chosen")).scalar()
        inside = marked.filter(F.array_contains(chosen, F.col("__coarse")))
    ranks = value_ranks(inside, "__value", [*keys, "__coarse"])
    found = _attach(ranks, hits, [*keys, "__coarse"], "inner")
    holds = (F.col("n_before") <= F.col("__place")) & (F.col("__place") < F.col("n_before") + F.col("n"))
    return found.filter(holds).select(*keys, "id", "position", "size", F.col("__value").alias("value"))


def percent_ranks(df: DataFrame, col: str, buckets: int = 1) -> DataFrame:
    """(``col``, n, percent_rank) per distinct value, equal to ``percent_rank`` over the whole table."""
    ranks = value_ranks(df, col, buckets=buckets)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    share = F.when(total > 1, F.col("n_before") / (total - 1)).otherwise(0.0)
    return ranks.select(col, "n", share.alias("percent_rank"))


def with_percent_rank(df: DataFrame, col: str, name: str = "percent_rank", buckets: int = 1) -> DataFrame:
    """``df`` with each row's chronological percentile.

    Joins the per-value ranks back; a value shared by very many rows is one row on the rank side,
    so adaptive execution may split the data side of the join freely.
    """
    ranks = percent_ranks(df, col, buckets).select(F.col(col).alias("__value"), F.col("percent_rank").alias(name))
    return df.join(ranks, F.col(col).eqNullSafe(F.col("__value")), "left").drop("__value")


def row_number_folds(df: DataFrame, unique_col: str, folds: int, name: str = "fold", buckets: int = _BUCKETS) -> DataFrame:
    """Contiguous folds of equal size by the order of a unique column.

    A row's fold is the number of fold starts at or below its value; the rows are not shuffled.
    """
    starts = values_at(df, unique_col, {str(i): lambda size, i=i: F.ceil(size * i / folds) for i in range(1, folds)}, buckets=buckets)
    listed = starts.agg(F.collect_list("value").alias("starts")).scalar()
    marked = df.select("*", listed.alias("__starts"))
    fold = F.size(F.filter("__starts", lambda start: start <= F.col(unique_col)))
    return marked.withColumn(name, fold).drop("__starts")


def exact_quantiles(df: DataFrame, col: str, probabilities: Sequence[float], keys: Sequence[str] = (), buckets: int = _BUCKETS) -> DataFrame:
    """(keys, probability, quantile) with linear interpolation, nulls ignored.

    Looks up the two neighbouring order statistics instead of collecting all values of a group, as
    the exact ``percentile`` aggregate does.
    """
    keys = list(keys)
    present = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias(col))
    places = {}
    for p in map(float, probabilities):
        places[f"{p!r} low"] = lambda size, p=p: F.floor((size - 1) * p)
        places[f"{p!r} high"] = lambda size, p=p: F.ceil((size - 1) * p)
    found = values_at(present, col, places, keys, buckets)
    parts = F.split("id", " ")
    split = found.select(*keys, parts[0].cast("double").alias("probability"), (parts[1] == "low").alias("__low"), "position", "size", F.col("value").cast("double").alias("value"))
    pair = split.groupBy(*keys, "probability").agg(
        F.max(F.when(F.col("__low"), F.col("value"))).alias("__a"), F.max(F.when(~F.col("__low"), F.col("value"))).alias("__b"),
        F.max(F.when(F.col("__low"), (F.col("size") - 1) * F.col("probability") - F.col("position"))).alias("__part"),
    )
    return pair.select(*keys, "probability", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias("quantile"))


_GRID = 512
_ACCURACY = 10_000
# Values between the grid points around a position that one aggregate may gather.
_GATHERED = 50_000


def order_statistics(
    df: DataFrame, values: Mapping[str, Column], places: Mapping[str, Callable[[Column], Column]], nulls_first: bool = False
) -> list[tuple[str, str, int, int, float | None]]:
    """(name, id, position, size, value): exact values at places of the sorted columns, all columns in the same few scans.

    ``values`` are numeric expressions that doubles hold exactly; ``places`` as in ``values_at``. Nulls are ignored, or counted as the
    smallest with ``nulls_first``. The first scan sketches every column at ``_GRID`` points with a guaranteed rank error far below their
    distance, which brackets each place. The next scan counts exactly what lies below, on and between the ends of
    every bracket, and gathers the values between if they are few, else sketches them anew. So each scan leaves a hundredth of the rows between: two
    scans do for millions of rows, four for a million million, whatever the number of columns. Heavy values become ends of
    brackets, where only their count matters. One row of counts comes to the driver per scan.
    """
    names = list(values)
    narrow = df.select(*(values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)))
    grid = F.array(*(F.lit(i / _GRID) for i in range(_GRID + 1)))
    sketch = lambda column: F.percentile_approx(column, grid, F.lit(_ACCURACY))
    first = narrow.agg(F.count(F.lit(1)).alias("rows"), *(f(F.col(f"v{i}")).alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("g", sketch)))).first()
    sizes = [first["rows"] if nulls_first else first[f"n{i}"] for i in range(len(names))]
    asked = [[place(F.lit(size)).cast("long").alias(id_) for id_, place in places.items()] for size in sizes]
    wanted = df.sparkSession.range(1).select(*(F.struct(*columns).alias(f"c{i}") for i, columns in enumerate(asked))).first()

    found, open_ = [], []
    for i, name in enumerate(names):
        nulls = sizes[i] - first[f"n{i}"]
        for id_ in places:
            position = wanted[f"c{i}"][id_]
            if position is None or not 0 <= position < sizes[i]:
                continue
            if position < nulls:
                found.append((name, id_, position, sizes[i], None))
            else:
                open_.append([i, id_, position, position - nulls, first[f"g{i}"], first[f"n{i}"], 0])
    while open_:
        aggregates = []
        for k, bracket in enumerate(open_):
            i, _, _, rank, points, n, before = bracket
            at = (rank - before + 0.5) / n * _GRID
            low, high = points[max(0, int(at) - 1)], points[min(_GRID, int(at) + 2)]
            v = F.col(f"v{i}")
            inside = F.when((v > low) & (v < high), v)
            few = n * 4 // _GRID <= _GATHERED
            bracket += [low, high, few]
            aggregates += [
                F.count(F.when(v < low, 1)).alias(f"below{k}"), F.count(F.when(v == low, 1)).alias(f"low{k}"), F.count(inside).alias(f"inside{k}"),
                (F.sort_array(F.collect_list(inside)) if few else sketch(inside)).alias(f"points{k}")]
        counted = narrow.agg(*aggregates)
        # Of gathered values only the wanted one comes to the driver.
        row = counted.select(*(
            c for k, (_, _, _, rank, *_, few) in enumerate(open_) for c in (
                f"below{k}", f"low{k}", f"inside{k}",
                F.get(f"points{k}", (F.lit(rank) - F.col(f"below{k}") - F.col(f"low{k}")).cast("int")).alias(f"value{k}") if few else F.col(f"points{k}")))).first()
        still = []
        for k, (i, id_, position, rank, _, _, _, low, high, few) in enumerate(open_):
            below, on_low, inside = (row[f"{c}{k}"] for c in ("below", "low", "inside"))
            if rank < below:
                raise ArithmeticError("order_statistics: a sketch was less exact than it claims")
            if rank < below + on_low:
                value = low
            elif rank >= below + on_low + inside:
                value = high
            elif few:
                value = row[f"value{k}"]
            else:
                still.append([i, id_, position, rank, row[f"points{k}"], inside, below + on_low])
                continue
            found.append((names[i], id_, position, sizes[i], value))
        open_ = still
    return found


def boxplot_stats(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier counts, one row per column, over all rows.

    The quartiles of all columns come from ``order_statistics``; one more scan gives the rest.
    """
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    places = {f"{n} {end}": (lambda size, p=p, f=f: f((size - 1) * p)) for n, p in quarters.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    at = {(c, id_): (position, size, value) for c, id_, position, size, value in order_statistics(df, {c: F.col(c) for c in cols}, places)}
    rows, packed = [], []
    for i, c in enumerate(cols):
        box = dict.fromkeys([*quarters, "low_fence", "high_fence"])
        if (c, "q1 low") in at:
            for n, p in quarters.items():
                position, size, low = at[c, f"{n} low"]
                box[n] = low + (at[c, f"{n} high"][2] - low) * ((size - 1) * p - position)
            reach = (box["q3"] - box["q1"]) * whisker
            box |= {"low_fence": box["q1"] - reach, "high_fence": box["q3"] + reach}
        value, edge = F.col(c).cast("double"), lambda n: F.lit(box[n]).cast("double")
        inside = value.between(edge("low_fence"), edge("high_fence"))
        packed.append(F.struct(
            F.lit(c).alias("column"), *(edge(n).alias(n) for n in box), F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers")).alias(f"c{i}"))
    return df.agg(*packed).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(cols))))))
