"""Range-frame features over time, such as "mean delay between 6 and 2 hours ago, per carrier".

A plain ``rangeBetween`` window puts all rows of a key into one task and folds every frame from
scratch, so its cost grows with key size times frame size. Here the unit of work is one key in one
time bin instead, whose width divides the frame's length. Per key, the frame ``[t + start, t + end]`` of a row
in bin ``p`` splits into

* whole bins strictly inside the frame: folded once per bin (pre-aggregated before the shuffle; counted from
  ``start``, so frames may begin and end anywhere),
* the rows of one bin at the right end: those with ``ts - end <= t``,
* the rows of one bin at the left end: those with ``ts - start >= t``.

Every row is sent, as a narrow copy, to the bins whose frames end or begin in its own bin. Both ends
are then running folds inside (key, bin): one shuffle per key column and bin width, no task larger than the
densest bin, and linear work. A hot key is spread over all its bins. Longer frames have wider bins, a thousand to
a frame at most. Columns travel as they are, so those nobody asks for are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.functions.dates import MICROS_PER_SECOND, epoch_micros

HOUR = 3600
DAY = 24 * HOUR

# Width of the bins of short frames, and about how many bins a long one has.
_DEFAULT_BIN = HOUR
_BINS_PER_FRAME = 1000
# Copies of rows that one task sorts, when cells are spread evenly.
_ROWS_PER_TASK = 400_000
_WHOLE_BINS = -(2**62)
_TIMELESS = -(2**61)

_PIECES = {"count": ("n",), "sum": ("s",), "avg": ("s", "n"), "min": ("lo",), "max": ("hi",), "last": ("last",)}


@dataclass(frozen=True)
class RangeAgg:
    """``func`` of ``value`` over the rows of the same key with time in ``[t + start, t + end]``.

    ``start`` and ``end`` are seconds, both ends belong to the frame. ``count`` counts non-null
    values; ``last`` keeps nulls, as the latest row may have no value.
    """

    name: str
    func: str
    value: str
    start: int
    end: int

    def __post_init__(self) -> None:
        if self.func not in _PIECES:
            raise ValueError(f"unknown function {self.func!r}; use one of {sorted(_PIECES)}")
        if self.end <= self.start:
            raise ValueError("a frame must end after it starts")


def bin_start(micros: Column, width: int) -> Column:
    """Start of the bin of ``width`` microseconds that holds ``micros``."""
    return micros - F.pmod(micros, F.lit(width))


def null_time_bin() -> Column:
    """Bins for rows without a time: spread by row, as they have no neighbours to meet."""
    return F.lit(_TIMELESS) - F.pmod(F.monotonically_increasing_id(), F.lit(4096))


def choose_bin(agg: RangeAgg, bin_seconds: int | None = None) -> int:
    """Bin width in microseconds: a divisor of the frame's length, by default about an hour or a thousandth of a long frame."""
    length = (agg.end - agg.start) * MICROS_PER_SECOND
    if bin_seconds is not None:
        if length % (bin_seconds * MICROS_PER_SECOND):
            raise ValueError(f"bin of {bin_seconds}s must divide the frame's length ({agg.end - agg.start}s)")
        return bin_seconds * MICROS_PER_SECOND
    parts = min(-(-length // (_DEFAULT_BIN * MICROS_PER_SECOND)), _BINS_PER_FRAME)
    while length % parts:
        parts += 1
    return length // parts


def range_features(
    df: DataFrame,
    time: str,
    features: Mapping[str | tuple[str, ...], Sequence[RangeAgg]] | Sequence[tuple],
    bin_seconds: int | None = None,
    tie_break: str | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Add every aggregate of ``features`` (key column or columns -> aggregates, or such pairs) to ``df``.

    All aggregates of one key and bin width share one shuffle. Rows without a time have empty frames. ``tie_break``
    decides which of several rows at the latest time ``last`` returns (its greatest value). With ``row_id``, a unique
    column without nulls, several keys work on narrow rows of their own, and whole rows are shuffled once, to take in the features.
    """
    groups: dict[tuple[tuple[str, ...], int], list[RangeAgg]] = {}
    for key, aggs in features.items() if isinstance(features, Mapping) else features:
        for agg in aggs:
            groups.setdefault(((key,) if isinstance(key, str) else tuple(key), choose_bin(agg, bin_seconds)), []).append(agg)
    if row_id is None or len(groups) == 1:
        result = df
        for (keys, width), aggs in groups.items():
            result = _add_for_key(result, df, time, keys, aggs, width, tie_break)
        return result
    result = df
    for (keys, width), aggs in groups.items():
        wanted = dict.fromkeys([row_id, time, *keys, *(agg.value for agg in aggs), *([tie_break] if tie_break else [])])
        narrow = df.select(*wanted)
        part = _add_for_key(narrow, df, time, keys, aggs, width, tie_break).select(F.col(row_id).alias("__id"), *(agg.name for agg in aggs))
        result = result.join(part, F.col(row_id) == F.col("__id"), "left").drop("__id")
    return result


def _unit(piece: str, value: Column, at: Column, tie: Column) -> Column:
    """What one row contributes to a piece."""
    if piece == "n":
        return value.isNotNull().cast("long")
    if piece == "last":
        return F.struct(at.alias("at"), tie.alias("tie"), value.alias("value"))
    return value


def _fold(piece: str, col: Column) -> Column:
    return {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max, "last": F.max}[piece](col)


def _merge(piece: str, left: Column, right: Column) -> Column:
    if piece == "n":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    if piece == "s":
        return F.coalesce(left + right, left, right)
    return F.least(left, right) if piece == "lo" else F.greatest(left, right)


def _finish(agg: RangeAgg, pieces: Mapping[str, Column]) -> Column:
    if agg.func == "avg":
        return (pieces["s"].cast("double") / F.nullif(pieces["n"], F.lit(0))).alias(agg.name)
    if agg.func == "last":
        return pieces["last"]["value"].alias(agg.name)
    return pieces[_PIECES[agg.func][0]].alias(agg.name)


def _add_for_key(
    rows: DataFrame, base: DataFrame, time: str, keys: tuple[str, ...], aggs: list[RangeAgg], width: int, tie_break: str | None
) -> DataFrame:
    values = sorted({agg.value for agg in aggs})
    value_of = {name: f"__v{i}" for i, name in enumerate(values)}
    key_cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    key_names = [f"__k{i}" for i in range(len(keys))]
    tie = F.col(tie_break) if tie_break else F.lit(0)
    narrow = [*key_cols, *(F.col(n).alias(value_of[n]) for n in values), tie.alias("__tie"), epoch_micros(time).alias("__t")]

    # One copy per distinct frame bound, plus the row itself at bound 0, the only one with the row's own columns.
    bounds = sorted({0} | {b * MICROS_PER_SECOND for agg in aggs for b in (agg.start, agg.end)})
    copies = F.explode(F.array(*(F.lit(b).cast("long") for b in bounds))).alias("__bound")
    own = {c: f"__r_{i}" for i, c in enumerate(rows.columns)}
    sent = rows.select(*narrow, *(F.col(f"`{c}`").alias(n) for c, n in own.items()), null_time_bin().alias("__none"), copies)
    is_row = F.col("__bound") == 0
    sent = (
        sent.filter(is_row | F.col("__t").isNotNull())
        .withColumn("__s", F.col("__t") - F.col("__bound"))
        .select(
            *key_names, *value_of.values(), "__tie", "__bound", "__s",
            F.coalesce(bin_start(F.col("__s"), width), F.col("__none")).alias("__p"),
            *(F.when(is_row, F.col(n)).alias(n) for n in own.values()),
        )
    )

    # Pieces needed per frame, and the folds of the whole bins inside it. Bins of a frame are counted from its start, so there
    # is one grid per remainder of a start; grid 0 also holds the bins that ask.
    needed = sorted({(p, agg.value, agg.start, agg.end) for agg in aggs for p in _PIECES[agg.func]})
    inner_of = {}
    inner_cols = []
    partials = {}
    for i, (piece, value, start, end) in enumerate(needed):
        grid = start * MICROS_PER_SECOND % width
        first, last = start * MICROS_PER_SECOND - grid + width, end * MICROS_PER_SECOND - grid - width
        if first > last:
            continue
        name = partials.setdefault((piece, value, grid), f"__b{len(partials)}")
        span = W.partitionBy(*key_names).orderBy("__p").rangeBetween(first, last)
        inner_of[i] = f"__m{i}"
        inner_cols.append(_fold(piece, F.col(name)).over(span).alias(inner_of[i]))
    if inner_cols:
        # Bounded: one row per key, grid and bin, however many data rows there are.
        grids = sorted({0} | {grid for _, _, grid in partials})
        gridded = base.select(*narrow).filter(F.col("__t").isNotNull()).withColumn(
            "__grid", F.explode(F.array(*(F.lit(g).cast("long") for g in grids))) if len(grids) > 1 else F.lit(0).cast("long"))
        units = [
            _fold(p, F.when(F.col("__grid") == grid, _unit(p, F.col(value_of[v]), F.col("__t"), F.col("__tie")))).alias(n)
            for (p, v, grid), n in partials.items()
        ]
        bins = gridded.groupBy(*key_names, "__grid", bin_start(F.col("__t") - F.col("__grid"), width).alias("__p")).agg(*units)
        inner = bins.select(*key_names, "__grid", "__p", F.col("__p").alias("__s"), F.lit(_WHOLE_BINS).alias("__bound"), *inner_cols)
        sent = sent.unionByName(inner.filter(F.col("__grid") == 0).drop("__grid"), allowMissingColumns=True)

    # Tasks grow in number with the rows and not in size: Spark would join shuffled parts by their compressed bytes, far below what sorts hold.
    # Fewer rows than one task takes are left to it.
    parts = base.count() * len(bounds) // _ROWS_PER_TASK + 1
    if parts > 1:
        sent = sent.repartition(parts, "__p", *key_names)

    # The bin leads: it tells cells apart faster than the key, of which many rows may share one.
    cell = W.partitionBy("__p", *key_names)
    upward, downward = cell.orderBy(F.col("__s").asc()), cell.orderBy(F.col("__s").desc())
    timed = F.col("__s").isNotNull()
    right, left = [], []
    for i, (piece, value, start, end) in enumerate(needed):
        ends, starts = end * MICROS_PER_SECOND, start * MICROS_PER_SECOND
        col = F.col(value_of[value])
        at_right = F.when((F.col("__bound") == ends) & timed, _unit(piece, col, F.col("__s") + ends, F.col("__tie")))
        at_left = F.when((F.col("__bound") == starts) & timed, _unit(piece, col, F.col("__s") + starts, F.col("__tie")))
        if i in inner_of:
            at_right = at_right.when(F.col("__bound") == _WHOLE_BINS, F.col(inner_of[i]))
        right.append(_fold(piece, at_right).over(upward).alias(f"__r{i}"))
        left.append(_fold(piece, at_left).over(downward).alias(f"__l{i}"))
    folded = sent.select("__bound", *own.values(), *right, *left).filter(F.col("__bound") == 0)

    merged = {key: _merge(key[0], F.col(f"__r{i}"), F.col(f"__l{i}")) for i, key in enumerate(needed)}
    finished = [
        _finish(agg, {p: merged[(p, agg.value, agg.start, agg.end)] for p in _PIECES[agg.func]}) for agg in aggs
    ]
    return folded.select(*(F.col(n).alias(c) for c, n in own.items()), *finished)


def lagged_mean(df: DataFrame, key: str, time: str, value: str, start: int, end: int, name: str, **options) -> DataFrame:
    """Mean of ``value`` in the key's frame ``[t + start, t + end]``."""
    return range_features(df, time, {key: [RangeAgg(name, "avg", value, start, end)]}, **options)


def lagged_last(df: DataFrame, key: str, time: str, value: str, start: int, end: int, name: str, **options) -> DataFrame:
    """Latest value in the frame; null when the latest row has none."""
    return range_features(df, time, {key: [RangeAgg(name, "last", value, start, end)]}, **options)


def lagged_count(df: DataFrame, key: str, time: str, value: str, start: int, end: int, name: str, **options) -> DataFrame:
    """Number of non-null values in the frame."""
    return range_features(df, time, {key: [RangeAgg(name, "count", value, start, end)]}, **options)


def trailing_count(df: DataFrame, key: str, time: str, value: str, seconds: int, name: str, **options) -> DataFrame:
    """Number of non-null values from ``seconds`` ago up to now, the row itself and its ties included."""
    return lagged_count(df, key, time, value, -seconds, 0, name, **options)


def trailing_rate(
    df: DataFrame, key: str, time: str, value: str, seconds: int, per: float, name: str, **options
) -> DataFrame:
    """``trailing_count`` divided by ``per`` active hours."""
    counted = trailing_count(df, key, time, value, seconds, name, **options)
    return counted.withColumn(name, F.col(name) / F.lit(per))


def rolling_stats(
    df: DataFrame, key: str, time: str, values: Sequence[str], hours: Sequence[int], funcs: Sequence[str] = ("avg",), **options
) -> DataFrame:
    """Rolling statistics per metric and window length, named ``<hours>h_<func>_<value>``."""
    aggs = [RangeAgg(f"{h}h_{f}_{v}", f, v, -h * HOUR, 0) for h in hours for f in funcs for v in values]
    return range_features(df, time, {key: aggs}, **options)


def target_encoding(df: DataFrame, key: str, time: str, label: str, name: str, start: int = -26 * HOUR, end: int = -2 * HOUR, **options) -> DataFrame:
    """Mean of the label per category, from rows old enough to be known."""
    return lagged_mean(df, key, time, label, start, end, name, **options)


def delay_features(df: DataFrame, time: str, delay: str, origin: str, carrier: str, tail: str, row_id: str | None = None) -> DataFrame:
    """The lagged and schedule features of the delay model: narrow shuffles per key, one of whole rows if ``row_id`` is given.

    Delay values come from rows at least two hours old; the two schedule counts may see the current
    time, as the schedule is known in advance. Missing values become 0.
    """
    with_windows = range_features(
        df,
        time,
        [
            (origin, [
                RangeAgg("av_airport_delay", "avg", delay, -6 * HOUR, -2 * HOUR),
                RangeAgg("hourly_flights_origin", "count", delay, -1 * HOUR, 0),
                RangeAgg("weekly_flights_origin", "count", delay, -168 * HOUR, 0),
            ]),
            (carrier, [
                RangeAgg("av_carrier_delay", "avg", delay, -6 * HOUR, -2 * HOUR),
                RangeAgg("num_flights_carrier", "count", delay, -6 * HOUR, -2 * HOUR),
            ]),
            (tail, [
                RangeAgg("prev_delay_tailnum", "last", delay, -26 * HOUR, -2 * HOUR),
                RangeAgg("weekly_flights_tailnum", "count", delay, -170 * HOUR, -2 * HOUR),
            ]),
        ],
        tie_break=row_id,
        row_id=row_id,
    )
    rated = with_windows.withColumn("airport_average_hourly", F.col("weekly_flights_origin") / F.lit(100.0)).drop("weekly_flights_origin")
    busy = (F.col("hourly_flights_origin") >= 2) & (F.col("airport_average_hourly") >= 2)
    return rated.withColumns(
        {
            "av_airport_delay": F.coalesce("av_airport_delay", F.lit(0.0)),
            "av_carrier_delay": F.coalesce("av_carrier_delay", F.lit(0.0)),
            "prev_delay_tailnum": F.coalesce(F.col("prev_delay_tailnum").cast("double"), F.lit(0.0)),
            "airport_congestion": F.when(busy, F.col("hourly_flights_origin") / F.col("airport_average_hourly")).otherwise(0.0),
        }
    )
