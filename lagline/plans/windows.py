"""Range windows over flight times, and the mean-delay baseline built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.functions.scalars import binary_label
from lagline.models.evaluate import cutoff_sweep, error_stats, one_tailed_z, precision_at_recall, sparse_fallback_mean
from lagline.operators import groups
from lagline.operators.range_windows import (
    HOUR,
    RangeAgg,
    delay_features,
    lagged_count,
    lagged_last,
    lagged_mean,
    range_features,
    rolling_stats,
    target_encoding,
    trailing_count,
    trailing_rate,
)
from lagline.operators.stats import with_previous
from lagline.plans.common import FLIGHTS_SQL, GAPS_SQL, flights, gaps, query

H = HOUR * 1_000_000
_CARRIER_LAG = f"PARTITION BY carrier ORDER BY t RANGE BETWEEN {6 * H} PRECEDING AND {2 * H} PRECEDING"
_TAIL_DAY = f"PARTITION BY tail ORDER BY t RANGE BETWEEN {26 * H} PRECEDING AND {2 * H} PRECEDING"
_TAIL_WEEK = f"PARTITION BY tail ORDER BY t RANGE BETWEEN {170 * H} PRECEDING AND {2 * H} PRECEDING"
_ORIGIN_HOUR = f"PARTITION BY carrier ORDER BY t RANGE BETWEEN {1 * H} PRECEDING AND CURRENT ROW"
_ORIGIN_WEEK = f"PARTITION BY carrier ORDER BY t RANGE BETWEEN {168 * H} PRECEDING AND CURRENT ROW"
_MEAN = "CAST(sum(delay) OVER {w} AS DOUBLE) / nullif(count(delay) OVER {w}, 0)"

MINUTES = (0.0, 20.0, 30.0, 40.0, 45.0, 50.0, 60.0, 80.0)
_CUTOFF_ROWS = ", ".join(f"({c}::DOUBLE)" for c in MINUTES)

_BASELINE_SQL = f"""{FLIGHTS_SQL}, scored AS (
  SELECT {_MEAN.format(w="w")} AS score, CASE WHEN delay >= 50 THEN 1 ELSE 0 END AS label
  FROM f WINDOW w AS ({_CARRIER_LAG})),
known AS (SELECT * FROM scored WHERE score IS NOT NULL),
sweep AS (
  SELECT c AS "Cutoff", count(*) FILTER (score >= c AND label = 1) AS "TP",
         count(*) FILTER (score >= c AND label = 0) AS "FP", count(*) FILTER (label = 1) AS pos
  FROM known, (VALUES {_CUTOFF_ROWS}) v(c) GROUP BY c),
rated AS (
  SELECT "Cutoff", "TP", "FP", "TP" * 100.0::DOUBLE / nullif("TP" + "FP", 0) AS "Precision",
         "TP" * 100.0::DOUBLE / nullif(pos, 0) AS "Recall" FROM sweep)
"""


def _baseline_scores(spark, sf_dir):
    scored = lagged_mean(flights(spark, sf_dir), "carrier", "ts", "delay", -6 * HOUR, -2 * HOUR, "score")
    return scored.filter(F.col("score").isNotNull()).withColumn("label", binary_label("delay", 50))


@query(
    "baseline_precision",
    _BASELINE_SQL
    + """, pairs AS (
  SELECT *, lead("Precision") OVER (ORDER BY "Cutoff") AS p2, lead("Recall") OVER (ORDER BY "Cutoff") AS r2,
         row_number() OVER (ORDER BY "Cutoff") AS i FROM rated),
chosen AS (
  SELECT *, CASE WHEN "Recall" > 80 AND r2 < 80 THEN i ELSE 0 END AS k FROM pairs
  WHERE ("Recall" > 80 AND r2 < 80) OR i = 1)
SELECT round(p2 - (p2 - "Precision") * ((r2 - 80) / nullif(r2 - "Recall", 0)), 6) AS "precision"
FROM chosen ORDER BY k DESC LIMIT 1""",
)
def baseline_precision(spark, sf_dir):
    """Mean carrier delay 6 to 2 hours ago as the score, rated by precision at 80 % recall."""
    sweep = cutoff_sweep(_baseline_scores(spark, sf_dir), "score", "label", MINUTES)
    return precision_at_recall(sweep).select(F.round("precision", 6).alias("precision"))


@query("baseline_sweep", _BASELINE_SQL + 'SELECT "Cutoff", "TP", "FP", round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall" FROM rated')
def baseline_sweep(spark, sf_dir):
    sweep = cutoff_sweep(_baseline_scores(spark, sf_dir), "score", "label", MINUTES)
    return sweep.withColumns({c: F.round(c, 6) for c in ("Precision", "Recall")})


@query(
    "baseline_error",
    FLIGHTS_SQL
    + f""", scored AS (SELECT {_MEAN.format(w="w")} AS score, CAST(delay AS DOUBLE) AS delay FROM f WINDOW w AS ({_CARRIER_LAG}))
SELECT round(avg(score - delay), 6) AS mean_error, round(stddev_samp(score - delay), 6) AS std_error FROM scored""",
)
def baseline_error(spark, sf_dir):
    scored = _baseline_scores(spark, sf_dir).withColumn("delay", F.col("delay").cast("double"))
    return error_stats(scored, "score", "delay").select(*(F.round(c, 6).alias(c) for c in ("mean_error", "std_error")))


@query("lagged_mean", FLIGHTS_SQL + f"SELECT event_id, {_MEAN.format(w='w')} AS av_delay FROM f WINDOW w AS ({_CARRIER_LAG})")
def lagged_mean_query(spark, sf_dir):
    result = lagged_mean(flights(spark, sf_dir), "carrier", "ts", "delay", -6 * HOUR, -2 * HOUR, "av_delay")
    return result.select("event_id", "av_delay")


@query("lagged_last", FLIGHTS_SQL + f"SELECT event_id, CAST(last(delay) OVER ({_TAIL_DAY}) AS DOUBLE) AS prev_delay FROM f")
def lagged_last_query(spark, sf_dir):
    result = lagged_last(flights(spark, sf_dir), "tail", "ts", "delay", -26 * HOUR, -2 * HOUR, "prev_delay", tie_break="event_id")
    return result.select("event_id", F.col("prev_delay").cast("double").alias("prev_delay"))


@query("lagged_count", FLIGHTS_SQL + f"SELECT event_id, count(delay) OVER ({_TAIL_WEEK}) AS weekly_flights FROM f")
def lagged_count_query(spark, sf_dir):
    result = lagged_count(flights(spark, sf_dir), "tail", "ts", "delay", -170 * HOUR, -2 * HOUR, "weekly_flights")
    return result.select("event_id", "weekly_flights")


@query("trailing_count", FLIGHTS_SQL + f"SELECT event_id, count(delay) OVER ({_ORIGIN_HOUR}) AS hourly_flights FROM f")
def trailing_count_query(spark, sf_dir):
    result = trailing_count(flights(spark, sf_dir), "carrier", "ts", "delay", HOUR, "hourly_flights")
    return result.select("event_id", "hourly_flights")


@query("trailing_rate", FLIGHTS_SQL + f"SELECT event_id, count(delay) OVER ({_ORIGIN_WEEK}) / 100.0::DOUBLE AS hourly_rate FROM f")
def trailing_rate_query(spark, sf_dir):
    result = trailing_rate(flights(spark, sf_dir), "carrier", "ts", "delay", 168 * HOUR, 100.0, "hourly_rate")
    return result.select("event_id", "hourly_rate")


@query(
    "lagged_gaps_filled",
    GAPS_SQL
    + f""", w AS (SELECT event_id, CAST(sum(CAST(a AS DECIMAL(12,2))) OVER r AS DOUBLE) / nullif(count(a) OVER r, 0) AS av,
  count(a) OVER r AS n, CAST(last(CAST(a AS DECIMAL(12,2))) OVER r AS DOUBLE) AS prev
  FROM g WINDOW r AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {26 * H} PRECEDING AND {2 * H} PRECEDING))
SELECT event_id, coalesce(av, 0) AS av, n, coalesce(prev, 0) AS prev FROM w""",
)
def lagged_gaps_filled(spark, sf_dir):
    """Frames over values with gaps: means skip nulls, the latest value does not; then nulls become 0."""
    rows = gaps(spark, sf_dir).select("event_id", "ts", "user_id", F.col("a").cast("decimal(12,2)").alias("a"))
    frame = dict(value="a", start=-26 * HOUR, end=-2 * HOUR)
    aggs = [RangeAgg("av", "avg", **frame), RangeAgg("n", "count", **frame), RangeAgg("prev", "last", **frame)]
    result = range_features(rows, "ts", {"user_id": aggs}, tie_break="event_id")
    return result.select("event_id", "av", "n", F.col("prev").cast("double").alias("prev")).fillna(0)


@query(
    "delay_features",
    FLIGHTS_SQL
    + f""", w AS (
  SELECT event_id, {_MEAN.format(w="c4")} AS av_airport_delay, {_MEAN.format(w="c4")} AS av_carrier_delay,
         count(delay) OVER c4 AS num_flights_carrier, CAST(last(delay) OVER td AS DOUBLE) AS prev_delay_tailnum,
         count(delay) OVER tw AS weekly_flights_tailnum, count(delay) OVER o1 AS hourly_flights_origin,
         count(delay) OVER ow / 100.0::DOUBLE AS airport_average_hourly
  FROM f WINDOW c4 AS ({_CARRIER_LAG}), td AS ({_TAIL_DAY}), tw AS ({_TAIL_WEEK}), o1 AS ({_ORIGIN_HOUR}), ow AS ({_ORIGIN_WEEK}))
SELECT event_id, coalesce(av_airport_delay, 0) AS av_airport_delay, coalesce(av_carrier_delay, 0) AS av_carrier_delay,
       num_flights_carrier, coalesce(prev_delay_tailnum, 0) AS prev_delay_tailnum, weekly_flights_tailnum,
       hourly_flights_origin, airport_average_hourly,
       CASE WHEN hourly_flights_origin >= 2 AND airport_average_hourly >= 2
            THEN hourly_flights_origin / airport_average_hourly ELSE 0.0::DOUBLE END AS airport_congestion
FROM w""",
)
def delay_features_query(spark, sf_dir):
    """All engineered window features in one go, three keys."""
    built = delay_features(flights(spark, sf_dir), "ts", "delay", "carrier", "carrier", "tail", "event_id")
    return built.select(
        "event_id", "av_airport_delay", "av_carrier_delay", "num_flights_carrier", "prev_delay_tailnum",
        "weekly_flights_tailnum", "hourly_flights_origin", "airport_average_hourly", "airport_congestion",
    )


def _rolling_sql(func: str, expr: str) -> str:
    cols = ", ".join(expr.format(w=f"w{h}") + f' AS "{h}h_{func}_delay"' for h in (3, 6, 12))
    frames = ", ".join(f"w{h} AS (PARTITION BY carrier ORDER BY t RANGE BETWEEN {h * H} PRECEDING AND CURRENT ROW)" for h in (3, 6, 12))
    return FLIGHTS_SQL + f"SELECT event_id, {cols} FROM f WINDOW {frames}"


@query("rolling_means", _rolling_sql("avg", _MEAN))
def rolling_means(spark, sf_dir):
    result = rolling_stats(flights(spark, sf_dir), "carrier", "ts", ["delay"], (3, 6, 12))
    return result.select("event_id", *(f"{h}h_avg_delay" for h in (3, 6, 12)))


@query("rolling_minima", _rolling_sql("min", "CAST(min(delay) OVER {w} AS DOUBLE)"))
def rolling_minima(spark, sf_dir):
    result = rolling_stats(flights(spark, sf_dir), "carrier", "ts", ["delay"], (3, 6, 12), ["min"])
    return result.select("event_id", *(F.col(f"{h}h_min_delay").cast("double").alias(f"{h}h_min_delay") for h in (3, 6, 12)))


@query("rolling_maxima", _rolling_sql("max", "CAST(max(delay) OVER {w} AS DOUBLE)"))
def rolling_maxima(spark, sf_dir):
    result = rolling_stats(flights(spark, sf_dir), "carrier", "ts", ["delay"], (3, 6, 12), ["max"])
    return result.select("event_id", *(F.col(f"{h}h_max_delay").cast("double").alias(f"{h}h_max_delay") for h in (3, 6, 12)))


@query(
    "target_encoding",
    FLIGHTS_SQL
    + f"""SELECT event_id, CAST(sum(CASE WHEN delay >= 50 THEN 1 ELSE 0 END) OVER w AS DOUBLE) / nullif(count(*) OVER w, 0) AS encoded
FROM f WINDOW w AS (PARTITION BY carrier ORDER BY t RANGE BETWEEN {26 * H} PRECEDING AND {2 * H} PRECEDING)""",
)
def target_encoding_query(spark, sf_dir):
    labelled = flights(spark, sf_dir).withColumn("label", binary_label("delay", 50))
    return target_encoding(labelled, "carrier", "ts", "label", "encoded").select("event_id", "encoded")


@query("carrier_sample_size", FLIGHTS_SQL + f"SELECT event_id, count(delay) OVER ({_CARRIER_LAG}) AS num_flights FROM f")
def carrier_sample_size(spark, sf_dir):
    result = lagged_count(flights(spark, sf_dir), "carrier", "ts", "delay", -6 * HOUR, -2 * HOUR, "num_flights")
    return result.select("event_id", "num_flights")


@query(
    "latest_per_group",
    """SELECT event_id, event_type, strftime(d, '%Y-%m-%d') AS d FROM (
  SELECT event_id, event_type, CAST(ts AS DATE) AS d, rank() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY date_trunc('hour', ts) DESC) AS r
  FROM events) WHERE r = 1""",
)
def latest_per_group(spark, sf_dir):
    """Rows of the latest hour per carrier and day, ties kept."""
    rows = flights(spark, sf_dir).select("event_id", F.col("carrier").alias("event_type"), F.to_date("ts").alias("d"), F.date_trunc("hour", "ts").alias("h"))
    latest = groups.latest_per_group(rows, ["event_type", "d"], "h")
    return latest.select("event_id", "event_type", F.date_format("d", "yyyy-MM-dd").alias("d"))


@query(
    "previous_value",
    FLIGHTS_SQL + "SELECT event_id, CAST(lag(delay) OVER (PARTITION BY carrier ORDER BY t, event_id) AS DOUBLE) AS previous FROM f",
)
def previous_value(spark, sf_dir):
    result = with_previous(flights(spark, sf_dir), ["carrier"], "ts", "delay", "previous", "event_id")
    return result.select("event_id", F.col("previous").cast("double").alias("previous"))


_FALLBACK_FRAME = f"ORDER BY t RANGE BETWEEN {6 * H} PRECEDING AND {2 * H} PRECEDING"


@query(
    "sparse_fallback_baseline",
    FLIGHTS_SQL
    + f""", w AS (
  SELECT event_id, count(delay) OVER own AS n_own, {_MEAN.format(w="own")} AS m_own, count(delay) OVER grp AS n_grp, {_MEAN.format(w="grp")} AS m_grp,
         CAST(sum(delay) OVER grp AS DOUBLE) AS s, CAST(sum(delay * delay) OVER grp AS DOUBLE) AS q
  FROM f WINDOW own AS (PARTITION BY tail {_FALLBACK_FRAME}), grp AS (PARTITION BY carrier {_FALLBACK_FRAME}))
SELECT event_id, CASE WHEN n_own >= 3 THEN m_own ELSE m_grp END AS score,
       CASE WHEN n_grp > 1 THEN round((m_grp - 15) / nullif(sqrt((q - s * s / n_grp) / (n_grp - 1)) / sqrt(n_grp), 0), 6) END AS z
FROM w""",
)
def sparse_fallback_baseline(spark, sf_dir):
    """Mean of the aircraft where at least three flights are behind it, else of the carrier; z against 15."""
    rows = flights(spark, sf_dir).withColumn("delay_squared", F.col("delay") * F.col("delay"))
    frame = dict(start=-6 * HOUR, end=-2 * HOUR)
    built = range_features(
        rows, "ts",
        {
            "tail": [RangeAgg("m_own", "avg", "delay", **frame), RangeAgg("n_own", "count", "delay", **frame)],
            "carrier": [
                RangeAgg("m_grp", "avg", "delay", **frame), RangeAgg("n_grp", "count", "delay", **frame),
                RangeAgg("s", "sum", "delay", **frame), RangeAgg("q", "sum", "delay_squared", **frame),
            ],
        },
    )
    n, s, q = F.col("n_grp"), F.col("s").cast("double"), F.col("q").cast("double")
    spread = F.sqrt((q - s * s / n) / (n - 1))
    z = F.when(n > 1, F.round(one_tailed_z(F.col("m_grp"), spread, n, 15.0), 6))
    return built.select("event_id", sparse_fallback_mean(built, "m_own", "n_own", "m_grp").alias("score"), z.alias("z"))
