"""The whole table build over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.operators.build import build_features, evaluate
from lagline.plans.common import FLIGHTS_SQL, REGISTRY, flights, load, query, rounded
from lagline.plans.evaluation import _at_recall_sql, _blocks_sql
from lagline.plans.joins import _SIDES_SQL, _latest_sql
from lagline.plans.windows import _MEAN

_STATIONS = {"origin_": "o", "dest_": "d"}

# Weather of both ends and the tail's features are those of their own queries; the origin is a station here, not the carrier.
_BUILT_SQL = f"""
SELECT b.event_id, b.fold, b.role, coalesce(x.origin_value, 0) AS origin_value, coalesce(x.dest_value, 0) AS dest_value,
       f.av_carrier_delay, f.prev_delay_tailnum, f.weekly_flights_tailnum, s.av_airport_delay, s.hourly_flights_origin
FROM ({_blocks_sql('events', 'event_id', 'ts', 5, 0.8)}) b
JOIN ({_SIDES_SQL} SELECT fl.event_id, origin_value, dest_value FROM fl
      JOIN {_latest_sql('o', 'origin_')} p USING (event_id) JOIN {_latest_sql('d', 'dest_')} q USING (event_id)) x USING (event_id)
JOIN ({REGISTRY['delay_features'].sql}) f USING (event_id)
JOIN ({FLIGHTS_SQL} SELECT event_id, coalesce({_MEAN.format(w='lag')}, 0) AS av_airport_delay, count(delay) OVER hour AS hourly_flights_origin
      FROM (SELECT *, tail % 5 AS o FROM f)
      WINDOW lag AS (PARTITION BY o ORDER BY t RANGE BETWEEN 21600000000 PRECEDING AND 7200000000 PRECEDING),
             hour AS (PARTITION BY o ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)) s USING (event_id)
"""


def _built(spark, sf_dir):
    tail = F.col("tail")
    rows = flights(spark, sf_dir).withColumns({"o": tail % 5, "d": F.floor(tail / 5) % 5})
    seen = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("obs_id"), F.col("ts").alias("obs_ts"), (F.col("user_id") % 5).alias("station"), "value", F.lit(None).cast("double").alias("ceiling"))
    return build_features(rows, seen, "ts", "obs_ts", _STATIONS, "station", "obs_id", "delay", "carrier", "tail", "event_id")


@query("built_table", _BUILT_SQL)
def built_table(spark, sf_dir):
    """Every event as a flight with the weather of both ends, features and blocks."""
    return _built(spark, sf_dir).select(
        "event_id", "fold", "role", "origin_value", "dest_value", "av_carrier_delay", "prev_delay_tailnum", "weekly_flights_tailnum",
        "av_airport_delay", "hourly_flights_origin")


_MINUTES = range(0, 200, 5)
_BASELINE_SQL = f"""
WITH p AS (SELECT role, av_carrier_delay AS s, CASE WHEN CAST(value AS DECIMAL(12,2)) >= 50 THEN 1 ELSE 0 END AS label FROM ({_BUILT_SQL}) b JOIN events USING (event_id)),
counted AS (SELECT role AS model, c, count(*) FILTER (s >= c AND label = 1) AS tp, count(*) FILTER (s >= c AND label = 0) AS fp, count(*) FILTER (label = 1) AS pos
  FROM p, (VALUES {", ".join(f"({c}.0::DOUBLE)" for c in _MINUTES)}) v(c) GROUP BY role, c),
swept AS (SELECT model, c AS "Cutoff", tp * 100.0::DOUBLE / nullif(tp + fp, 0) AS "Precision", tp * 100.0::DOUBLE / nullif(pos, 0) AS "Recall" FROM counted)
SELECT model AS role, "precision" FROM ({_at_recall_sql("""SELECT * FROM swept WHERE NOT coalesce("Precision" < 1 OR "Recall" < 1 OR "Precision" > 90, false)""")})
"""


@query("built_baseline", _BASELINE_SQL)
def built_baseline(spark, sf_dir):
    """The carrier's lagged mean delay as a score, rated per role of the built table."""
    rows = _built(spark, sf_dir).withColumn("label", (F.col("delay") >= 50).cast("int"))
    return rounded(evaluate(rows, "av_carrier_delay", "label", _MINUTES, 80.0, ["role"]), "precision")
