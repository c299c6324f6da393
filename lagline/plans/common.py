"""Query registry and the roles the given tables play.

``events`` stands for flights: ``ts`` is the scheduled departure, ``event_type`` the carrier or the
origin, ``user_id`` the aircraft and ``value`` the delay. ``orders`` has calendar dates and status
codes, ``lineitem`` numeric families, ``region``/``nation``/``customer``/``supplier`` a hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under ``name`` with its SQL equivalent, when SQL can express it."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Event times of the tables carry no zone; reading them as UTC matches the SQL side.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Delays as decimals: sums are exact, so results do not depend on the order of rows.
FLIGHTS_SQL = """
WITH f AS (
  SELECT event_id, ts, epoch_us(ts) AS t, user_id AS tail, event_type AS carrier,
         CAST(value AS DECIMAL(12,2)) AS delay
  FROM events)
"""


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("tail"), F.col("event_type").alias("carrier"),
        F.col("value").cast("decimal(12,2)").alias("delay"),
    )


# Scores of three models, made of the row id, and the label "delay of at least 50".
SCORES_SQL = """
WITH p AS (
  SELECT event_id, ts, user_id, event_type, value,
         ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p1,
         ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS p2,
         ((event_id * 1299709) % 1000) / 1000.0::DOUBLE AS p3,
         CASE WHEN value >= 50 THEN 1 ELSE 0 END AS label
  FROM events)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda factor: (F.col("event_id") * factor % 1000) / F.lit(1000.0)
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        part(7919).alias("p1"), part(104729).alias("p2"), part(1299709).alias("p3"),
        F.when(F.col("value") >= 50, 1).otherwise(0).alias("label"),
    )


# The tables have no nulls; every seventh value is treated as missing.
GAPS_SQL = """
WITH g AS (
  SELECT event_id, ts, epoch_us(ts) AS t, user_id, event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS a,
         CASE WHEN event_id % 250 = 0 THEN NULL ELSE value END AS b,
         CASE WHEN event_id % 20 = 0 THEN value END AS c,
         CAST(NULL AS DOUBLE) AS d
  FROM events)
"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = lambda n: F.when(F.col("event_id") % n == 0, F.lit(None)).otherwise(F.col("value"))
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        holes(7).alias("a"), holes(250).alias("b"),
        F.when(F.col("event_id") % 20 == 0, F.col("value")).alias("c"),
        F.lit(None).cast("double").alias("d"),
    )


def hhmm(ts: Column) -> Column:
    return F.hour(ts) * 100 + F.minute(ts)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
