"""Joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.functions.dates import epoch_micros
from lagline.operators.joins import (
    add_group_stats,
    asof_join,
    asof_join_both_ends,
    attach_group_averages,
    attach_lookup,
    duplicate_keys,
    join_predictions,
    missing_from_lookup,
    nearest_neighbor,
    next_day_join,
    used_only,
)
from lagline.operators.groups import distinct_rows
from lagline.operators.ranks import exact_quantiles
from lagline.operators.stats import apply_utc_offsets, utc_offsets
from lagline.operators.nearest import nearest_station
from lagline.plans.common import load, query, scores

# Every event stands for a flight and for a weather observation; five stations.
_SIDES_SQL = """
WITH fl AS (SELECT event_id, epoch_us(ts) AS t, user_id % 5 AS o, (user_id // 5) % 5 AS d FROM events),
wx AS (SELECT event_id AS obs_id, epoch_us(ts) AS u, user_id % 5 AS station, value FROM events)
"""
_HOUR = 3_600_000_000


def _sides(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    user = F.col("user_id")
    fl = events.select(
        "event_id", "ts", (user % 5).alias("o"), (F.floor(user / 5) % 5).alias("d")
    )
    wx = events.select(
        F.col("event_id").alias("obs_id"), F.col("ts").alias("obs_ts"), (user % 5).alias("station"), "value"
    )
    return fl, wx


def _latest_sql(key: str, prefix: str) -> str:
    return f"""(SELECT event_id, obs_id AS {prefix}obs_id, value AS {prefix}value, u AS {prefix}u FROM (
  SELECT fl.event_id, wx.obs_id, wx.value, wx.u, row_number() OVER (PARTITION BY fl.event_id ORDER BY wx.u DESC NULLS LAST, wx.obs_id DESC) AS r
  FROM fl LEFT JOIN wx ON fl.{key} = wx.station AND wx.u >= fl.t - {4 * _HOUR} AND wx.u < fl.t - {3 * _HOUR}) WHERE r = 1)"""


@query("asof_join", _SIDES_SQL + f"SELECT event_id, CAST(obs_id AS DOUBLE) AS obs_id, value, CAST(u AS DOUBLE) AS obs_us FROM {_latest_sql('o', '')}")
def asof_join_query(spark, sf_dir):
    """Latest observation of the origin station, three to four hours before departure."""
    fl, wx = _sides(spark, sf_dir)
    joined = asof_join(fl, wx, "ts", "obs_ts", "o", "station", tie_break="obs_id")
    return joined.select("event_id", F.col("obs_id").cast("double").alias("obs_id"), "value", epoch_micros("obs_ts").cast("double").alias("obs_us"))


@query(
    "asof_join_both_ends",
    _SIDES_SQL
    + f"""SELECT fl.event_id, CAST(origin_obs_id AS DOUBLE) AS origin_obs_id, origin_value, CAST(dest_obs_id AS DOUBLE) AS dest_obs_id, dest_value
FROM fl JOIN {_latest_sql('o', 'origin_')} a USING (event_id) JOIN {_latest_sql('d', 'dest_')} b USING (event_id)""",
)
def asof_join_both_ends_query(spark, sf_dir):
    fl, wx = _sides(spark, sf_dir)
    joined = asof_join_both_ends(fl, wx, "ts", "obs_ts", {"origin_": "o", "dest_": "d"}, "station", "obs_id")
    ids = [F.col(c).cast("double").alias(c) for c in ("origin_obs_id", "dest_obs_id")]
    return joined.select("event_id", *ids, "origin_value", "dest_value")


@query(
    "next_day_join",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY ALL)
SELECT event_id, total AS daily_total, CAST(n AS DOUBLE) AS daily_n FROM events e LEFT JOIN d ON d.event_type = e.event_type AND d.day + 1 = CAST(e.ts AS DATE)""",
)
def next_day_join_query(spark, sf_dir):
    """Daily summary of yesterday for every row of today."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    daily = events.groupBy(F.col("event_type").alias("daily_key"), F.to_date("ts").alias("day")).agg(
        F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("daily_total"), F.count(F.lit(1)).cast("double").alias("daily_n")
    )
    joined = next_day_join(events, daily, "event_type", F.col("ts"), "daily_key", "day")
    return joined.select("event_id", "daily_total", "daily_n")


@query(
    "missing_from_lookup",
    """SELECT DISTINCT year(l_shipdate) AS yr, l_suppkey FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def missing_from_lookup_query(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("yr"), "l_suppkey")
    lookup = load(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 0)
    return missing_from_lookup(items, "l_suppkey", lookup, "s_suppkey", by=["yr"])


@query(
    "attach_group_averages",
    """SELECT c_nationkey, c_mktsegment, round(m, 6) AS mean_acctbal FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
JOIN (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) USING (c_nationkey)""",
)
def attach_group_averages_query(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    table = distinct_rows(customers, "c_nationkey", "c_mktsegment")
    result = attach_group_averages(table, customers, "c_nationkey", "c_acctbal", "mean_acctbal")
    return result.withColumn("mean_acctbal", F.round("mean_acctbal", 6))


@query(
    "add_group_stats",
    """SELECT event_id, n_flights, n_aircraft FROM events e JOIN (
  SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n_flights, count(DISTINCT user_id) AS n_aircraft FROM events GROUP BY 1, 2) g
ON g.event_type = e.event_type AND g.d = CAST(e.ts AS DATE)""",
)
def add_group_stats_query(spark, sf_dir):
    """Rows per carrier and day and distinct aircraft, attached to every row."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "user_id")
    result = add_group_stats(rows, ["event_type", "day"], n_flights=F.count(F.lit(1)), n_aircraft=F.countDistinct("user_id"))
    return result.select("event_id", "n_flights", "n_aircraft")


_ROUTES_SQL = """
WITH r AS (
  SELECT c.c_nationkey AS origin, s.s_nationkey AS dest, p.p_brand AS carrier
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey)
"""


def _routes(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("origin"))
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dest"))
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("carrier"))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "origin")
    return (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("origin", "dest", "carrier")
    )


@query("carriers_per_route", _ROUTES_SQL + "SELECT origin, dest, count(*) AS n_flights, count(DISTINCT carrier) AS n_carriers FROM r GROUP BY 1, 2")
def carriers_per_route(spark, sf_dir):
    """Flights and distinct carriers of every route."""
    return _routes(spark, sf_dir).groupBy("origin", "dest").agg(
        F.count(F.lit(1)).alias("n_flights"), F.countDistinct("carrier").alias("n_carriers")
    )


@query(
    "attach_lookup",
    """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def attach_lookup_query(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    named = attach_lookup(customers, "c_nationkey", load(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"])
    placed = attach_lookup(named, "n_regionkey", load(spark, sf_dir, "region"), "r_regionkey", ["r_name"])
    return placed.select("c_custkey", "n_name", "r_name")


@query(
    "daily_delay_with_weather",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY 1),
w AS (SELECT CAST(ts AS DATE) AS day, max(value) AS top FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(m, 6) AS mean_delay, top AS worst_weather FROM d JOIN w USING (day)""",
)
def daily_delay_with_weather(spark, sf_dir):
    """Daily mean delay next to the same day's weather."""
    fl = wx = load(spark, sf_dir, "events")
    delays = fl.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    weather = wx.groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("worst_weather"))
    joined = delays.join(weather, "day")
    return joined.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("m", 6).alias("mean_delay"), "worst_weather")


@query("used_stations", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def used_stations(spark, sf_dir):
    """Suppliers that occur among large line items."""
    users = load(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 50)
    return used_only(load(spark, sf_dir, "supplier"), "s_suppkey", users, "l_suppkey").select("s_suppkey", "s_name")


@query(
    "nearest_neighbor",
    """SELECT l_partkey, l_suppkey AS nearest, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_suppkey) AS r FROM lineitem) WHERE r = 1""",
)
def nearest_neighbor_query(spark, sf_dir):
    return nearest_neighbor(load(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query(
    "join_predictions",
    """SELECT a.event_id, p1, p2, p3 FROM
(SELECT event_id, ts, user_id, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p1 FROM events) a
JOIN (SELECT ts, user_id, ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS p2 FROM events WHERE value >= 5) b USING (ts, user_id)
JOIN (SELECT ts, user_id, ((event_id * 1299709) % 1000) / 1000.0::DOUBLE AS p3 FROM events WHERE value < 200) c USING (ts, user_id)""",
)
def join_predictions_query(spark, sf_dir):
    """Three models' predictions aligned on departure time and aircraft; a row missing in one model drops out."""
    rows = scores(spark, sf_dir)
    frames = [
        rows.select("ts", "user_id", "event_id", "p1"),
        rows.filter(F.col("value") >= 5).select("ts", "user_id", "p2"),
        rows.filter(F.col("value") < 200).select("ts", "user_id", "p3"),
    ]
    return join_predictions(frames, ["ts", "user_id"]).select("event_id", "p1", "p2", "p3")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys_query(spark, sf_dir):
    return duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# Stations are aircraft, states their carrier; every third station lacks local times.
_OFFSETS_SQL = """
WITH s AS (SELECT event_id, user_id AS station, user_id % 7 AS state, epoch_us(ts) AS utc,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE epoch_us(ts) - 3600000000 * (5 + user_id % 4) END AS loc FROM events),
own AS (SELECT station, state, max((loc - utc) // 1000000) AS o FROM s GROUP BY 1, 2),
st AS (SELECT state, max(o) AS so FROM own GROUP BY 1),
off AS (SELECT station, coalesce(o, so) AS offset_seconds FROM own LEFT JOIN st USING (state))
"""


@query(
    "utc_offsets",
    _OFFSETS_SQL + "SELECT event_id, offset_seconds, utc + offset_seconds * 1000000 - offset_seconds * 1000000 AS utc_us FROM s JOIN off USING (station)",
)
def utc_offsets_query(spark, sf_dir):
    """Offsets per station with the state's as a fallback, then local times moved to UTC."""
    user = F.col("user_id")
    events = load(spark, sf_dir, "events").select("event_id", user.alias("station"), (user % 7).alias("state"), "ts")
    shift = F.make_dt_interval(F.lit(0), (5 + user % 4).cast("int"))
    known = load(spark, sf_dir, "events").select(
        user.alias("station"), (user % 7).alias("state"), F.col("ts").alias("utc"),
        F.when(user % 3 != 0, F.col("ts") - shift).alias("local"),
    )
    offsets = utc_offsets(known, "station", "state", "local", "utc")
    dated = events.join(offsets.select(F.col("station").alias("s"), F.col("offset_seconds").alias("o")), F.col("station") == F.col("s"))
    local = dated.withColumn("local", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o").cast("decimal(18,6)")))
    moved = apply_utc_offsets(local, offsets, "station", "local", "utc_us")
    return moved.select("event_id", F.col("o").alias("offset_seconds"), "utc_us")


@query(
    "exact_quantiles",
    """SELECT l_returnflag, p AS probability, round(quantile_cont(l_extendedprice, 0.25), 6) AS quantile FROM lineitem, (VALUES (0.25::DOUBLE)) v(p) GROUP BY 1, 2
UNION ALL SELECT l_returnflag, 0.5::DOUBLE, round(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.9::DOUBLE, round(quantile_cont(l_extendedprice, 0.9), 6) FROM lineitem GROUP BY 1""",
)
def exact_quantiles_query(spark, sf_dir):
    result = exact_quantiles(load(spark, sf_dir, "lineitem"), "l_extendedprice", (0.25, 0.5, 0.9), ["l_returnflag"])
    return result.withColumn("quantile", F.round("quantile", 6))


# The tables have no coordinates: suppliers and customers are put on the globe by their keys, every fifth supplier near one town.
_PLACES_SQL = """
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 48 + (s_suppkey * 37 % 1000) / 50000.0::DOUBLE ELSE s_suppkey * 7919 % 18001 / 100.0::DOUBLE - 90 END AS la,
  CASE WHEN s_suppkey % 5 = 0 THEN 11 + (s_suppkey * 91 % 1000) / 50000.0::DOUBLE ELSE s_suppkey * 104729 % 36001 / 100.0::DOUBLE - 180 END AS lo FROM supplier),
c AS (SELECT c_custkey, c_custkey * 6007 % 18001 / 100.0::DOUBLE - 90 AS lat, c_custkey * 15013 % 36001 / 100.0::DOUBLE - 180 AS lon FROM customer)
"""


@query(
    "nearest_station",
    _PLACES_SQL + """, d AS (SELECT c_custkey, s_suppkey, round(asin(least(1.0, sqrt(pow(sin(radians(la - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2)))) * 2 * 6371.0088, 6) AS km FROM c CROSS JOIN s)
SELECT c_custkey, min(s_suppkey) AS nearest, round(min(km), 3) AS distance_km FROM d JOIN (SELECT c_custkey, min(km) AS best FROM d GROUP BY 1) USING (c_custkey)
WHERE km = best GROUP BY 1""",
)
def nearest_station_query(spark, sf_dir):
    """The supplier nearest to every customer, by coordinates."""
    key, crowded = F.col("s_suppkey"), F.col("s_suppkey") % 5 == 0
    near = lambda base, factor: base + (key * factor % 1000) / F.lit(50000.0)
    stations = load(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(crowded, near(48, 37)).otherwise(key * 7919 % 18001 / F.lit(100.0) - 90).alias("la"),
        F.when(crowded, near(11, 91)).otherwise(key * 104729 % 36001 / F.lit(100.0) - 180).alias("lo"))
    at = lambda factor, size: F.col("c_custkey") * factor % size / F.lit(100.0)
    points = load(spark, sf_dir, "customer").select("c_custkey", (at(6007, 18001) - 90).alias("lat"), (at(15013, 36001) - 180).alias("lon"))
    found = nearest_station(points, stations, "lat", "lon", "s_suppkey", "la", "lo")
    return found.select("c_custkey", "nearest", F.round("distance_km", 3).alias("distance_km"))
