"""Projection, filters, scalar functions and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.functions.dates import (
    calendar_date,
    calendar_text,
    day_of_year,
    epoch_micros,
    epoch_seconds,
    hhmm_minutes_diff,
    holiday_window,
    parse_date,
    parse_number,
)
from lagline.functions.scalars import (
    binary_label,
    bucket_text,
    composite_label,
    contains_flag,
    cutoff_label,
    guarded_ratio,
    keep_levels,
    squared,
    text_label,
    threshold_zero,
    weighted_score,
)
from lagline.operators.fills import fill_first, fill_zero, fill_zero_if_sparse, forward_fill
from lagline.operators.filters import (
    drop_null_rows,
    drop_values,
    drop_where,
    filter_min_max,
    keep_containing,
    keep_different,
    keep_values,
    keep_where,
    split_by_report_type,
    where_nulls,
)
from lagline.operators.groups import frequency
from lagline.operators.schema import (
    add_prefix,
    cast_schema,
    columns_like,
    drop_columns,
    drop_existing,
    infer_types,
    numeric_columns,
    rename_columns,
    reorder_first,
    select_columns,
    track_dimensions,
    with_columns,
)
from lagline.plans.common import GAPS_SQL, gaps, hhmm, load, query, scores

# Projection and schema.


@query("select_columns", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def select_columns_query(spark, sf_dir):
    return select_columns(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_tax"])


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_columns_query(spark, sf_dir):
    return drop_columns(load(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query("drop_existing", "SELECT s_suppkey, s_acctbal FROM supplier")
def drop_existing_query(spark, sf_dir):
    return drop_existing(load(spark, sf_dir, "supplier"), ["s_name", "s_nationkey", "not_there"])


@query(
    "cast_schema",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(NULL AS DOUBLE) AS o_orderpriority,
strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders""",
)
def cast_schema_query(spark, sf_dir):
    """Cast and prune to a mapping; text that is no number becomes null."""
    mapping = {"o_orderkey": "string", "o_custkey": "int", "o_orderpriority": "double", "o_orderdate": "date", "o_totalprice": "double"}
    return cast_schema(load(spark, sf_dir, "orders"), mapping).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("add_prefix", "SELECT n_nationkey AS origin_n_nationkey, n_name AS origin_n_name, n_regionkey AS origin_n_regionkey FROM nation")
def add_prefix_query(spark, sf_dir):
    return add_prefix(load(spark, sf_dir, "nation"), "origin_")


@query("rename_columns", "SELECT r_regionkey AS region_id, r_name AS region FROM region")
def rename_columns_query(spark, sf_dir):
    return rename_columns(load(spark, sf_dir, "region"), {"r_regionkey": "region_id", "r_name": "region"})


@query("reorder_first", "SELECT p_brand, p_size, p_partkey, p_name, p_type, p_retailprice FROM part")
def reorder_first_query(spark, sf_dir):
    return reorder_first(load(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("numeric_family", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_family(spark, sf_dir):
    """Numeric columns whose name is not a key or line number."""
    items = load(spark, sf_dir, "lineitem")
    chosen = [c for c in numeric_columns(items) if c in columns_like(items, prefix="l_") and c not in columns_like(items, pattern="key|number")]
    return items.select(*chosen)


@query("with_columns", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def with_columns_query(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return with_columns(load(spark, sf_dir, "lineitem"), {"net": net, "gross": net * (1 + F.col("l_tax"))}).select("l_orderkey", "net", "gross")


_TEXTS_SQL = """
WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS a, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS b, o_orderpriority AS c,
  CASE WHEN o_orderkey % 7 = 0 THEN '0.02s' ELSE CAST(o_custkey AS VARCHAR) END AS d FROM orders)
"""
_INFER = """SELECT '{c}' AS "column", count({c}) AS non_null, count(*) FILTER (regexp_matches(trim({c}), '^[+-]?[0-9]+$')) AS as_long,
count(*) FILTER (regexp_matches(trim({c}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) AS as_double, '{t}' AS inferred FROM x"""


@query("infer_types", _TEXTS_SQL + " UNION ALL ".join(_INFER.format(c=c, t=t) for c, t in (("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string"))))
def infer_types_query(spark, sf_dir):
    """Narrowest type that fits all values of each text column."""
    key = F.col("o_custkey").cast("string")
    texts = load(spark, sf_dir, "orders").select(
        key.alias("a"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("b"), F.col("o_orderpriority").alias("c"),
        F.when(F.col("o_orderkey") % 7 == 0, "0.02s").otherwise(key).alias("d"),
    )
    return infer_types(texts)


@query(
    "track_dimensions",
    """SELECT 0 AS position, 'raw' AS step, 6 AS n_columns, count(*) AS n_rows FROM orders UNION ALL
SELECT 1, 'finished only', 6, count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'pruned', 2, count(*) FROM orders WHERE o_orderstatus = 'F'""",
)
def track_dimensions_query(spark, sf_dir):
    raw = load(spark, sf_dir, "orders")
    finished = raw.filter(F.col("o_orderstatus") == "F")
    return track_dimensions([("raw", raw), ("finished only", finished), ("pruned", finished.select("o_orderkey", "o_totalprice"))])


# Filters.


@query("keep_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND NOT o_orderstatus = 'P'")
def keep_where_query(spark, sf_dir):
    finished = drop_where(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P")
    return keep_where(finished, F.col("o_totalprice") > 250000).select("o_orderkey")


@query("where_nulls", GAPS_SQL + "SELECT event_id FROM g WHERE a IS NULL AND c IS NULL AND b IS NOT NULL")
def where_nulls_query(spark, sf_dir):
    return where_nulls(gaps(spark, sf_dir), null=["a", "c"], not_null=["b"]).select("event_id")


@query("drop_null_rows", GAPS_SQL + "SELECT event_id, a, b FROM g WHERE a IS NOT NULL AND b IS NOT NULL")
def drop_null_rows_query(spark, sf_dir):
    return drop_null_rows(gaps(spark, sf_dir), ["a", "b"]).select("event_id", "a", "b")


@query("keep_values", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def keep_values_query(spark, sf_dir):
    urgent = keep_values(load(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return drop_values(urgent, "o_orderstatus", ["F"]).select("o_orderkey", "o_orderpriority")


@query("keep_containing", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def keep_containing_query(spark, sf_dir):
    return keep_containing(load(spark, sf_dir, "part"), "p_name", "ring").select("p_partkey", "p_name")


@query("keep_different", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey")
def keep_different_query(spark, sf_dir):
    both = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return keep_different(both, "c_nationkey", "s_nationkey").select("c_custkey", "s_suppkey")


@query("keep_different_null_safe", GAPS_SQL + "SELECT event_id FROM g WHERE a IS DISTINCT FROM c")
def keep_different_null_safe(spark, sf_dir):
    return keep_different(gaps(spark, sf_dir), "a", "c", null_safe=True).select("event_id")


@query("filter_min_max", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) BETWEEN 12 AND 15")
def filter_min_max_query(spark, sf_dir):
    return filter_min_max(frequency(load(spark, sf_dir, "events"), "event_type", "user_id"), "n", 12, 15)


@query(
    "split_by_report_type",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'daily' WHEN 'O' THEN 'monthly' ELSE 'other' END AS part, o_orderkey FROM orders""",
)
def split_by_report_type_query(spark, sf_dir):
    """Three-way split by a padded type column."""
    padded = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderstatus", F.lit("  ")).alias("kind"))
    parts = zip(("daily", "monthly", "other"), split_by_report_type(padded, "kind", daily="F", monthly="O"))
    daily, monthly, other = (df.select(F.lit(name).alias("part"), "o_orderkey") for name, df in parts)
    return daily.unionByName(monthly).unionByName(other)


# Dates and times.


@query(
    "calendar_columns",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS calendar_date, strftime(o_orderdate, '%Y-%m-%d') AS calendar_text,
dayofyear(o_orderdate) AS day_of_year, year(o_orderdate) AS yr, epoch(o_orderdate)::BIGINT AS time_long FROM orders""",
)
def calendar_columns(spark, sf_dir):
    """Dates put together from year, month and day numbers, and what is derived from them."""
    parts = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")
    )
    date = calendar_date("y", "m", "d")
    return parts.select(
        "o_orderkey", F.date_format(date, "yyyy-MM-dd").alias("calendar_date"), calendar_text("y", "m", "d").alias("calendar_text"),
        day_of_year(date).cast("bigint").alias("day_of_year"), F.year(date).cast("bigint").alias("yr"), epoch_seconds("o_orderdate").alias("time_long"),
    )


@query("time_buckets", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS us FROM events")
def time_buckets(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return events.select("event_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"), epoch_micros("ts").alias("us"))


# Fixed-date holidays of the years the orders span, as the published list starts in 2015.
_HOLIDAYS = tuple(f"{year}-{day}" for year in range(1995, 2002) for day in ("01-01", "07-04", "11-11", "12-25"))


@query(
    "holiday_window",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE WHEN least(abs(d - make_date(y, 1, 1)), abs(d - make_date(y + 1, 1, 1)), abs(d - make_date(y, 7, 4)),
  abs(d - make_date(y, 11, 11)), abs(d - make_date(y, 12, 25)), abs(d - make_date(y - 1, 12, 25))) <= 2 THEN 1 ELSE 0 END AS is_holiday_window FROM o""",
)
def holiday_window_query(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", holiday_window("o_orderdate", _HOLIDAYS).alias("is_holiday_window"))


@query(
    "federal_holiday_window",
    """WITH e AS (SELECT event_id, CAST(ts AS DATE) - CAST(event_id % 9 AS INTEGER) * 365 AS d FROM events)
SELECT event_id, CASE WHEN d < DATE '2016-01-01' THEN NULL WHEN EXISTS (
  SELECT 1 FROM (VALUES (DATE '2016-01-01'), (DATE '2016-01-18'), (DATE '2016-02-15'), (DATE '2017-01-01'), (DATE '2017-01-02'), (DATE '2017-01-16'),
    (DATE '2018-01-01'), (DATE '2018-01-15'), (DATE '2018-12-25'), (DATE '2019-01-01'), (DATE '2019-01-21'), (DATE '2019-12-25'), (DATE '2020-01-01'), (DATE '2020-01-20'),
    (DATE '2021-01-01'), (DATE '2021-01-18'), (DATE '2021-12-31'), (DATE '2022-01-01'), (DATE '2022-01-17'), (DATE '2022-12-26'), (DATE '2023-01-01'),
    (DATE '2023-01-02'), (DATE '2023-01-16'), (DATE '2023-12-25'), (DATE '2024-01-01'), (DATE '2024-01-15')) AS h(day) WHERE abs(d - day) <= 2)
THEN 1 ELSE 0 END AS is_holiday_window FROM e""",
)
def federal_holiday_window(spark, sf_dir):
    """Federal holidays of listed and of later years; event dates are spread over nine years, of which the first is not covered."""
    events = load(spark, sf_dir, "events")
    day = F.date_sub(F.to_date("ts"), F.col("event_id").cast("int") % 9 * 365)
    return events.select("event_id", holiday_window(day, years=range(2016, 2025)).alias("is_holiday_window"))


_CLOCK_SQL = """
WITH c AS (SELECT event_id, hour(ts) * 100 + minute(ts) AS s, hour(ts2) * 100 + minute(ts2) AS e, gap FROM (
  SELECT event_id, ts, ts + to_minutes(CAST(event_id % 400 AS INTEGER)) AS ts2, event_id % 400 AS gap FROM events)),
m AS (SELECT *, (e // 100 * 60 + e % 100) - (s // 100 * 60 + s % 100) AS plain FROM c)
"""


def _clock(spark, sf_dir):
    gap = F.col("event_id") % 400
    later = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), gap.cast("int"))
    return load(spark, sf_dir, "events").select("event_id", hhmm(F.col("ts")).alias("s"), hhmm(later).alias("e"), gap.alias("gap"))


@query("hhmm_minutes", _CLOCK_SQL + "SELECT event_id, CASE WHEN e // 100 < 3 AND s // 100 > 20 THEN plain + 1440 ELSE plain END AS minutes FROM m")
def hhmm_minutes(spark, sf_dir):
    """Minutes between clock numbers; only late starts with early ends cross midnight."""
    return _clock(spark, sf_dir).select("event_id", hhmm_minutes_diff("e", "s").alias("minutes"))


@query("hhmm_minutes_early", _CLOCK_SQL + "SELECT event_id, CASE WHEN e // 100 < 3 AND s // 100 > 18 THEN plain + 1440 ELSE plain END AS minutes FROM m")
def hhmm_minutes_early(spark, sf_dir):
    return _clock(spark, sf_dir).select("event_id", hhmm_minutes_diff("e", "s", late_start_hour=18).alias("minutes"))


@query(
    "hhmm_mismatches",
    _CLOCK_SQL + "SELECT event_id, minutes, gap FROM (SELECT *, CASE WHEN e // 100 < 3 AND s // 100 > 20 THEN plain + 1440 ELSE plain END AS minutes FROM m) WHERE minutes <> gap",
)
def hhmm_mismatches(spark, sf_dir):
    """Rows whose computed minutes do not equal the recorded ones."""
    checked = _clock(spark, sf_dir).withColumn("minutes", hhmm_minutes_diff("e", "s")).withColumn("equal", F.col("minutes") == F.col("gap"))
    return checked.filter(~F.col("equal")).select("event_id", "minutes", "gap")


# Labels and scalar features.


@query(
    "labels",
    """SELECT event_id, CASE WHEN value >= 15 THEN 1 ELSE 0 END AS label, CASE WHEN value >= 15 THEN 'Delayed' ELSE 'On time' END AS label_text,
CASE WHEN (value >= 15 OR event_id % 2 = 1) AND event_id % 400 - 100 BETWEEN 0 AND 120 THEN 1 ELSE 0 END AS composite,
CAST(CAST(floor(value / 15) AS BIGINT) * 15 AS VARCHAR) || ' min' AS bucket FROM events""",
)
def labels_query(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumns({"flag": F.col("event_id") % 2, "gap": F.col("event_id") % 400 - 100})
    return events.select(
        "event_id", binary_label("value").alias("label"), text_label("value").alias("label_text"),
        composite_label("value", "flag", "gap").alias("composite"), bucket_text(F.floor(F.col("value") / 15)).alias("bucket"),
    )


@query(
    "scalar_features",
    """SELECT event_id, CASE WHEN value >= 30 THEN value ELSE 0 END AS severity, value * value AS value_squared,
CASE WHEN value >= 2 AND event_id % 10 >= 2 THEN value / (event_id % 10) ELSE 0 END AS congestion,
CASE WHEN contains(event_type, 'ck') THEN 1 ELSE 0 END AS is_click,
CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'good_type' END AS kept_type FROM events""",
)
def scalar_features(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("base", F.col("event_id") % 10)
    return events.select(
        "event_id", threshold_zero("value", 30).alias("severity"), squared("value").alias("value_squared"),
        guarded_ratio("value", "base").alias("congestion"), contains_flag("event_type", "ck").alias("is_click"),
        keep_levels("event_type", ["error", "view"], "good_type").alias("kept_type"),
    )


@query(
    "score_columns",
    """SELECT event_id, CASE WHEN p1 >= 0.45 THEN 1 ELSE 0 END AS reached, CASE WHEN p1 > 0.45 THEN 1 ELSE 0 END AS exceeded, p1 * 0.5::DOUBLE + p2 * 0.5::DOUBLE AS score
FROM (SELECT event_id, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p1, ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS p2 FROM events)""",
)
def score_columns(spark, sf_dir):
    return scores(spark, sf_dir).select(
        "event_id", cutoff_label("p1", 0.45).alias("reached"), cutoff_label("p1", 0.45, strict=True).alias("exceeded"),
        weighted_score({"p1": 0.5, "p2": 0.5}).alias("score"),
    )


@query(
    "text_cleanup",
    """SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS padded, trim('  ' || o_orderstatus || ' ') AS status, o_orderstatus || '/' || o_orderpriority AS joined FROM orders""",
)
def text_cleanup(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("padded"),
        F.trim(F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).alias("status"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("joined"),
    )


@query(
    "dirty_parse",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'T' WHEN o_orderkey % 5 = 1 THEN '0.02s' ELSE ' ' || CAST(o_custkey AS VARCHAR) || ' ' END AS n,
  CASE WHEN o_orderkey % 4 = 0 THEN '2015-31-04' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT o_orderkey, CAST(trim(n) AS DOUBLE) AS number, d AS day FROM x WHERE o_orderkey % 5 > 1 AND o_orderkey % 4 <> 0""",
)
def dirty_parse(spark, sf_dir):
    """Text parsed where possible; rows with an unreadable number or date are dropped."""
    key = F.col("o_orderkey")
    dirty = load(spark, sf_dir, "orders").select(
        key,
        F.when(key % 5 == 0, "T").when(key % 5 == 1, "0.02s").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).alias("n"),
        F.when(key % 4 == 0, "2015-31-04").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
    )
    parsed = dirty.select("o_orderkey", parse_number("n").alias("number"), F.date_format(parse_date("d"), "yyyy-MM-dd").alias("day"))
    return drop_null_rows(parsed)


# Imputation.


@query("fill_zero", GAPS_SQL + "SELECT event_id, coalesce(a, 0) AS a, b, coalesce(c, 0) AS c FROM g")
def fill_zero_query(spark, sf_dir):
    return fill_zero(gaps(spark, sf_dir), ["a", "c"]).select("event_id", "a", "b", "c")


@query("coalesce_columns", GAPS_SQL + "SELECT event_id, coalesce(a, c, -1) AS filled FROM g")
def coalesce_columns(spark, sf_dir):
    return gaps(spark, sf_dir).select("event_id", F.coalesce("a", "c", F.lit(-1.0)).alias("filled"))


@query("fill_zero_if_sparse", GAPS_SQL + "SELECT event_id, a, coalesce(b, 0) AS b, c FROM g")
def fill_zero_if_sparse_query(spark, sf_dir):
    """Only the column with under one percent of nulls is filled."""
    return fill_zero_if_sparse(gaps(spark, sf_dir), ["a", "b", "c"]).select("event_id", "a", "b", "c")


@query("fill_first", GAPS_SQL + "SELECT event_id, coalesce(a, first(a IGNORE NULLS) OVER w) AS a, coalesce(c, first(c IGNORE NULLS) OVER w) AS c FROM g WINDOW w AS (ORDER BY t)".replace("first(", "first_value("))
def fill_first_query(spark, sf_dir):
    """Nulls take the earliest value of the whole table, from its time on."""
    return fill_first(gaps(spark, sf_dir), ["a", "c"], "ts", "event_id").select("event_id", "a", "c")


@query(
    "forward_fill",
    GAPS_SQL + """SELECT event_id, coalesce(a, last_value(a IGNORE NULLS) OVER w) AS a, coalesce(c, last_value(c IGNORE NULLS) OVER w) AS c
FROM g WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill_query(spark, sf_dir):
    """Nulls take the nearest earlier value of their station."""
    return forward_fill(gaps(spark, sf_dir), ["event_type"], "ts", ["a", "c"], "event_id").select("event_id", "a", "c")


@query(
    "forward_fill_wide",
    GAPS_SQL + """SELECT event_id, coalesce(c, last_value(c IGNORE NULLS) OVER w) AS c
FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill_wide(spark, sf_dir):
    """The same for many stations with few readings each."""
    return forward_fill(gaps(spark, sf_dir), ["user_id"], "ts", ["c"], "event_id").select("event_id", "c")
