"""Aggregates, profiles, relationships and statistics."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import functions as F

from lagline.models.features import index_stage, level_index, scale_by_deviation
from lagline.operators.fills import track_imputation, fill_zero
from lagline.operators.filters import first_rows, top_groups
from lagline.operators.gram import correlation_matrix
from lagline.operators.groups import (
    absence_runs,
    category_sets,
    delay_component_shares,
    distinct_counts,
    distinct_in_range,
    distinct_rows,
    distinct_sketches,
    frequency,
    group_means,
    inconsistent_columns,
    missing_categories,
    multiple_associations,
    null_accounting,
    percent_different,
)
from lagline.operators.profile import coverage_keep, describe_table, drop_by_null_percent, drop_empty_columns, null_counts, null_percent, null_profile
from lagline.operators.ranks import boxplot_stats
from lagline.operators.schema import dimensions, schema_diff
from lagline.operators.stats import (
    array_sums,
    autocorrelation_function,
    class_balance,
    day_autocorrelation,
    family_correlation,
    histogram,
    indicator_sums,
    mean_and_spread,
    pairwise_correlation,
    scalar_aggregates,
    z_scores,
)
from lagline.plans.common import GAPS_SQL, gaps, load, query, rounded, scores
from lagline.session import materialize
from lagline.sources.tables import rows_to_table

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("group_means", "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS mean_value, max(o_totalprice) AS highest FROM orders GROUP BY 1, 2")
def group_means_query(spark, sf_dir):
    result = group_means(load(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", maximum="highest")
    return rounded(result, "mean_value", digits=4)


@query(
    "delay_by_weekday",
    "SELECT CAST(dayofweek(ts) + 1 AS BIGINT) AS weekday, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
)
def delay_by_weekday(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.dayofweek("ts").cast("bigint").alias("weekday"), "value")
    return rounded(group_means(rows, ["weekday"], "value"), "mean_value")


@query("frequency", "SELECT event_type, CAST(floor(value / 15) AS BIGINT) AS delay_group, count(*) AS n FROM events GROUP BY 1, 2")
def frequency_query(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 15).alias("delay_group"))
    return frequency(rows, "event_type", "delay_group")


@query("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem GROUP BY 1")
def distinct_counts_query(spark, sf_dir):
    return distinct_counts(load(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_suppkey", "l_partkey"])


@query(
    "category_sets",
    "SELECT r_name, array_to_string(list_sort(list(DISTINCT n_name)), '|') AS members, CAST(count(DISTINCT n_name) AS INTEGER) AS n_members FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
)
def category_sets_query(spark, sf_dir):
    joined = load(spark, sf_dir, "region").join(load(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return category_sets(joined, ["r_name"], "n_name").withColumn("members", F.concat_ws("|", "members"))


@query(
    "year_inventory",
    """SELECT year(o_orderdate) AS yr, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS members, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n_members
FROM orders GROUP BY 1""",
)
def year_inventory(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("yr"), "o_orderpriority")
    return category_sets(rows, ["yr"], "o_orderpriority").withColumn("members", F.concat_ws("|", "members"))


@query(
    "missing_categories",
    """WITH p AS (SELECT DISTINCT year(l_shipdate) AS yr, l_partkey FROM lineitem)
SELECT yr, l_partkey AS absent FROM (SELECT DISTINCT yr FROM p) CROSS JOIN (SELECT DISTINCT l_partkey FROM p) ANTI JOIN p USING (yr, l_partkey)""",
)
def missing_categories_query(spark, sf_dir):
    """Parts that were shipped, but not in a year."""
    rows = load(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("yr"), "l_partkey")
    return missing_categories(rows, "yr", "l_partkey")


@query(
    "daily_absence_runs",
    """WITH p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, l_suppkey FROM lineitem),
n AS (SELECT d, row_number() OVER (ORDER BY d) AS no FROM (SELECT DISTINCT d FROM p)),
m AS (SELECT l_suppkey, d, no FROM (SELECT DISTINCT l_suppkey FROM p) CROSS JOIN n ANTI JOIN p USING (l_suppkey, d)),
g AS (SELECT *, no - row_number() OVER (PARTITION BY l_suppkey ORDER BY no) AS run FROM m)
SELECT l_suppkey AS absent, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last, count(*) AS periods FROM g GROUP BY l_suppkey, run""",
)
def daily_absence_runs_query(spark, sf_dir):
    """Runs of shipping days on which a supplier shipped nothing."""
    rows = load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_suppkey")
    return absence_runs(rows, "d", "l_suppkey").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("mean_and_spread", "SELECT round(avg(l_quantity), 6) AS mean_value, round(stddev_samp(l_quantity), 6) AS std_value FROM lineitem")
def mean_and_spread_query(spark, sf_dir):
    return rounded(mean_and_spread(load(spark, sf_dir, "lineitem"), "l_quantity"), "mean_value", "std_value")


@query(
    "indicator_sums",
    """SELECT CAST(sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
CAST(sum(label) AS BIGINT) AS label FROM (SELECT ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS label FROM events)""",
)
def indicator_sums_query(spark, sf_dir):
    hit = F.col("p1") >= 0.5
    rows = scores(spark, sf_dir).select(
        "label", F.when(hit & (F.col("label") == 1), 1).otherwise(0).alias("tp"), F.when(hit & (F.col("label") == 0), 1).otherwise(0).alias("fp")
    )
    return indicator_sums(rows, ["tp", "fp", "label"])


@query(
    "array_sums",
    """SELECT CAST(i AS INTEGER) AS position, CAST(sum(CASE WHEN p >= c AND value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS total
FROM (SELECT ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p, value FROM events), (VALUES (0, 0.0::DOUBLE), (1, 0.3::DOUBLE), (2, 0.6::DOUBLE)) v(i, c) GROUP BY 1""",
)
def array_sums_query(spark, sf_dir):
    """Per-cutoff hit flags built as an array, summed by position."""
    hits = F.transform(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.6)), lambda c: F.when((F.col("p1") >= c) & (F.col("label") == 1), 1).otherwise(0))
    return array_sums(scores(spark, sf_dir).select(hits.alias("hits")), "hits")


@query(
    "scalar_aggregates",
    "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS latest, round(avg(CASE WHEN o_totalprice < 100000 THEN o_totalprice END), 4) AS mean_small FROM orders",
)
def scalar_aggregates_query(spark, sf_dir):
    small = F.avg(F.when(F.col("o_totalprice") < 100000, F.col("o_totalprice")))
    return scalar_aggregates(load(spark, sf_dir, "orders"), latest=F.date_format(F.max("o_orderdate"), "yyyy-MM-dd"), mean_small=F.round(small, 4))


_NULLS = "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_percent FROM g"


@query("null_profile", GAPS_SQL + " UNION ALL ".join(_NULLS.format(c=c) for c in ("event_id", "user_id", "event_type", "a", "b", "c", "d")))
def null_profile_query(spark, sf_dir):
    return rounded(null_profile(gaps(spark, sf_dir)), "null_percent")


@query("null_percent", GAPS_SQL + "SELECT round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS null_percent FROM g")
def null_percent_query(spark, sf_dir):
    return rounded(null_percent(gaps(spark, sf_dir), "a"), "null_percent")


@query("drop_by_null_percent", GAPS_SQL + "SELECT event_id, user_id, event_type, a, b FROM g")
def drop_by_null_percent_query(spark, sf_dir):
    return drop_by_null_percent(gaps(spark, sf_dir).drop("ts"), 90)


@query("drop_empty_columns", GAPS_SQL + "SELECT event_id, user_id, event_type, a, b, c FROM g")
def drop_empty_columns_query(spark, sf_dir):
    return drop_empty_columns(gaps(spark, sf_dir).drop("ts"))


@query(
    "coverage_keep",
    GAPS_SQL
    + """, n AS (SELECT 'event_id' AS "column", count(event_id) AS n FROM g UNION ALL SELECT 'a', count(a) FROM g UNION ALL SELECT 'c', count(c) FROM g
  UNION ALL SELECT 'DailyGap', count(c) FROM g UNION ALL SELECT 'd', count(d) FROM g)
SELECT "column", n FROM n WHERE n >= 0.25 * (SELECT max(n) FROM n) OR "column" LIKE '%Daily%'""",
)
def coverage_keep_query(spark, sf_dir):
    rows = gaps(spark, sf_dir).select("event_id", "a", "c", F.col("c").alias("DailyGap"), "d")
    return coverage_keep(rows)


@query(
    "imputation_tracker",
    GAPS_SQL
    + " UNION ALL ".join(
        f"SELECT 'zero fill' AS step, '{c}' AS \"column\", round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_percent_before, 0.0::DOUBLE AS null_percent_after FROM g"
        for c in ("a", "b", "c", "d")
    ),
)
def imputation_tracker(spark, sf_dir):
    before = gaps(spark, sf_dir)
    cols = ["a", "b", "c", "d"]
    return rounded(track_imputation(before, fill_zero(before, cols), cols, "zero fill"), "null_percent_before", "null_percent_after")


@query(
    "describe_table",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, min({c}) AS lowest, max({c}) AS highest FROM lineitem"
        for c in _LINE
    ),
)
def describe_table_query(spark, sf_dir):
    described = describe_table(load(spark, sf_dir, "lineitem"), _LINE)
    return described.select(
        "column", "count", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"),
        F.col("min").cast("double").alias("lowest"), F.col("max").cast("double").alias("highest"),
    )


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows_query(spark, sf_dir):
    return distinct_rows(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "inconsistent_columns",
    """SELECT l_orderkey, count(*) AS n_combinations FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1 HAVING count(*) > 1""",
)
def inconsistent_columns_query(spark, sf_dir):
    return inconsistent_columns(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


@query("multiple_associations", "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def multiple_associations_query(spark, sf_dir):
    return multiple_associations(load(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("percent_different", GAPS_SQL + "SELECT round(count(*) FILTER (a <> b * (event_id % 3)) * 100.0::DOUBLE / count(*), 6) AS percent_different FROM g")
def percent_different_query(spark, sf_dir):
    rows = gaps(spark, sf_dir).select("a", (F.col("b") * (F.col("event_id") % 3)).alias("other"))
    return rounded(percent_different(rows, "a", "other"), "percent_different")


@query(
    "delay_component_shares",
    GAPS_SQL
    + """SELECT round(count(x) * 100.0::DOUBLE / count(*), 6) AS percent_present, round(count(*) FILTER (x <> 0) * 100.0::DOUBLE / count(*), 6) AS percent_nonzero,
round(count(*) FILTER (x = b) * 100.0::DOUBLE / count(*), 6) AS percent_equal_total FROM (SELECT a * (event_id % 3) AS x, b FROM g)""",
)
def delay_component_shares_query(spark, sf_dir):
    rows = gaps(spark, sf_dir).select((F.col("a") * (F.col("event_id") % 3)).alias("x"), "b")
    shares = delay_component_shares(rows, "x", "b")
    return rounded(shares, "percent_present", "percent_nonzero", "percent_equal_total")


@query(
    "null_accounting",
    GAPS_SQL
    + """SELECT count(*) FILTER (a IS NULL) AS n_null, count(*) FILTER (a IS NULL AND event_type = 'click') AS cancelled,
count(*) FILTER (a IS NULL AND event_type <> 'click' AND b > 50) AS diverted,
count(*) FILTER (a IS NULL AND event_type <> 'click' AND (b IS NULL OR b <= 50)) AS unexplained FROM g""",
)
def null_accounting_query(spark, sf_dir):
    """Why a value is missing, split into reasons that add up."""
    return null_accounting(gaps(spark, sf_dir), "a", cancelled=F.col("event_type") == "click", diverted=F.col("b") > 50)


def _corr_sql(pairs, a: str, b: str) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS {a}, '{y}' AS {b}, round(corr({x}, {y}), 6) AS r FROM lineitem" for x, y in pairs)


_PAIRS = [(_LINE[i], _LINE[j]) for i in range(4) for j in range(i + 1, 4)]


@query("pairwise_correlation", _corr_sql(_PAIRS, "a", "b"))
def pairwise_correlation_query(spark, sf_dir):
    return rounded(pairwise_correlation(load(spark, sf_dir, "lineitem"), _LINE), "r")


@query("family_correlation", _corr_sql([("l_discount", "l_quantity"), ("l_tax", "l_quantity"), ("l_tax", "l_discount")], "row_name", "column_name"))
def family_correlation_query(spark, sf_dir):
    """Lower triangle of the columns whose name contains ``t``, keys and dates left out."""
    return rounded(family_correlation(load(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax"), "t"), "r")


@query(
    "histogram",
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT bucket, round(lo + (hi - lo) / 100 * bucket, 6) AS low, round(lo + (hi - lo) / 100 * (bucket + 1), 6) AS high, n FROM b,
(SELECT CAST(least(floor((value - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bucket, count(*) AS n FROM events, b GROUP BY 1)""",
)
def histogram_query(spark, sf_dir):
    return rounded(histogram(load(spark, sf_dir, "events"), "value", 100), "low", "high")


def _box_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low_fence,
  round(q3 + 1.5 * (q3 - q1), 6) AS high_fence,
  (SELECT min({col}) FROM lineitem WHERE {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  (SELECT max({col}) FROM lineitem WHERE {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  (SELECT count(*) FROM lineitem WHERE NOT ({col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS q2, quantile_cont({col}, 0.75) AS q3 FROM lineitem)"""


@query("boxplot_stats", " UNION ALL ".join(_box_sql(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def boxplot_stats_query(spark, sf_dir):
    stats = boxplot_stats(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(stats, "q1", "median", "q3", "low_fence", "high_fence")


def _autocorrelation_sql(key: str) -> str:
    return f"""WITH l AS (SELECT {key}, CAST(ts AS DATE) AS d, value, lag(value) OVER (PARTITION BY {key}, CAST(ts AS DATE) ORDER BY ts, event_id) AS prev FROM events)
SELECT {key}, strftime(d, '%Y-%m-%d') AS day, count(*) AS n,
CASE WHEN min(prev) < max(prev) AND min(CASE WHEN prev IS NOT NULL THEN value END) < max(CASE WHEN prev IS NOT NULL THEN value END)
THEN round(corr(value, prev), 5) END AS autocorrelation FROM l GROUP BY {key}, d HAVING count(*) > 4"""


@query("origin_day_autocorrelation", _autocorrelation_sql("event_type"))
def origin_day_autocorrelation(spark, sf_dir):
    result = day_autocorrelation(load(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")
    return result.select("event_type", F.date_format("date_day", "yyyy-MM-dd").alias("day"), "n", F.round("autocorrelation", 5).alias("autocorrelation"))


@query("tail_day_autocorrelation", _autocorrelation_sql("user_id"))
def tail_day_autocorrelation(spark, sf_dir):
    result = day_autocorrelation(load(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    return result.select("user_id", F.date_format("date_day", "yyyy-MM-dd").alias("day"), "n", F.round("autocorrelation", 5).alias("autocorrelation"))


@query(
    "autocorrelation_function",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS x FROM orders GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY day) AS pos, x - (SELECT avg(x) FROM d) AS c FROM d)
SELECT CAST(k AS INTEGER) AS lag, round(sum(a.c * b.c) / (SELECT sum(c * c) FROM n), 6) AS autocorrelation
FROM n a, range(1, 51) r(k), n b WHERE b.pos = a.pos + k GROUP BY 1""",
)
def autocorrelation_function_query(spark, sf_dir):
    return rounded(autocorrelation_function(load(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 50), "autocorrelation")


@query(
    "z_scores",
    """SELECT event_id, round((value - m) / s, 6) AS value_z FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""",
)
def z_scores_query(spark, sf_dir):
    return rounded(z_scores(load(spark, sf_dir, "events").select("event_id", "value"), ["value"]), "value_z").select("event_id", "value_z")


@query(
    "class_balance",
    "SELECT event_type, count(*) AS n, count(*) FILTER (value >= 50) AS positives, count(*) FILTER (value >= 50) / count(*) AS positive_share FROM events GROUP BY 1",
)
def class_balance_query(spark, sf_dir):
    return class_balance(scores(spark, sf_dir), "label", ["event_type"])


@query("first_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def first_rows_query(spark, sf_dir):
    return first_rows(load(spark, sf_dir, "events").select("event_id", "value"), 25, F.col("value").desc(), F.col("event_id"))


@query("top_groups", "SELECT user_id, round(avg(value), 6) AS mean_value FROM events GROUP BY 1 ORDER BY avg(value) DESC, user_id LIMIT 20")
def top_groups_query(spark, sf_dir):
    return rounded(top_groups(load(spark, sf_dir, "events"), "user_id", "value", 20), "mean_value")


@query("bottom_groups", "SELECT user_id, round(avg(value), 6) AS mean_value FROM events GROUP BY 1 ORDER BY avg(value), user_id LIMIT 20")
def bottom_groups_query(spark, sf_dir):
    return rounded(top_groups(load(spark, sf_dir, "events"), "user_id", "value", 20, ascending=True), "mean_value")


@query("dimensions", "SELECT 11 AS n_columns, count(*) AS n_rows FROM lineitem")
def dimensions_query(spark, sf_dir):
    return dimensions(load(spark, sf_dir, "lineitem"))


@query("level_index", "SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS idx FROM (SELECT DISTINCT p_brand FROM part)")
def level_index_query(spark, sf_dir):
    """Alphabetic index of every category level."""
    return level_index(load(spark, sf_dir, "part"), "p_brand")


@query("level_index_by_frequency", """SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS DOUBLE) AS idx
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def level_index_by_frequency_query(spark, sf_dir):
    """Index by falling frequency, which the fitted indexer gives as well."""
    orders = load(spark, sf_dir, "orders").select("o_orderpriority")
    fitted = index_stage(["o_orderpriority"], order="frequencyDesc", source="").fit(orders).transform(orders).distinct()
    own = level_index(orders, "o_orderpriority", by_frequency=True)
    return fitted.select(F.col("o_orderpriority"), F.col("o_orderpriority_idx").alias("idx")).join(own, ["o_orderpriority", "idx"])


@query("schema_diff", """SELECT 'only_left' AS kind, c AS column, NULL AS was, NULL AS now FROM (VALUES ('ts'), ('user_id')) t(c)
UNION ALL VALUES ('only_right', 'hour', NULL, NULL), ('shared', 'event_id', NULL, NULL), ('shared', 'event_type', NULL, NULL), ('shared', 'props', NULL, NULL),
  ('shared', 'value', NULL, NULL), ('type_changed', 'event_id', 'bigint', 'string')""")
def schema_diff_query(spark, sf_dir):
    """What a build step did to the columns of events."""
    events = load(spark, sf_dir, "events")
    built = events.withColumns({"hour": F.hour("ts"), "event_id": F.col("event_id").cast("string")}).drop("ts", "user_id")
    found = schema_diff(events, built)
    rows = [(kind, *(c if isinstance(c, tuple) else (c, None, None))) for kind, listed in found.items() for c in listed]
    return rows_to_table(spark, rows, "kind string, column string, was string, now string")


@query(
    "distinct_sketches",
    """SELECT event_type, count(DISTINCT user_id) AS n_exact, true AS close FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1""",
)
def distinct_sketches_query(spark, sf_dir):
    """Users per event type between two days, from daily sketches, within three standard errors of the exact count."""
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first, last = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
    stored = materialize(distinct_sketches(events, ["event_type"], "day", "user_id"), "sketches")
    exact = distinct_counts(events.where(F.col("day").between(first, last)), ["event_type"], ["user_id"])
    both = exact.join(distinct_in_range(stored, ["event_type"], first, last), "event_type")
    close = F.abs(F.col("n") - F.col("n_user_id")) <= F.greatest(F.lit(1.0), F.col("n_user_id") * (3 / 64))
    return both.select("event_type", F.col("n_user_id").alias("n_exact"), close.alias("close"))


# Sixteen columns made of the keys, each with gaps of its own.
_WIDE = {f"w{k}": (k, f"(l_orderkey * {2 * k + 3} + l_partkey * {k + 1} + l_suppkey * {k % 3}) % {50 + k} + l_quantity * {k % 4}") for k in range(16)}
_WIDE_SQL = ", ".join(f"CASE WHEN l_orderkey % {k + 3} = 0 THEN NULL ELSE CAST({body} AS DOUBLE) END AS {name}" for name, (k, body) in _WIDE.items())


@query(
    "wide_correlation",
    f"WITH w AS (SELECT {_WIDE_SQL} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM w" for a, b in combinations(_WIDE, 2)),
)
def wide_correlation_query(spark, sf_dir):
    """All pairs of many columns with gaps, in one scan."""
    lines = load(spark, sf_dir, "lineitem")
    wide = lines.select(*(F.when(F.col("l_orderkey") % (k + 3) != 0, F.expr(body).cast("double")).alias(name) for name, (k, body) in _WIDE.items()))
    return rounded(correlation_matrix(wide, list(_WIDE)), "r")


@query("scale_by_deviation", "SELECT event_id, round(value / s, 6) AS value_scaled FROM events, (SELECT stddev_samp(value) AS s FROM events)")
def scale_by_deviation_query(spark, sf_dir):
    scaled = scale_by_deviation(load(spark, sf_dir, "events").select("event_id", "value"), ["value"])
    return scaled.select("event_id", F.round("value_scaled", 6).alias("value_scaled"))
