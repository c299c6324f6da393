"""Chronological splits, sampling, and the evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.functions.scalars import hash_score
from lagline.models.evaluate import (
    PROBABILITY_CUTOFFS,
    add_cutoff_labels,
    classification_metrics,
    clean_sweep,
    compare_models,
    cutoff_sweep,
    ensemble,
    final_label_metrics,
    precision_at_recall,
    random_scores,
    ranking_quality,
    stack_sweeps,
    sweep_scores,
)
from lagline.models.selection import levels_from_votes, stable_features
from lagline.operators.folds import assign_blocks, block_bounds, block_ranges, split_by_year
from lagline.operators.ranks import row_number_folds, with_percent_rank
from lagline.operators.sampling import balance_by_keep, balance_by_ratio, hash_split, random_split, sample_at_most, sample_exactly, sample_fraction
from lagline.operators.stats import class_balance, histogram
from lagline.plans.common import SCORES_SQL, load, query, rounded, scores


@query("percent_rank", "SELECT event_id, percent_rank() OVER (ORDER BY ts) AS percent_rank FROM events")
def percent_rank(spark, sf_dir):
    """Chronological percentile of every row."""
    return with_percent_rank(load(spark, sf_dir, "events").select("event_id", "ts"), "ts").select("event_id", "percent_rank")


@query("percent_rank_ties", "SELECT o_orderkey, percent_rank() OVER (ORDER BY o_orderdate) AS percent_rank FROM orders")
def percent_rank_ties(spark, sf_dir):
    """The same with many rows per date."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_percent_rank(rows, "o_orderdate").select("o_orderkey", "percent_rank")


@query(
    "row_number_folds",
    "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) * 5 // (SELECT count(*) FROM events) AS INTEGER) AS fold FROM events",
)
def row_number_folds_query(spark, sf_dir):
    return row_number_folds(load(spark, sf_dir, "events").select("event_id"), "event_id", 5)


def _blocks_sql(table: str, key: str, time: str, blocks: int, split: float) -> str:
    parts = []
    for b in block_bounds(blocks, split):
        low = ">=" if b.role == "train" else ">"
        parts.append(f"SELECT {key}, {b.fold} AS fold, '{b.role}' AS role FROM r WHERE pr {low} {b.low!r}::DOUBLE AND pr <= {b.high!r}::DOUBLE")
    return f"WITH r AS (SELECT {key}, percent_rank() OVER (ORDER BY {time}) AS pr FROM {table}) " + " UNION ALL ".join(parts)


@query("time_blocks", _blocks_sql("events", "event_id", "ts", 3, 0.8))
def time_blocks(spark, sf_dir):
    """Blocked time-series folds: train and validation rows of each of three folds."""
    return assign_blocks(load(spark, sf_dir, "events").select("event_id", "ts"), "ts", 3, 0.8).select("event_id", "fold", "role")


@query("time_blocks_ties", _blocks_sql("orders", "o_orderkey", "o_orderdate", 5, 0.7))
def time_blocks_ties(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return assign_blocks(rows, "o_orderdate", 5, 0.7).select("o_orderkey", "fold", "role")


@query(
    "block_ranges",
    "WITH b AS (" + _blocks_sql("events", "ts", "ts", 3, 0.8)
    + ") SELECT fold, role, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM b GROUP BY 1, 2",
)
def block_ranges_query(spark, sf_dir):
    ranges = block_ranges(load(spark, sf_dir, "events").select("ts"), "ts", 3, 0.8)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return ranges.select("fold", "role", micros("first_time").alias("first_us"), micros("last_time").alias("last_us"))


@query(
    "split_by_year",
    """SELECT CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'train' WHEN o_orderdate < DATE '2000-01-01' THEN 'holdout' ELSE 'rest' END AS part,
count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def split_by_year_query(spark, sf_dir):
    train, holdout, rest = split_by_year(load(spark, sf_dir, "orders"), F.year("o_orderdate"), 1999)
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double"), 2).alias("total")
    measure = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), total)
    return measure(train, "train").unionByName(measure(holdout, "holdout")).unionByName(measure(rest, "rest"))


@query("fold_balance", f"SELECT fold, role, count(*) AS n, count(*) FILTER (value >= 50) AS positives, count(*) FILTER (value >= 50) / count(*) AS positive_share FROM ({_blocks_sql('events', 'event_id', 'ts', 3, 0.8)}) JOIN events USING (event_id) GROUP BY 1, 2")
def fold_balance(spark, sf_dir):
    """Positive share per fold and role."""
    return class_balance(assign_blocks(scores(spark, sf_dir), "ts", 3, 0.8), "label", ["fold", "role"])


# Sampling. The SQL versions use an integer score of the id instead of a hash.
@query("balance_by_keep", SCORES_SQL + "SELECT event_id, label FROM p WHERE label = 1 OR p1 < 0.2")
def balance_by_keep_query(spark, sf_dir):
    """All late rows and about a fifth of the others."""
    return balance_by_keep(scores(spark, sf_dir), "label", F.col("p1"), 0.2).select("event_id", "label")


@query(
    "balance_by_ratio",
    SCORES_SQL + "SELECT event_id, label FROM p WHERE label = 1 OR p1 < (SELECT count(*) FILTER (label = 1) / count(*) FILTER (label = 0) FROM p)",
)
def balance_by_ratio_query(spark, sf_dir):
    return balance_by_ratio(scores(spark, sf_dir), "label", F.col("p1")).select("event_id", "label")


def _drawn_sql(table: str, key: str, wanted: str) -> str:
    """Facts of a sample by key: all rows of a key go together, and their number lies within six deviations of what is wanted."""
    return f"""WITH k AS (SELECT {key}, count(*) AS m FROM {table} GROUP BY 1),
f AS (SELECT least(1.0, ({wanted}) / sum(m)) AS p, sum(m) AS n, sum(m * m) AS n2 FROM k)
SELECT true AS near, 0 AS split_keys, n AS total FROM f"""


def _drawn(table, sample, key: str, fraction):
    """The same facts of a real sample."""
    sizes = table.groupBy(key).agg(F.count("*").alias("m"))
    found = sample.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("s"))
    both = sizes.join(found, F.col(key) == F.col("__key"), "left")
    total, drawn = F.sum("m"), F.coalesce(F.sum("s"), F.lit(0))
    p = fraction(total)
    return both.agg(
        (F.abs(drawn - total * p) <= 6 * F.sqrt(F.sum(F.col("m") * F.col("m")) * p * (1 - p)) + 1).alias("near"),
        F.sum((F.col("s").isNotNull() & (F.col("s") != F.col("m"))).cast("int")).alias("split_keys"), total.alias("total"))


@query("sample_fraction", _drawn_sql("lineitem", "l_orderkey", "0.1 * sum(m)"))
def sample_fraction_query(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey")
    return _drawn(rows, sample_fraction(rows, "l_orderkey", 0.1), "l_orderkey", lambda _: F.lit(0.1))


@query("sample_exactly", "SELECT event_id, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 777")
def sample_exactly_query(spark, sf_dir):
    """Exactly so many rows, chosen by their keys."""
    return sample_exactly(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 777)


@query("sample_at_most", _drawn_sql("events", "event_id", "500"))
def sample_at_most_query(spark, sf_dir):
    """About 500 rows of any number."""
    rows = load(spark, sf_dir, "events").select("event_id")
    return _drawn(rows, sample_at_most(rows, "event_id", 500), "event_id", lambda n: F.least(F.lit(1.0), 500 / n))


@query("sample_for_plot", _drawn_sql("lineitem", "l_orderkey", "3000"))
def sample_for_plot(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return _drawn(rows, sample_at_most(rows, "l_orderkey", 3000), "l_orderkey", lambda n: F.least(F.lit(1.0), 3000 / n))


@query(
    "hash_balanced",
    SCORES_SQL + "SELECT label, CASE WHEN label = 1 THEN count(*) END AS n, true AS near, count(*) AS total FROM p GROUP BY 1",
)
def hash_balanced(spark, sf_dir):
    """All positives and near a fifth of the negatives (six deviations)."""
    rows = scores(spark, sf_dir)
    kept = balance_by_keep(rows, "label", hash_score("event_id"), 0.2).groupBy(F.col("label").alias("l")).agg(F.count("*").alias("kept"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("total"))
    near = F.when(F.col("label") == 1, F.col("kept") == F.col("total")).otherwise(
        F.abs(F.col("kept") - 0.2 * F.col("total")) <= 6 * F.sqrt(0.16 * F.col("total")))
    return sizes.join(kept, F.col("label") == F.col("l"), "left").select("label", F.when(F.col("label") == 1, F.col("kept")).alias("n"), near.alias("near"), "total")


_SPLIT_SQL = """SELECT count(*) AS n, count(*) AS n_keys, 1 AS most_parts, true AS near FROM events"""


def _split_facts(parts, shares):
    """Rows and keys of all parts together, in how many parts a key is at most, and whether every part is near its share."""
    marked = None
    for i, part in enumerate(parts):
        part = part.select("event_id", F.lit(i).alias("part"))
        marked = part if marked is None else marked.unionByName(part)
    per_key = marked.groupBy("event_id").agg(F.count("*").alias("m"), F.countDistinct("part").alias("k"), *(
        F.max((F.col("part") == i).cast("int")).alias(f"p{i}") for i in range(len(shares))))
    n = F.sum("m")
    near = F.lit(True)
    for i, share in enumerate(shares):
        near = near & (F.abs(F.sum(f"p{i}") - share * n) <= 6 * F.sqrt(n * share * (1 - share)))
    return per_key.agg(n.alias("n"), F.count("*").alias("n_keys"), F.max("k").alias("most_parts"), near.alias("near"))


@query("random_split", _SPLIT_SQL)
def random_split_query(spark, sf_dir):
    parts = random_split(load(spark, sf_dir, "events").select("event_id"), "event_id", [5, 3, 2])
    return _split_facts(parts, [0.5, 0.3, 0.2])


@query("hash_split_cover", _SPLIT_SQL)
def hash_split_cover(spark, sf_dir):
    """The two parts of a key-hash split hold every row once."""
    return _split_facts(hash_split(load(spark, sf_dir, "events").select("event_id"), "event_id"), [0.7, 0.3])


_C = ", ".join(f"({c!r}::DOUBLE)" for c in PROBABILITY_CUTOFFS)


def _sweep_sql(score: str, cutoffs: str = _C) -> str:
    return f"""SELECT c AS "Cutoff", tp AS "TP", fp AS "FP", tp * 100.0::DOUBLE / nullif(tp + fp, 0) AS "Precision", tp * 100.0::DOUBLE / nullif(pos, 0) AS "Recall" FROM (
  SELECT c, count(*) FILTER ({score} >= c AND label = 1) AS tp, count(*) FILTER ({score} >= c AND label = 0) AS fp, count(*) FILTER (label = 1) AS pos
  FROM p, (VALUES {cutoffs}) v(c) GROUP BY c)"""


def _at_recall_sql(sweep: str, recall: float = 80) -> str:
    """Precision at a recall of a sweep with a ``model`` column."""
    return f"""SELECT model, round(arg_max(pt, k), 6) AS "precision" FROM (
  SELECT model, CASE WHEN "Recall" > {recall} AND r2 < {recall} THEN i ELSE 0 END AS k,
         p2 - (p2 - "Precision") * ((r2 - {recall}) / nullif(r2 - "Recall", 0)) AS pt, i, "Recall", r2
  FROM (SELECT *, lead("Precision") OVER w AS p2, lead("Recall") OVER w AS r2, row_number() OVER w AS i FROM ({sweep}) WINDOW w AS (PARTITION BY model ORDER BY "Cutoff")))
WHERE ("Recall" > {recall} AND r2 < {recall}) OR i = 1 GROUP BY model"""


@query("cutoff_sweep", SCORES_SQL + f"""SELECT "Cutoff", "TP", "FP", round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall" FROM ({_sweep_sql('p1')})""")
def cutoff_sweep_query(spark, sf_dir):
    return rounded(cutoff_sweep(scores(spark, sf_dir), "p1", "label", PROBABILITY_CUTOFFS), "Precision", "Recall")


@query(
    "clean_sweep",
    SCORES_SQL + f"""SELECT "Cutoff", "TP", "FP", round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall" FROM ({_sweep_sql('p1', _C + ", (0.995::DOUBLE), (1.5::DOUBLE)")})
WHERE NOT coalesce("Precision" < 1 OR "Recall" < 1 OR "Precision" > 90, false)""",
)
def clean_sweep_query(spark, sf_dir):
    sweep = cutoff_sweep(scores(spark, sf_dir), "p1", "label", (*PROBABILITY_CUTOFFS, 0.995, 1.5))
    return rounded(clean_sweep(sweep), "Precision", "Recall")


@query("precision_at_recall", SCORES_SQL + f"""SELECT "precision" FROM ({_at_recall_sql("SELECT 1 AS model, * FROM (" + _sweep_sql("p2") + ")")})""")
def precision_at_recall_query(spark, sf_dir):
    sweep = cutoff_sweep(scores(spark, sf_dir), "p2", "label", PROBABILITY_CUTOFFS)
    return rounded(precision_at_recall(sweep), "precision")


_STACKED = " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({_sweep_sql(c)})" for m, c in (("mlp", "p1"), ("lr", "p2"), ("rf", "p3")))


@query("stack_sweeps", SCORES_SQL + f"""SELECT model, "Cutoff", "TP", "FP", round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall" FROM ({_STACKED})""")
def stack_sweeps_query(spark, sf_dir):
    rows = scores(spark, sf_dir)
    sweeps = {m: cutoff_sweep(rows, c, "label", PROBABILITY_CUTOFFS) for m, c in (("mlp", "p1"), ("lr", "p2"), ("rf", "p3"))}
    return rounded(stack_sweeps(sweeps), "Precision", "Recall")


@query(
    "model_comparison",
    SCORES_SQL + _at_recall_sql(f"""SELECT * FROM ({_STACKED}) WHERE NOT coalesce("Precision" < 1 OR "Recall" < 1 OR "Precision" > 90, false)"""),
)
def model_comparison(spark, sf_dir):
    """Precision at 80 % recall of three models, from one pass over their scores."""
    swept = sweep_scores(scores(spark, sf_dir), {"mlp": "p1", "lr": "p2", "rf": "p3"}, "label", PROBABILITY_CUTOFFS)
    return rounded(precision_at_recall(clean_sweep(swept), 80.0, ["model"]), "precision")


@query(
    "model_comparison_by_table",
    SCORES_SQL + _at_recall_sql(f"""SELECT * FROM ({_STACKED}) WHERE NOT coalesce("Precision" < 1 OR "Recall" < 1 OR "Precision" > 90, false)"""),
)
def model_comparison_by_table(spark, sf_dir):
    """The same from one sweep table per model."""
    rows = scores(spark, sf_dir)
    sweeps = {m: cutoff_sweep(rows, c, "label", PROBABILITY_CUTOFFS) for m, c in (("mlp", "p1"), ("lr", "p2"), ("rf", "p3"))}
    return rounded(compare_models(sweeps), "precision")


_WEIGHTS = {"p1": 0.1, "p2": 0.2, "p3": 0.7}
_ENSEMBLE_SQL = SCORES_SQL + """, s AS (SELECT *, p1 * 0.1::DOUBLE + p2 * 0.2::DOUBLE + p3 * 0.7::DOUBLE AS score FROM p),
e AS (SELECT *, CASE WHEN score > 0.445::DOUBLE THEN 1 ELSE 0 END AS final FROM s)
"""


@query("ensemble", _ENSEMBLE_SQL + "SELECT event_id, score, final FROM e")
def ensemble_query(spark, sf_dir):
    return ensemble(scores(spark, sf_dir), _WEIGHTS).select("event_id", "score", "final")


@query(
    "ensemble_metrics",
    _ENSEMBLE_SQL
    + """SELECT "TP", "FP", positives, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(2 * pr * rc / nullif(pr + rc, 0), 6) AS f1, round(5 * pr * rc / nullif(rc + 4 * pr, 0), 6) AS f2
FROM (SELECT *, "TP" * 100.0::DOUBLE / nullif("TP" + "FP", 0) AS pr, "TP" * 100.0::DOUBLE / nullif(positives, 0) AS rc FROM (
  SELECT count(*) FILTER (final = 1 AND label = 1) AS "TP", count(*) FILTER (final = 1 AND label = 0) AS "FP", count(*) FILTER (label = 1) AS positives FROM e))""",
)
def ensemble_metrics(spark, sf_dir):
    metrics = final_label_metrics(ensemble(scores(spark, sf_dir), _WEIGHTS), "final", "label")
    return rounded(metrics, "precision", "recall", "f1", "f2")


@query(
    "model_labels",
    SCORES_SQL + """SELECT event_id, CASE WHEN p2 > 0.4 THEN 1 ELSE 0 END AS lr_label, CASE WHEN p1 > 0.4 THEN 1 ELSE 0 END AS mlp_label, CASE WHEN p3 > 0.46 THEN 1 ELSE 0 END AS rf_label FROM p""",
)
def model_labels(spark, sf_dir):
    labelled = add_cutoff_labels(scores(spark, sf_dir), {"lr_label": ("p2", 0.4), "mlp_label": ("p1", 0.4), "rf_label": ("p3", 0.46)})
    return labelled.select("event_id", "lr_label", "mlp_label", "rf_label")


@query(
    "delay_by_predicted_class",
    _ENSEMBLE_SQL + """, b AS (SELECT final, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1)
SELECT final, bucket, round(lo + (hi - lo) / 100 * bucket, 6) AS low, round(lo + (hi - lo) / 100 * (bucket + 1), 6) AS high, n
FROM b JOIN (SELECT final, CAST(least(floor((value - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bucket, count(*) AS n FROM e JOIN b USING (final) GROUP BY 1, 2) USING (final)""",
)
def delay_by_predicted_class(spark, sf_dir):
    """Histogram of the delay for rows predicted late and on time."""
    return rounded(histogram(ensemble(scores(spark, sf_dir), _WEIGHTS), "value", 100, ["final"]), "low", "high")


@query(
    "classification_metrics",
    SCORES_SQL
    + """, m AS (SELECT CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS said, label FROM p),
c AS (SELECT count(*) AS n, count(*) FILTER (said = label) AS hits, count(*) FILTER (said = 1 AND label = 1) AS t1, count(*) FILTER (said = 0 AND label = 0) AS t0,
  count(*) FILTER (said = 1) AS s1, count(*) FILTER (said = 0) AS s0, count(*) FILTER (label = 1) AS i1, count(*) FILTER (label = 0) AS i0 FROM m),
r AS (SELECT *, t1 / s1 AS p1, t0 / s0 AS p0, t1 / i1 AS r1, t0 / i0 AS r0 FROM c)
SELECT round(hits / n, 6) AS accuracy, round((p0 * i0 + p1 * i1) / n, 6) AS weighted_precision, round((r0 * i0 + r1 * i1) / n, 6) AS weighted_recall,
round((2 * p0 * r0 / (p0 + r0) * i0 + 2 * p1 * r1 / (p1 + r1) * i1) / n, 6) AS f1, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1 FROM r""",
)
def classification_metrics_query(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("said", F.when(F.col("p1") >= 0.5, 1).otherwise(0))
    metrics = classification_metrics(rows, "said", "label")
    return rounded(metrics, *metrics.columns)


@query(
    "random_baseline",
    SCORES_SQL + f"""SELECT "Cutoff", "TP", "FP", round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall" FROM ({_sweep_sql('p3', "(0.0::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)")})""",
)
def random_baseline(spark, sf_dir):
    """Random guess, with the score taken from the id so that SQL can repeat it."""
    return rounded(cutoff_sweep(scores(spark, sf_dir), "p3", "label", (0.0, 0.2, 0.4, 0.6, 0.8)), "Precision", "Recall")


@query("random_guess_sweep")
def random_guess_sweep(spark, sf_dir):
    """Random guess with the library's hashed score."""
    return cutoff_sweep(random_scores(scores(spark, sf_dir), "event_id"), "score", "label", (0.0, 0.2, 0.4, 0.6, 0.8))


# Weights per fold and feature, derived from the data: the centred mean of a type in each fold.
_WEIGHTS_SQL = """
WITH w AS (SELECT CAST(event_id % 3 AS INTEGER) AS fold, event_type AS feature,
  (CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) % 17) / 800.0::DOUBLE AS weight FROM events GROUP BY 1, 2)
"""


def _weights(spark, sf_dir):
    return scores(spark, sf_dir).groupBy((F.col("event_id") % 3).cast("int").alias("fold"), F.col("event_type").alias("feature")).agg(
        (F.sum("label") % 17 / F.lit(800.0)).alias("weight")
    )


@query("stable_features", _WEIGHTS_SQL + "SELECT feature, CAST(count(DISTINCT fold) AS INTEGER) AS votes FROM w WHERE weight * weight > 1e-4::DOUBLE GROUP BY 1 HAVING count(DISTINCT fold) >= 2")
def stable_features_query(spark, sf_dir):
    """Features whose weight is significant in at least two folds."""
    return stable_features(_weights(spark, sf_dir))


_VOTES_SQL = """
WITH v AS (
  SELECT CAST(row_number() OVER (ORDER BY p_brand) AS VARCHAR) || ': BRAND = ' || p_brand AS feature, CAST(count(*) % 4 AS INTEGER) AS votes FROM part GROUP BY p_brand
  UNION ALL SELECT 'size_' || p_type, CAST(sum(p_size) % 4 AS INTEGER) FROM part GROUP BY p_type),
s AS (SELECT string_split(regexp_replace(feature, '^\\d+: ', ''), ' = ') AS parts FROM v WHERE votes >= 2)
"""


@query(
    "levels_from_votes",
    _VOTES_SQL + """SELECT parts[1] AS "column", count(parts[2]) = 0 AS is_numeric, coalesce(array_to_string(list_sort(list(DISTINCT parts[2]) FILTER (parts[2] IS NOT NULL)), '|'), '') AS levels FROM s GROUP BY 1""",
)
def levels_from_votes_query(spark, sf_dir):
    from lagline.models.features import level_index

    part = load(spark, sf_dir, "part")
    position = level_index(part, "p_brand", "pos").withColumnRenamed("p_brand", "brand")
    counts = part.groupBy("p_brand").agg((F.count(F.lit(1)) % 4).cast("int").alias("votes"))
    named = counts.join(position, F.col("p_brand") == F.col("brand")).select(
        F.concat((F.col("pos") + 1).cast("int").cast("string"), F.lit(": BRAND = "), "p_brand").alias("feature"), "votes"
    )
    bare = part.groupBy("p_type").agg((F.sum("p_size") % 4).cast("int").alias("votes")).select(F.concat(F.lit("size_"), "p_type").alias("feature"), "votes")
    return levels_from_votes(named.unionByName(bare)).withColumn("levels", F.concat_ws("|", "levels"))


@query("fold_union", "SELECT 'a' AS part, event_id FROM events WHERE value >= 50 UNION ALL SELECT 'b', event_id FROM events WHERE value < 60")
def fold_union(spark, sf_dir):
    """Outputs of two parts stacked; overlapping rows stay twice."""
    rows = scores(spark, sf_dir)
    a = rows.filter(F.col("value") >= 50).select(F.lit("a").alias("part"), "event_id")
    return a.unionByName(rows.filter(F.col("value") < 60).select(F.lit("b").alias("part"), "event_id"))


@query(
    "ranking_quality",
    SCORES_SQL + """, t AS (SELECT event_type, round(p1, 1) AS s, label FROM p),
c AS (SELECT event_type, s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM t GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER (PARTITION BY event_type) AS positives, sum(neg) OVER (PARTITION BY event_type) AS negatives,
  sum(pos) OVER (PARTITION BY event_type ORDER BY s) - pos AS pb, sum(neg) OVER (PARTITION BY event_type ORDER BY s) - neg AS nb FROM c)
SELECT event_type, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, round(sum(pos * (nb + neg / 2.0::DOUBLE)) / positives / negatives, 9) AS auc,
  round(sum(pos * (positives - pb) / (positives - pb + negatives - nb)::DOUBLE) / positives, 9) AS average_precision
FROM r GROUP BY event_type, positives, negatives""",
)
def ranking_quality_query(spark, sf_dir):
    """Area under the curve and average precision of a much tied score, per carrier."""
    tied = scores(spark, sf_dir).select("event_type", F.round("p1", 1).alias("s"), "label")
    return rounded(ranking_quality(tied, "s", "label", ["event_type"]), "auc", "average_precision", digits=9)
