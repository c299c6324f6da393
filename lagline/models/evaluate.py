"""Evaluation of scores: cutoff sweeps, precision at a fixed recall, ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagline.functions.scalars import cutoff_label, hash_score, weighted_score
from lagline.operators.ranks import running_sums

# Cutoffs of the published sweeps, ensemble weights and decision cutoffs.
PROBABILITY_CUTOFFS = (0.0, 0.30, 0.40, 0.45, 0.60, 0.80)
MINUTE_CUTOFFS = (-3.0, 0.0, 2.0, 3.0, 5.0, 10.0, 30.0, 60.0)
ENSEMBLE_WEIGHTS = {"mlp_prob_pos": 0.1, "eng_lr_prob_pos": 0.2, "rf_prob_pos": 0.7}
ENSEMBLE_CUTOFF_VALIDATION = 0.445
ENSEMBLE_CUTOFF_FINAL = 0.440


def cutoff_sweep(df: DataFrame, score: str, label: str, cutoffs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, Cutoff, TP, FP, Precision, Recall in %) of "score >= cutoff" for every cutoff.

    A row is counted once, at the highest cutoff it reaches; totals per cutoff are sums over that
    table of at most (cutoffs + 1) rows per key. Recall is against all positives with a label.
    Precision is null where nothing is predicted, recall where nothing is positive.
    """
    keys = list(keys)
    levels = sorted(float(c) for c in cutoffs)
    reached = F.lit(-1)
    for i, level in enumerate(levels):
        reached = F.when(F.col(score) >= level, F.lit(i)).otherwise(reached)
    counted = df.groupBy(*keys, reached.alias("__level")).agg(
        F.count(F.when(F.col(label) > 0, 1)).alias("__pos"), F.count(F.when(F.col(label) < 1, 1)).alias("__neg")
    )
    sums = [F.sum(F.when(F.col("__level") >= i, F.col(n))).alias(f"{n}{i}") for i in range(len(levels)) for n in ("__pos", "__neg")]
    totals = counted.groupBy(*keys).agg(F.sum("__pos").alias("__all"), *sums)
    rows = F.inline(
        F.array(
            *(
                F.struct(
                    F.lit(level).alias("Cutoff"),
                    F.coalesce(F.col(f"__pos{i}"), F.lit(0)).alias("TP"),
                    F.coalesce(F.col(f"__neg{i}"), F.lit(0)).alias("FP"),
                )
                for i, level in enumerate(levels)
            )
        )
    )
    listed = totals.select(*keys, "__all", rows)
    return listed.select(
        *keys, "Cutoff", "TP", "FP",
        (F.col("TP") * F.lit(100.0) / F.nullif(F.col("TP") + F.col("FP"), F.lit(0))).alias("Precision"),
        (F.col("TP") * F.lit(100.0) / F.nullif(F.col("__all"), F.lit(0))).alias("Recall"),
    )


def ranking_quality(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, positives, negatives, auc, average_precision) of a score, exact whatever its ties.

    ``auc`` is the share of pairs of a positive and a negative row that the score puts in order, equal scores counting half;
    ``average_precision`` is the precision at every distinct score, weighted by the positives that have it. Rows are counted per key and score,
    and running sums over the distinct scores are formed in buckets, so no key is sorted in one task. Rows without score or label are left
    out; a measure is null where a class is missing.
    """
    keys = list(keys)
    known = df.select(*keys, F.col(score).cast("double").alias("__s"), (F.col(label) > 0).alias("__y")).filter(F.col("__s").isNotNull() & F.col("__y").isNotNull())
    counts = known.groupBy(*keys, "__s").agg(F.count(F.when(F.col("__y"), 1)).alias("__pos"), F.count(F.when(~F.col("__y"), 1)).alias("__neg"))
    totals = counts.groupBy(*keys).agg(F.sum("__pos").alias("positives"), F.sum("__neg").alias("negatives"))
    running = running_sums(counts, "__s", ["__pos", "__neg"], keys)
    if keys:
        renamed = totals.select(*(F.col(k).alias(f"__j_{k}") for k in keys), "positives", "negatives")
        rows = running.join(renamed, [running[k].eqNullSafe(renamed[f"__j_{k}"]) for k in keys])
    else:
        rows = running.select("*", totals.agg(F.first(F.struct("positives", "negatives"))).scalar().alias("__all")).select("*", "__all.*")
    whole = lambda c: c.cast("decimal(19,0)")
    in_order = F.sum(whole(F.col("__pos")) * whole(2 * F.col("__neg_before") + F.col("__neg")))
    found, said = F.col("positives") - F.col("__pos_before"), F.col("positives") + F.col("negatives") - F.col("__pos_before") - F.col("__neg_before")
    none_to_null = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    rated = rows.groupBy(*keys, "positives", "negatives").agg(in_order.cast("double").alias("__order"), F.sum(F.col("__pos") * found / said).alias("__precision"))
    return rated.select(
        *keys, "positives", "negatives", (F.col("__order") / 2 / none_to_null(F.col("positives")) / none_to_null(F.col("negatives"))).alias("auc"),
        (F.col("__precision") / none_to_null(F.col("positives"))).alias("average_precision"))


def clean_sweep(sweep: DataFrame) -> DataFrame:
    """Drop the points of a sweep that are noise: precision or recall below 1 %, precision above 90 %.

    A point without a precision or recall stays, as it is in no such range.
    """
    noise = (F.col("Precision") < 1) | (F.col("Recall") < 1) | (F.col("Precision") > 90)
    return sweep.filter(~F.coalesce(noise, F.lit(False)))


def precision_at_recall(sweep: DataFrame, recall: float = 80.0, keys: Sequence[str] = (), name: str = "precision") -> DataFrame:
    """Precision at the given recall, linear between the two cutoffs whose recalls enclose it.

    Points are taken in cutoff order; the last pair with recalls strictly on both sides counts, and
    the first pair where there is none. Works on sweeps (a few rows per key), not on data.
    """
    keys = list(keys)
    # A sweep has one row per cutoff and key, so even the keyless window is tiny.
    order = W.partitionBy(*keys).orderBy("Cutoff")
    nxt = lambda c: F.lead(c).over(order)
    pairs = sweep.select(
        *keys, "Precision", "Recall", nxt("Precision").alias("__p"), nxt("Recall").alias("__r"), F.row_number().over(order).alias("__i")
    )
    crosses = (F.col("Recall") > recall) & (F.col("__r") < recall)
    usable = pairs.filter(crosses | (F.col("__i") == 1))
    rank = F.when(crosses, F.col("__i")).otherwise(0)
    point = F.col("__p") - (F.col("__p") - F.col("Precision")) * ((F.col("__r") - recall) / F.nullif(F.col("__r") - F.col("Recall"), F.lit(0.0)))
    return usable.groupBy(*keys).agg(F.max_by(point, rank).alias(name))


def stack_sweeps(sweeps: Mapping[str, DataFrame]) -> DataFrame:
    """Sweeps of several models in one table with a ``model`` column."""
    stacked = None
    for model, sweep in sweeps.items():
        named = sweep.select(F.lit(model).alias("model"), "Cutoff", "TP", "FP", "Precision", "Recall")
        stacked = named if stacked is None else stacked.unionByName(named)
    return stacked


def compare_models(sweeps: Mapping[str, DataFrame], recall: float = 80.0) -> DataFrame:
    """(model, precision) at the given recall after removing noise points."""
    return precision_at_recall(clean_sweep(stack_sweeps(sweeps)), recall, ["model"])


def sweep_scores(df: DataFrame, scores: Mapping[str, str], label: str, cutoffs: Sequence[float]) -> DataFrame:
    """Sweep of several score columns of one table in one pass, with a ``model`` column."""
    long = df.select(F.col(label).alias("label"), F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()))))
    return cutoff_sweep(long, "score", "label", cutoffs, ["model"])


def random_scores(df: DataFrame, key: str, name: str = "score", seed: int = 42) -> DataFrame:
    """The random-guess baseline: a uniform score per key."""
    return df.withColumn(name, hash_score(key, seed))


def error_stats(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: mean and sample deviation of predicted minus actual."""
    error = F.col(predicted) - F.col(actual)
    return df.agg(F.avg(error).alias("mean_error"), F.stddev_samp(error).alias("std_error"))


def add_cutoff_labels(df: DataFrame, cutoffs: Mapping[str, tuple[str, float]], strict: bool = True) -> DataFrame:
    """Predicted label per model: label column -> (score column, cutoff)."""
    return df.withColumns({name: cutoff_label(score, cutoff, strict) for name, (score, cutoff) in cutoffs.items()})


def ensemble(df: DataFrame, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS, cutoff: float = ENSEMBLE_CUTOFF_VALIDATION) -> DataFrame:
    """Weighted score of several models and the final label of scores above the cutoff."""
    scored = df.withColumn("score", weighted_score(weights))
    return scored.withColumn("final", cutoff_label("score", cutoff, strict=True))


def final_label_metrics(df: DataFrame, predicted: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """TP, FP, positives and precision, recall, F1, F2 in % of a predicted label."""
    counted = df.groupBy(*keys).agg(
        F.count(F.when((F.col(predicted) > 0) & (F.col(label) > 0), 1)).alias("TP"),
        F.count(F.when((F.col(predicted) > 0) & (F.col(label) < 1), 1)).alias("FP"),
        F.count(F.when(F.col(label) > 0, 1)).alias("positives"),
    )
    rated = counted.withColumns(
        {
            "precision": F.col("TP") * F.lit(100.0) / F.nullif(F.col("TP") + F.col("FP"), F.lit(0)),
            "recall": F.col("TP") * F.lit(100.0) / F.nullif(F.col("positives"), F.lit(0)),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumns({"f1": 2 * p * r / F.nullif(p + r, F.lit(0.0)), "f2": 5 * p * r / F.nullif(r + 4 * p, F.lit(0.0))})


def classification_metrics(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1, and precision and recall of class 1."""
    pairs = df.filter(F.col(predicted).isNotNull() & F.col(label).isNotNull())
    is_, said = lambda k: F.col(label) == k, lambda k: F.col(predicted) == k
    n = lambda condition: F.count(F.when(condition, 1))
    counted = pairs.agg(
        F.count(F.lit(1)).alias("n"), n(F.col(label) == F.col(predicted)).alias("hits"),
        *(n(is_(k) & said(k)).alias(f"tp{k}") for k in (0, 1)),
        *(n(said(k)).alias(f"said{k}") for k in (0, 1)),
        *(n(is_(k)).alias(f"is{k}") for k in (0, 1)),
    )
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    parts = counted.withColumns({f"p{k}": ratio(f"tp{k}", f"said{k}") for k in (0, 1)}).withColumns({f"r{k}": ratio(f"tp{k}", f"is{k}") for k in (0, 1)})
    f1 = lambda k: F.coalesce(2 * F.col(f"p{k}") * F.col(f"r{k}") / F.nullif(F.col(f"p{k}") + F.col(f"r{k}"), F.lit(0.0)), F.lit(0.0))
    weighted = lambda of: (of(0) * F.col("is0") + of(1) * F.col("is1")) / F.col("n")
    return parts.select(
        (F.col("hits") / F.col("n")).alias("accuracy"),
        weighted(lambda k: F.col(f"p{k}")).alias("weighted_precision"),
        weighted(lambda k: F.col(f"r{k}")).alias("weighted_recall"),
        weighted(f1).alias("f1"),
        F.col("p1").alias("precision_1"),
        F.col("r1").alias("recall_1"),
    )


def sparse_fallback_mean(df: DataFrame, mean: str, count: str, fallback: str, minimum: int = 3) -> Column:
    """The fine-grained mean where enough rows are behind it, else the coarse one."""
    return F.when(F.col(count) >= minimum, F.col(mean)).otherwise(F.col(fallback))


def one_tailed_z(mean: Column, spread: Column, n: Column, threshold: float = 15.0) -> Column:
    """z of "the mean is at least the threshold"; null without spread."""
    return (mean - threshold) / F.nullif(spread / F.sqrt(n), F.lit(0.0))
