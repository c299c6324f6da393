"""Time the headline queries once each and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Some queries are also timed on the
smaller folders beside it; ``slope`` is the power of the rows with which their time grows between the two largest.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lagline.plans import REGISTRY  # noqa: E402
from lagline.session import build_session  # noqa: E402

FAILED: dict[str, str] = {}

HEADLINE = (
    # table build: as-of join, windows, fills, profiles
    "asof_join", "asof_join_both_ends", "delay_features", "lagged_mean", "lagged_last", "trailing_rate", "rolling_means",
    "forward_fill", "null_profile", "imputation_tracker", "add_group_stats", "carriers_per_route",
    # statistics
    "pairwise_correlation", "boxplot_stats", "tail_day_autocorrelation", "histogram", "describe_table",
    # chronological splits and evaluation
    "percent_rank", "time_blocks", "baseline_precision", "random_baseline", "cutoff_sweep", "model_comparison", "ensemble_metrics",
    # fits
    "lasso_validation_sweep", "forest_metrics", "perceptron_layouts", "trained_ensemble",
)


SCALED = ("asof_join", "delay_features", "lagged_mean", "forward_fill", "percent_rank", "boxplot_stats", "cutoff_sweep")


def seconds(spark, name: str, sf_dir: str) -> float | None:
    """Wall time of one run; None, with the error kept for the report, where the query fails."""
    start = time.perf_counter()
    try:
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception as error:  # one broken query must not lose the figures of the others
        FAILED[f"{name} {os.path.basename(sf_dir.rstrip('/'))}"] = str(error).split("\n")[0][:300]
        return None
    return round(time.perf_counter() - start, 3)


def scaling(spark, sf_dir: str, taken: dict[str, float]) -> dict[str, dict[str, float]]:
    """Seconds per folder, and the slope of the largest step."""
    own = os.path.basename(sf_dir.rstrip("/"))
    parent = os.path.dirname(sf_dir.rstrip("/"))
    others = sorted((f for f in os.listdir(parent) if f.startswith("sf") and float(f[2:]) < float(own[2:])), key=lambda f: float(f[2:])) if own.startswith("sf") else []
    out = {}
    for name in SCALED if others else ():
        if name in taken:
            line = {f: seconds(spark, name, f"{parent}/{f}") for f in others} | {own: taken[name]}
            growth = math.log(float(own[2:]) / float(others[-1][2:]))
            if line[own] and line[others[-1]]:
                line["slope"] = round(math.log(line[own] / line[others[-1]]) / growth, 2)
            out[name] = line
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "lagline-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["frequency"].run(spark, sf_dir).collect()  # start the executor threads and warm the file cache
    taken = {}
    for name in names:
        taken[name] = seconds(spark, name, sf_dir)
    grown = scaling(spark, sf_dir, taken)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(filter(None, taken.values())), 3), "unit": "sec",
        "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "scaling": grown, "failed": FAILED,
    }))


if __name__ == "__main__":
    main()
