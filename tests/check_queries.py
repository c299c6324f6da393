"""Run registered queries against DuckDB: ``python tests/check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from glob import glob

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (np.ndarray, list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (bool, np.bool_)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return None if np.isnan(value) else float(value)
    if isinstance(value, (int, np.integer)):
        return float(value)
    return str(value)


def normal_rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    left, right = normal_rows(spark_frame), normal_rows(duck_frame)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[0]}" if wrong else None


def main() -> int:
    from lagline.plans import REGISTRY
    from lagline.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args or list(REGISTRY)
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        query = REGISTRY[name]
        start = time.time()
        try:
            got = query.run(spark, sf_dir).toPandas()
        except Exception as err:  # noqa: BLE001 - every failure is listed
            print(f"FAIL {name}: {str(err)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if query.sql is None:
            print(f"rows {name}: {len(got)} rows, {took:.2f}s")
            continue
        try:
            verdict = compare(got, con.execute(query.sql).fetchdf())
        except Exception as err:  # noqa: BLE001
            verdict = f"sql: {str(err)[:800]}"
        bad += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name}: {verdict or str(len(got)) + ' rows'}, {took:.2f}s")
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
