"""Every registered query against DuckDB on the smallest tables, and what their plans must not contain."""

from __future__ import annotations

import os
import re

import pytest
from check_queries import compare, duck

import __spark_entry__ as entry_module
from lagline.plans import REGISTRY

SQL_NAMES = sorted(name for name, query in REGISTRY.items() if query.sql)
ITERATIVE = sorted(name for name, query in REGISTRY.items() if query.run.__module__.endswith("training"))


@pytest.fixture(scope="module")
def con(small_tables):
    return duck(small_tables)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_equals_sql(spark, small_tables, con, name):
    got = REGISTRY[name].run(spark, small_tables).toPandas()
    assert compare(got, con.execute(REGISTRY[name].sql).fetchdf()) is None


def test_rows_only_queries_run(spark, small_tables):
    for name in sorted(set(REGISTRY) - set(SQL_NAMES) - set(ITERATIVE)):
        assert REGISTRY[name].run(spark, small_tables).count() > 0, name


# The grid of 45 fits is too slow for a test; tests/test_models.py searches a smaller one.
@pytest.mark.parametrize("name", sorted(set(ITERATIVE) - set(SQL_NAMES) - {"forest_grid"}))
def test_training_queries_run(spark, small_tables, name):
    assert REGISTRY[name].run(spark, small_tables).count() > 0


def test_entry_points(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["Cutoff", "TP", "FP", "Precision", "Recall"] and frame.count() == 8
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


# Windows over all rows are fine only where one row per cutoff, day, level or rank bucket is left.
BOUNDED_WINDOWS = ("__bucket", "__coarse", "Cutoff", "day#", "p_brand", "o_orderpriority", "at#", "__h#")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ITERATIVE) - {"stream_ingest"}))
def test_plan_has_no_python_and_no_unbounded_window(spark, small_tables, name):
    plan = REGISTRY[name].run(spark, small_tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|CartesianProduct|BroadcastNestedLoopJoin", plan), name
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and re.search(r"\], \[[^\]]*\]$|windowspecdefinition", line) and "SinglePartition" in "".join(lines[i : i + 4]):
            assert any(mark in line for mark in BOUNDED_WINDOWS), (name, line)
