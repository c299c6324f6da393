"""Sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet sink; ``partition_by`` turns later filters on those columns into partition pruning.

    Rows are first dealt by the partition's values, so files do not multiply with the tasks that wrote them; adaptive execution joins
    small values and splits a large one over several tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, sort_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet files bucketed by a hash of ``keys``, so joins and aggregates on them need no shuffle; read with ``tables.read_bucketed``.

    The rows are dealt by the bucket's own hash first: one file per bucket, however many tasks made the rows. Within a bucket they are sorted by
    ``sort_by`` (by the keys if not given), so filters on those columns skip row groups. Tables that are to be joined need the same
    keys and number of buckets. Meant for keys with many values, such as ids: all rows of one key share a file and a task. The layout is kept
    beside the files, in ``<path>.layout``, for sessions that do not share a catalog.
    """
    spark, name = df.sparkSession, f"lagline_{uuid.uuid4().hex}"
    order = list(sort_by) or list(keys)
    writer = df.repartition(buckets, *keys).write.format("parquet").mode(mode).option("path", path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "errorifexists" and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise ValueError(f"write_bucketed: {path} already exists")
    writer.bucketBy(buckets, keys[0], *keys[1:]).sortBy(order[0], *order[1:]).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    spark.createDataFrame([(list(keys), buckets, order, df.schema.toDDL())], "keys array<string>, buckets int, sort_by array<string>, columns string").coalesce(1).write.mode("overwrite").json(f"{path}.layout")


def write_metric_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metric table (one row per cutoff) as a single CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_votes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature votes as JSON lines; the row count is the number of features, not of data rows."""
    df.coalesce(1).write.mode(mode).json(path)


def write_text_fields(df: DataFrame, path: str, fields: str = "fields", sep: str = "\t", mode: str = "errorifexists") -> None:
    """Arrays of fields as lines of text."""
    df.select(F.concat_ws(sep, fields).alias("value")).write.mode(mode).text(path)
