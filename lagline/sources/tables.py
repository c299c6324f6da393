"""Scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan of one or more paths or globs, with the given schema when there is one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def read_parquet_before(
    spark: SparkSession, glob: str, date_col: str, before: object, schema: T.StructType | str | None = None
) -> DataFrame:
    """All files of ``glob`` restricted to rows dated before ``before``; the filter reaches the scan."""
    return read_parquet(spark, glob, schema=schema).filter(F.col(date_col) < F.lit(before))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``sinks.write_bucketed`` with its layout, which Spark then uses instead of a shuffle."""
    layout = spark.read.schema("keys array<string>, buckets int, sort_by array<string>, columns string").json(f"{path}.layout").first()
    quoted = lambda names: ", ".join("`" + n.replace("`", "``") + "`" for n in names)
    name = f"lagline_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({layout.columns}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY ({quoted(layout['keys'])}) SORTED BY ({quoted(layout.sort_by)}) INTO {layout.buckets} BUCKETS")
    return spark.table(name)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = False
) -> DataFrame:
    """CSV with a header line.

    With ``schema`` the columns are typed while reading, with ``infer`` Spark makes an extra pass
    to guess the types, otherwise every column stays a string.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def rows_to_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small result table (metrics, tracker lines) from in-memory rows."""
    return spark.createDataFrame(rows, schema)


def read_votes(spark: SparkSession, path: str, min_votes: int | None = None) -> DataFrame:
    """Feature votes as (feature, votes), optionally only those with enough votes."""
    votes = spark.read.schema("feature string, votes int").json(path)
    return votes if min_votes is None else votes.filter(F.col("votes") >= min_votes)


def read_votes_object(spark: SparkSession, path: str) -> DataFrame:
    """(feature, votes) from files holding one JSON object ``{"feature": votes, ...}`` each."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.from_json("value", "map<string,int>").alias("votes"))
    return parsed.select(F.explode("votes").alias("feature", "votes"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, feature) from a one-line comma separated list of names."""
    line = spark.read.text(path)
    names = line.select(F.posexplode(F.split("value", ",")).alias("position", "feature"))
    return names.withColumn("feature", F.trim("feature")).filter(F.col("feature") != "")


def split_text_lines(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines of text as arrays of fields."""
    return spark.read.text(path).select(F.split("value", sep).alias("fields"))


def prune(df: DataFrame, keep: list[str], where: Column | None = None) -> DataFrame:
    """Rows and columns needed later; both reach the scan."""
    narrowed = df if where is None else df.filter(where)
    return narrowed.select(*keep)
