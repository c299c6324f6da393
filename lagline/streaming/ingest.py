"""Continuous file ingest, plain or with a manifest that makes batches repeatable and small files few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def ingest_by_hour(source: DataFrame, time: str, out: str, checkpoint: str, files_per_hour: int = 4) -> StreamingQuery:
    """Drain all files present into parquet partitioned by ``hour`` (yyyy-MM-dd-HH of the event time).

    The checkpoint folder records which files are done, so a restart neither loses nor repeats rows.
    Rows are dealt by hour and a salt, so a batch writes at most ``files_per_hour`` files for an hour, however many tasks read it, and a
    busy hour is still written by several tasks.
    """
    salt = F.pmod(F.xxhash64(F.col(time)), F.lit(files_per_hour))
    hourly = source.withColumn("hour", F.date_format(F.col(time), "yyyy-MM-dd-HH")).repartition(F.col("hour"), salt)
    return (
        hourly.writeStream.format("parquet")
        .partitionBy("hour")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


_MANIFEST = "period string, piece string, files int"


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """The folder as the file system's path, and that file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the committed manifests, in order; a manifest without its success mark does not count."""
    place, files = _files(spark, f"{out}/manifest")
    if not files.exists(place):
        return []
    found = [f.getPath() for f in files.listStatus(place)]
    done = [f.getName() for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(name.removeprefix("batch=")) for name in done if name.startswith("batch="))


def _pieces(spark: SparkSession, out: str, version: int | None) -> dict[str, list[tuple[str, int]]]:
    """period -> its pieces (name, files) under a manifest; one row per period and piece, never data."""
    pieces: dict[str, list[tuple[str, int]]] = {}
    if version is not None:
        for row in spark.read.schema(_MANIFEST).json(f"{out}/manifest/batch={version}").collect():
            pieces.setdefault(row.period, []).append((row.piece, row.files))
    return pieces


def read_ingested(spark: SparkSession, out: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches, with ``period``; what an unfinished batch or compaction has written is not seen.

    The manifest is a small table of (piece, period), which are partition columns, so Spark prunes the files by it.
    """
    columns = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([*columns.fields, T.StructField("piece", T.StringType()), T.StructField("period", T.StringType())])
    versions = _versions(spark, out)
    if not versions:
        return spark.createDataFrame([], full).drop("piece")
    listed = spark.read.schema(_MANIFEST).json(f"{out}/manifest/batch={versions[-1]}").select("piece", "period")
    return spark.read.schema(full).parquet(f"{out}/data").join(listed, ["piece", "period"], "left_semi").drop("piece")


def ingest_compacted(
    source: DataFrame, time: str, out: str, checkpoint: str, files_per_period: int = 4, most_files: int = 16, pattern: str = "yyyy-MM-dd-HH",
) -> StreamingQuery:
    """Drain all files present into ``out``, by period of the event time (``pattern`` as in ``date_format``, hours by default), so that any number of batches leaves few files; read with ``read_ingested``.

    A batch writes its rows as a piece of its own, overwriting what an earlier attempt left, and then a manifest of all pieces under the batch's
    number. The manifest's success mark is the commit: a batch that failed is replayed by the stream under the same number and neither
    loses nor repeats rows, and a batch that was committed before the stream noted it is skipped. Where a batch brings a period above
    ``most_files`` files, the period's pieces are merged into ``files_per_period`` files before the commit, open periods and late rows included.
    Pieces merged away are deleted one commit later, so readers of the previous manifest can end. Rows without a time are kept
    under the period ``none``. Several writers into one folder are not meant.
    """
    spark = source.sparkSession
    shape = source.schema
    if {"period", "piece"} & {c.lower() for c in shape.names}:
        raise ValueError("ingest_compacted: the columns period and piece are its own")

    def dealt(rows: DataFrame) -> DataFrame:
        # Whole rows decide the salt, so equal times do not gather in one file.
        return rows.repartition(F.col("period"), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in shape.names)), F.lit(files_per_period)))

    def commit(batch: DataFrame, number: int) -> None:
        versions = _versions(spark, out)
        if number in versions:
            return
        before = [v for v in versions if v < number]
        pieces = _pieces(spark, out, before[-1] if before else None)
        period = F.coalesce(F.date_format(F.col(time), pattern), F.lit("none"))
        name = f"batch-{number}"
        dealt(batch.withColumn("period", period)).write.mode("overwrite").partitionBy("period").parquet(f"{out}/data/piece={name}")
        for h, n in _written(spark, f"{out}/data/piece={name}").items():
            pieces.setdefault(h, []).append((name, n))
        full = {h: old for h, old in pieces.items() if len(old) > 1 and sum(n for _, n in old) > most_files}
        if full:
            merged = f"merged-{number}"
            gone = spark.createDataFrame([(p, h) for h, old in full.items() for p, _ in old], "piece string, period string")
            every = T.StructType([*shape.fields, T.StructField("piece", T.StringType()), T.StructField("period", T.StringType())])
            rows = spark.read.schema(every).parquet(f"{out}/data").join(gone, ["piece", "period"], "left_semi").drop("piece")
            dealt(rows).write.mode("overwrite").partitionBy("period").parquet(f"{out}/data/piece={merged}")
            made = _written(spark, f"{out}/data/piece={merged}")
            pieces |= {h: [(merged, made[h])] for h in full}
        listed = spark.createDataFrame([(h, p, n) for h, held in pieces.items() for p, n in held], _MANIFEST)
        listed.coalesce(1).write.mode("overwrite").json(f"{out}/manifest/batch={number}")
        _sweep(spark, out, before)

    return source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, piece: str) -> dict[str, int]:
    """period -> number of files of a piece."""
    place, files = _files(spark, piece)
    periods = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("period=")]
    return {h.getName().removeprefix("period="): sum(f.getPath().getName().endswith(".parquet") for f in files.listStatus(h)) for h in periods}


def _sweep(spark: SparkSession, out: str, committed: list[int]) -> None:
    """Delete the manifests before the last of ``committed``, and first the pieces that only they name."""
    if len(committed) < 2:
        return
    kept = {(p, h) for h, held in _pieces(spark, out, committed[-1]).items() for p, _ in held}
    for version in committed[:-1]:
        gone = [f"data/piece={p}/period={h}" for h, held in _pieces(spark, out, version).items() for p, _ in held if (p, h) not in kept]
        for path in [*gone, f"manifest/batch={version}"]:
            place, files = _files(spark, f"{out}/{path}")
            files.delete(place, True)


def hourly_counts(df: DataFrame, hour: str = "hour") -> DataFrame:
    """(hour, n) of ingested rows."""
    return df.groupBy(hour).agg(F.count(F.lit(1)).alias("n"))
