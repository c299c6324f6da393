"""Intermediate tables in the shared folder, and batch sizes that long texts cannot blow up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagline.session import shared_path

# Arrow hands a Python worker at most this many bytes at a time (one text may still be longer).
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as by rows, so ten thousand very long texts never meet."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def store(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder and read on from there.

    The lineage ends here: a lost executor costs at most the rows it was working on. Callers
    ``drop`` a table once the next one is written.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).partitionBy(*partition_by or []).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
