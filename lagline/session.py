"""Session set-up and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

# Rows up to which a fit's scan is over before an even layout would pay.
_FEW_ROWS = 100_000


def build_session(app_name: str = "lagline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    UTC keeps event times comparable between engines, adaptive execution coalesces small shuffle
    partitions and splits skewed join partitions at run time. Sizes (shuffle partitions, split
    bytes, memory) belong to the cluster, so they are only taken from ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the one the cluster names when there is one.

    A private temporary folder is made only where nothing is configured and Spark runs in one
    process, as in tests. On a cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lagline-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder, which every executor can reach; deleted when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lagline/{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read on from there.

    For inputs that are scanned many times, such as the training rows of an iterative fit: the
    lineage is cut, the rows survive lost executors, and later scans read only the columns they need.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_even(df: DataFrame, name: str = "rows", near: Sequence[str | Column] = ()) -> DataFrame:
    """``materialize`` with the rows dealt evenly over the cores, for fits: every scan of theirs lasts as long as its largest part.

    Parts that come out of a filter or of coalesced shuffles differ in size and need not be as many as the cores. Rows of a part are sorted
    by ``near``: a fit of trees is faster when rows that go the same way down the trees follow each other. Few rows stay as they lie.
    """
    if df.count() > _FEW_ROWS:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
        if near:
            df = df.sortWithinPartitions(*near)
    return materialize(df, name)
