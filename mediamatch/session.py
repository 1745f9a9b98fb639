"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "mediamatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume.

    The shuffle partition count is an upper bound that adaptive execution coalesces, so a
    cluster sets it high; only tests set it low.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Decoded images are large rows: bound what one Arrow batch holds.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "mediamatch")
    archive = shutil.make_archive(target, "zip", root_dir=os.path.dirname(home), base_dir=os.path.basename(home))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; a scratch folder in local mode only."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh folder on shared storage, removed at the end; results that outlive it are checkpointed."""
    place = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"
    try:
        yield place
    finally:
        files, path = file_system(spark, place)
        files.delete(path, True)
