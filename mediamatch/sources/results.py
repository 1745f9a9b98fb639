"""Stored result of a duplicate scan."""

from __future__ import annotations

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mediamatch.schema import GROUP_SCHEMA
from mediamatch.session import file_system

#: Spark's names for files that are no Parquet or have lost their footer.
_DAMAGED = ("CANNOT_READ_FILE_FOOTER", "CANNOT_MERGE_SCHEMAS", "UNABLE_TO_INFER_SCHEMA")
STORED_SCHEMA = T.StructType(GROUP_SCHEMA.fields + [T.StructField("scanned_at", T.TimestampType())])


def _scans(spark: SparkSession, path: str) -> list[str]:
    """Folders of complete scans, oldest first."""
    files, pattern = file_system(spark, f"{path}/scan-*/_SUCCESS")
    return sorted(f.getPath().getParent().toString() for f in files.globStatus(pattern) or [])


def write_groups(groups: DataFrame, path: str, scanned_at: datetime | None = None) -> None:
    """Replace the stored result by `groups`, stamped with the time of the scan.

    A scan is a folder of its own that counts once it is complete; only then the older ones go, so a scan that
    fails leaves the last result as it was.
    """
    spark = groups.sparkSession
    old = _scans(spark, path)
    number = int(old[-1].rsplit("-", 1)[1]) + 1 if old else 1
    stamp = F.lit(scanned_at) if scanned_at else F.current_timestamp()
    groups.select("match_type", "group_id", "attachment_id", stamp.cast("timestamp").alias("scanned_at")).write.mode(
        "overwrite"
    ).parquet(f"{path}/scan-{number:08d}")
    for folder in old:
        files, place = file_system(spark, folder)
        files.delete(place, True)


def _footers_fit(spark: SparkSession, folder: str) -> bool:
    """Whether the footers of all files in the folder can be read and hold the stored columns; one job over footers."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(folder).schema
    except (PySparkException, Py4JJavaError) as problem:
        if any(name in str(problem) for name in _DAMAGED):
            return False
        raise
    return all(f.name in found.names and found[f.name].dataType == f.dataType for f in STORED_SCHEMA.fields)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of the newest complete scan; no rows where nothing was stored or where a file is damaged.

    Only footers are looked at. Any other failure, such as a store that does not answer, is raised.
    """
    scans = _scans(spark, path)
    if not scans or not _footers_fit(spark, scans[-1]):
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(scans[-1])


def last_scanned(spark: SparkSession, path: str) -> DataFrame:
    return read_groups(spark, path).agg(F.max("scanned_at").alias("last_scanned"))
