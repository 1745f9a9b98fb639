"""Image files as tables.

Pixels come from Spark's image source, sizes and digests from its binary source. Both are narrow
scans; pixel data never goes through a shuffle, only the small per-file rows are joined by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediamatch.functions.paths import basename, mime_from_name
from mediamatch.schema import ALLOWED_MIME, MAX_PROBE_BYTES, MAX_PROBE_PIXELS


def _same_path(path: Column) -> Column:
    """One spelling for file URIs: the two sources differ in the number of slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, width, height, n_channels, data) per file; a file that cannot be decoded has width -1."""
    reader = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        _same_path(F.col("image.origin")).alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def file_facts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, filename, mime_type, file_size, file_hash) per file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        _same_path(F.col("path")).alias("path"),
        basename("path").alias("filename"),
        mime_from_name("path").alias("mime_type"),
        F.col("length").alias("file_size"),
        F.md5("content").alias("file_hash"),
    )


def admit_probes(
    probes: DataFrame,
    size: str = "file_size",
    width: str = "width",
    height: str = "height",
    mime: str = "mime_type",
) -> DataFrame:
    """Add `reject_reason`: null for an admitted probe, else the first bound it breaks."""
    pixels = F.col(width).cast("bigint") * F.col(height).cast("bigint")
    return probes.withColumn(
        "reject_reason",
        F.when(F.col(size) > MAX_PROBE_BYTES, "too_many_bytes")
        .when(~F.coalesce(F.col(mime), F.lit("")).isin(*ALLOWED_MIME), "unsupported_mime")
        .when((F.col(width) <= 0) | (F.col(height) <= 0) | pixels.isNull(), "undecodable")
        .when(pixels > MAX_PROBE_PIXELS, "too_many_pixels"),
    )
