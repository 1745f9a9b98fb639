"""The index table as a DataFrame: building rows, merging, counting, cleaning up.

Operators take an index and return an index; `mediamatch.plans.store` keeps versions on disk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.schema import ALLOWED_MIME, INDEX_DEFAULTS, INDEX_SCHEMA, UNFINGERPRINTABLE, UNSUPPORTED_MIME

KEY = "attachment_id"
FAILED_COLUMNS = ("phash", "color_vector", "edge_vector", "file_hash", "error_code", "indexed_at")


def _stamp(at: datetime | Column | None) -> Column:
    if at is None:
        return F.current_timestamp()
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def conform(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with exactly the index columns, and those of `keep`; what a row does not supply gets its default."""
    given = set(rows.columns)

    def column(field) -> Column:
        if field.name in given:
            value = F.col(field.name)
        elif field.name == "indexed_at":
            value = F.current_timestamp()
        else:
            value = F.lit(INDEX_DEFAULTS[field.name])
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in INDEX_SCHEMA.fields], *keep)


def indexed(index: DataFrame) -> DataFrame:
    return index.where(F.col("error_code") == "")


def failed(index: DataFrame) -> DataFrame:
    return index.where(F.col("error_code") != "")


def comparison_rows(index: DataFrame, newest_first: bool = True) -> DataFrame:
    """Everything a comparison reads; without the order, which sorts all vectors, it is a narrow scan."""
    rows = indexed(index).select(KEY, "phash", "color_vector", "edge_vector", "indexed_at")
    return rows.orderBy(F.desc("indexed_at"), F.asc(KEY)) if newest_first else rows


def duplicate_rows(index: DataFrame) -> DataFrame:
    """The three columns a duplicate scan reads."""
    return indexed(index).select(KEY, "phash", "file_hash")


def build_rows(media: DataFrame, at: datetime | Column | None = None) -> DataFrame:
    """Index rows for fingerprinted media.

    `media` holds attachment_id, mime_type, fingerprint (null where undecodable), width, height,
    file_size, file_hash. A type that is not accepted, or an image without fingerprint, becomes a
    failed row with its error code and blank features; nothing is dropped.
    """
    error = F.when(~F.coalesce(F.col("mime_type"), F.lit("")).isin(*ALLOWED_MIME), UNSUPPORTED_MIME).when(
        F.col("fingerprint").isNull(), UNFINGERPRINTABLE
    )
    ok = F.col("error_code") == ""
    size = lambda c: F.when(ok, F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).otherwise(F.lit(0))
    return conform(
        media.withColumn("error_code", F.coalesce(error, F.lit("")))
        .withColumn("phash", F.when(ok, F.col("fingerprint.phash")).otherwise(F.lit("")))
        .withColumn("color_vector", F.when(ok, F.col("fingerprint.color_vector")))
        .withColumn("edge_vector", F.when(ok, F.col("fingerprint.edge_vector")))
        .withColumn("file_hash", F.when(ok, F.col("file_hash")).otherwise(F.lit("")))
        .withColumn("mime_type", F.when(ok, F.col("mime_type")).otherwise(F.lit("")))
        .withColumn("width", size("width"))
        .withColumn("height", size("height"))
        .withColumn("file_size", size("file_size"))
        .withColumn("indexed_at", _stamp(at))
    )


def unindexed(media: DataFrame, index: DataFrame, allowed: Sequence[str] = (), null_is_id: bool = False) -> DataFrame:
    """Library images without an index row (failed rows count as present), of the listed types or of any image type.

    Images without an id never have a row, unless `null_is_id`.
    """
    kind = F.col("mime_type").isin(*allowed) if allowed else F.col("mime_type").startswith("image/")
    listed = F.col("listed").eqNullSafe(F.col(KEY)) if null_is_id else F.col("listed") == F.col(KEY)
    return media.where((F.col("post_type") == "attachment") & kind).join(index.select(F.col(KEY).alias("listed")), listed, "left_anti")


def library_counts(media: DataFrame, index: DataFrame) -> DataFrame:
    """One row: total images in the library, indexed, failed, pending."""
    total = media.where((F.col("post_type") == "attachment") & F.col("mime_type").startswith("image/")).agg(
        F.count("*").alias("total"), F.lit(0).cast("bigint").alias("indexed"), F.lit(0).cast("bigint").alias("failed")
    )
    states = index.agg(
        F.lit(0).cast("bigint").alias("total"),
        F.count_if(F.col("error_code") == "").alias("indexed"),
        F.count_if(F.col("error_code") != "").alias("failed"),
    )
    # Two one-row aggregates are added up instead of cross joined.
    summed = total.unionByName(states).agg(*[F.sum(c).alias(c) for c in ("total", "indexed", "failed")])
    return summed.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("indexed") - F.col("failed")))


def count_by_mime(media: DataFrame) -> DataFrame:
    """(mime_type, n) over attachments."""
    return media.where(F.col("post_type") == "attachment").groupBy("mime_type").agg(F.count("*").alias("n"))


def latest_per_key(changes: DataFrame, key: str = KEY, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last row per key by `order`.

    A maximum combines before the shuffle, so a key that changes very often sends one row per task.
    """
    newest = F.max_by(F.struct(*changes.columns), F.struct(*order))
    return changes.groupBy(key).agg(newest.alias("last")).select("last.*")


def upsert(
    index: DataFrame, changes: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] = ("indexed_at", "ts", "seq")
) -> DataFrame:
    """Merge `changes` into the index, overwriting only `columns` of existing rows.

    Of several changes of one key the last by `order` counts, as far as `changes` has these columns; of those that are
    equal in it the greatest row. Default columns are those
    that `changes` has. New keys become new rows with defaults for the
    rest. When the changes are small Spark broadcasts them and the index is not shuffled: matching
    keys are taken from a key-only scan of the index, and the rest are inserted.
    """
    rest = [c for c in changes.columns if c != KEY]
    rank = [*(c for c in order if c in rest), *rest]
    changes = changes.groupBy(KEY).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("row")).select(KEY, "row.*")
    supplied = [c for c in (columns or changes.columns) if c != KEY]
    incoming = changes.select(KEY, *[F.col(c).alias("new_" + c) for c in supplied], F.lit(True).alias("changed"))
    merged = index.join(incoming, KEY, "left")
    updated = merged.select(
        *[
            (F.when(F.col("changed"), F.col("new_" + f.name)).otherwise(F.col(f.name)) if f.name in supplied else F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in INDEX_SCHEMA.fields
        ]
    )
    present = index.select(KEY).join(changes.select(KEY), KEY, "left_semi")
    inserted = changes.join(present, KEY, "left_anti")
    return updated.unionByName(conform(inserted))


def merge_built(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Merge built rows, one for each key, in one join.

    A good row replaces all columns; a failed one only those that a failure blanks.
    """
    incoming = conform(rows).select(KEY, *[F.col(f.name).alias("new_" + f.name) for f in INDEX_SCHEMA.fields if f.name != KEY])
    built, good = F.col("new_error_code").isNotNull(), F.col("new_error_code") == ""

    def column(field) -> Column:
        old, new = F.col(field.name), F.col("new_" + field.name)
        if field.name == KEY:
            value = old
        elif field.name in FAILED_COLUMNS:
            value = F.when(built, new).otherwise(old)
        else:
            value = F.when(good, new).when(built, F.coalesce(old, F.lit(INDEX_DEFAULTS[field.name]))).otherwise(old)
        return value.cast(field.dataType).alias(field.name)

    return index.join(incoming, KEY, "full_outer").select(*[column(f) for f in INDEX_SCHEMA.fields])


def mark_failed(index: DataFrame, failures: DataFrame, at: datetime | Column | None = None) -> DataFrame:
    """Blank the features of failed attachments (attachment_id, error_code); type, size and dimensions stay."""
    blank = (
        failures.select(KEY, "error_code")
        .withColumn("phash", F.lit(""))
        .withColumn("color_vector", F.lit(None).cast("array<double>"))
        .withColumn("edge_vector", F.lit(None).cast("array<double>"))
        .withColumn("file_hash", F.lit(""))
        .withColumn("indexed_at", _stamp(at))
    )
    return upsert(index, blank, FAILED_COLUMNS)


def delete_keys(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select(KEY), KEY, "left_anti")


def deleted_count(index: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: how many index rows a delete of `keys` affects; 0 means not found."""
    return index.select(KEY).join(keys.select(KEY), KEY, "left_semi").agg(F.count("*").alias("deleted"))


def _attachments(media: DataFrame) -> DataFrame:
    return media.where(F.col("post_type") == "attachment").select(KEY)


def orphan_count(index: DataFrame, media: DataFrame) -> DataFrame:
    return index.select(KEY).join(_attachments(media), KEY, "left_anti").agg(F.count("*").alias("orphans"))


def delete_orphans(index: DataFrame, media: DataFrame) -> DataFrame:
    """Index rows whose attachment still exists."""
    return index.join(_attachments(media), KEY, "left_semi")


def update_where(rows: DataFrame, predicate: Column | None, values: Mapping[str, object]) -> DataFrame:
    """Set columns on matching rows; refuses to run without a predicate."""
    if predicate is None:
        raise ValueError("an update needs a predicate")
    return rows.withColumns({c: F.when(predicate, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(rows: DataFrame, predicate: Column | None) -> DataFrame:
    """Drop matching rows; rows for which the predicate is unknown stay. Refuses to run without a predicate."""
    if predicate is None:
        raise ValueError("a delete needs a predicate")
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new)


def batch_accounting(rows: DataFrame, batch: str) -> DataFrame:
    """(batch, done, succeeded) per batch of freshly built index rows."""
    return rows.groupBy(batch).agg(
        F.count("*").alias("done"), F.count_if(F.col("error_code") == "").alias("succeeded")
    )


