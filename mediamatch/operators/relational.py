"""Query helpers whose rules differ from plain Spark.

Projection, comparison, BETWEEN, joins, grouping and HAVING are the DataFrame API itself. The
helpers here keep the cases that would surprise: empty lists, empty OR groups, bounds of paging.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.functions.paths import basename
from mediamatch.schema import ID_PAGE_SIZE, ROW_PAGE_MAX, TITLE_MATCH_LIMIT, clamp


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with a listed value; an empty list filters nothing."""
    return df.where(F.col(column).isin(*values)) if values else df


def where_not_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(~F.col(column).isin(*values)) if values else df


def where_any(df: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    """Rows that meet at least one predicate; an empty list filters nothing."""
    return df.where(reduce(Column.__or__, predicates)) if predicates else df


def where_raw(df: DataFrame, predicate: str, **binds) -> DataFrame:
    """SQL predicate with named binds, e.g. where_raw(df, "a > :low", low=3)."""
    return df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {predicate}", args=binds, rows=df)


def where_date_range(df: DataFrame, column: str, start: int, end: int, inclusive: bool = True) -> DataFrame:
    """Rows between two epoch seconds (UTC); both ends included or both excluded."""
    low, high = (F.timestamp_seconds(F.lit(v)).cast(df.schema[column].dataType) for v in (start, end))
    c = F.col(column)
    return df.where((c >= low) & (c <= high)) if inclusive else df.where((c > low) & (c < high))


def order_by(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Order by (column, direction); any direction but DESC is ascending."""
    return df.orderBy(*[F.desc(c) if d.upper() == "DESC" else F.asc(c) for c, d in keys])


def limit_offset(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(max(0, offset)).limit(max(0, limit))


def paginate(df: DataFrame, page: int, per_page: int) -> DataFrame:
    size = max(1, per_page)
    return limit_offset(df, size, (max(1, page) - 1) * size)


def rows_page(rows: DataFrame, after_id: int = 0, per_page: int = 25, only: DataFrame | None = None) -> DataFrame:
    """Next page of index rows, newest id first, below `after_id` where given.

    `only` restricts the rows to matched ids (attachment_id). The key is a plain column bound, so it
    reaches the Parquet scan, and the page is a top-n without a global sort.
    """
    if after_id > 0:
        rows = rows.where(F.col("attachment_id") < after_id)
    if only is not None:
        rows = rows.join(only, "attachment_id", "left_semi")
    return rows.orderBy(F.desc("attachment_id")).limit(clamp(per_page, 1, ROW_PAGE_MAX))


def is_library_image() -> Column:
    """Attachments of any image type that inherit their status."""
    return (F.col("post_type") == "attachment") & F.col("mime_type").startswith("image/") & (F.col("status") == "inherit")


def ids_page(media: DataFrame, after_id: int = 0, limit: int = ID_PAGE_SIZE) -> DataFrame:
    """Next page of image ids in ascending order."""
    images = media.where(is_library_image())
    if after_id > 0:
        images = images.where(F.col("attachment_id") > after_id)
    return images.select("attachment_id").orderBy("attachment_id").limit(limit)


def all_image_ids(media: DataFrame) -> DataFrame:
    return media.where(is_library_image()).select("attachment_id")


def search_titles(media: DataFrame, term: str, limit: int = TITLE_MATCH_LIMIT) -> DataFrame:
    """Ids whose title contains the term, then ids whose file path does; no id twice, at most `limit`.

    Title hits come before file hits, newest id first inside each. An empty term matches every
    title and no file.
    """
    needle = F.lower(F.lit(term))
    live = media.where((F.col("post_type") == "attachment") & (F.col("status") == "inherit"))
    in_title = F.lower("title").contains(needle)
    in_file = F.lower("filename").contains(needle) if term else F.lit(False)
    source = F.when(in_title, 0).when(in_file, 1)
    return (
        live.select("attachment_id", source.alias("source"))
        .where(F.col("source").isNotNull())
        .orderBy("source", F.desc("attachment_id"))
        .limit(max(0, limit))
    )


def hydrate_rows(rows: DataFrame, media: DataFrame) -> DataFrame:
    """Add title and file name to a page of index rows."""
    shown = media.select("attachment_id", "title", basename("filename").alias("filename"))
    return (
        rows.join(shown, "attachment_id", "left")
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("filename", F.coalesce("filename", F.lit("")))
    )
