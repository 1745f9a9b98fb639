"""Display values: row status, sizes, percentages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediamatch.schema import UNFINGERPRINTABLE, UNSUPPORTED_MIME


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_status(error_code: Column | str, phash: Column | str) -> Column:
    error, phash = F.coalesce(_col(error_code), F.lit("")), F.coalesce(_col(phash), F.lit(""))
    return F.when(error != "", "failed").when(phash != "", "indexed").otherwise("pending")


def error_label(error_code: Column | str) -> Column:
    code = _col(error_code)
    return (
        F.when(code == UNSUPPORTED_MIME, "Unsupported format")
        .when(code == UNFINGERPRINTABLE, "Corrupt / unreadable")
        .when(F.coalesce(code, F.lit("")) != "", "Failed")
    )


def human_bytes(size: Column | str) -> Column:
    """Bytes as B, KB or MB on a base of 1024, one decimal above bytes."""
    size = _col(size)
    tenths = lambda unit: F.format_string("%.1f", F.round(size / F.lit(float(unit)), 1))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(tenths(1024), F.lit(" KB")))
        .otherwise(F.concat(tenths(1024 * 1024), F.lit(" MB")))
    )


def ratio_to_percent(ratio: Column | str) -> Column:
    return F.round(_col(ratio) * 100).cast("int")


def percent_to_ratio(percent: Column | str) -> Column:
    return F.round(_col(percent) / F.lit(100.0), 3)
