"""Duplicate scan and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mediamatch.operators.duplicates import find_duplicates, group_report, live_members
from mediamatch.operators.index import duplicate_rows
from mediamatch.plans.store import IndexStore
from mediamatch.schema import Settings
from mediamatch.sources.results import read_groups, write_groups


def scan(store: IndexStore, results_path: str, settings: Settings = Settings(), version: int | None = None) -> DataFrame:
    """Scan one frozen version of the index, replace the stored result, return it."""
    if version is None:
        version = (store.versions() or [0])[-1]
    write_groups(find_duplicates(duplicate_rows(store.read(version)), settings), results_path)
    return read_groups(store.spark, results_path)


def report(groups: DataFrame, media: DataFrame, settings: Settings = Settings(), view_similarity: float = 0.0) -> DataFrame:
    """One row per group with at least two members that are still attachments."""
    return group_report(live_members(groups, media), settings, view_similarity)
