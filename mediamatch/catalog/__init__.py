from mediamatch.catalog import duplicates, features, index, relational, search, streams  # noqa: F401  (registration)
from mediamatch.catalog.registry import ENTRIES, Entry

__all__ = ["ENTRIES", "Entry"]
