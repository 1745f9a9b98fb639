"""Table schemas and operator parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import types as T

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("attachment_id", T.LongType()),
        T.StructField("phash", T.StringType()),
        T.StructField("color_vector", T.ArrayType(T.DoubleType())),
        T.StructField("edge_vector", T.ArrayType(T.DoubleType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)

# Values a column takes when a new index row does not supply it.
INDEX_DEFAULTS = {
    "phash": "",
    "color_vector": None,
    "edge_vector": None,
    "width": 0,
    "height": 0,
    "mime_type": "",
    "file_size": 0,
    "file_hash": "",
    "error_code": "",
}

MEDIA_SCHEMA = T.StructType(
    [
        T.StructField("attachment_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("post_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("parent_id", T.LongType()),
    ]
)

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("attachment_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("is_probe", T.BooleanType()),
    ]
)

GROUP_SCHEMA = T.StructType(
    [
        T.StructField("match_type", T.StringType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("attachment_id", T.LongType()),
    ]
)

# The accepted image types and the extensions they are known by.
ALLOWED_MIME = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp")
EXTENSION_MIME = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpe": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
}

# Probe bounds, working size, search and paging limits.
MAX_PROBE_BYTES = 10_485_760
MAX_PROBE_PIXELS = 16_777_216
MAX_WORKING_EDGE = 512
SEARCH_HAMMING_CAP = 20
SEARCH_LIMIT_DEFAULT = 20
WIDGET_LIMIT_DEFAULT = 12
WIDGET_LIMIT_MAX = 48
TITLE_MATCH_LIMIT = 500
ID_PAGE_SIZE = 200
ROW_PAGE_MAX = 200
RATE_WINDOW_SECONDS = 60
HASH_BITS = 64

UNSUPPORTED_MIME = "unsupported_mime"
UNFINGERPRINTABLE = "unfingerprintable"


def clamp(value, low, high):
    return max(low, min(high, value))


@dataclass(frozen=True)
class Settings:
    """Operator parameters; every instance holds values inside the legal ranges."""

    search_visibility: str = "anyone"
    rate_limit: int = 10
    match_threshold: float = 0.85
    batch_size: int = 25
    downscale_max: int = 1024
    duplicate_threshold: float = 0.95
    drop_on_uninstall: bool = True

    def __post_init__(self) -> None:
        visible = self.search_visibility if self.search_visibility in ("anyone", "logged_in") else "anyone"
        legal = {
            "search_visibility": visible,
            "rate_limit": clamp(int(self.rate_limit), 1, 60),
            "match_threshold": clamp(float(self.match_threshold), 0.5, 1.0),
            "batch_size": clamp(int(self.batch_size), 5, 200),
            "downscale_max": clamp(int(self.downscale_max), 256, 4096),
            "duplicate_threshold": clamp(float(self.duplicate_threshold), 0.8, 1.0),
            "drop_on_uninstall": bool(self.drop_on_uninstall),
        }
        for name, value in legal.items():
            object.__setattr__(self, name, value)

    @classmethod
    def from_mapping(cls, given: Mapping[str, object]) -> "Settings":
        """Take the known keys, drop the others, default what is missing."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @property
    def duplicate_hamming_cap(self) -> int:
        return similarity_to_hamming(self.duplicate_threshold)


def similarity_to_hamming(similarity: float) -> int:
    """Largest bit distance that a similarity floor allows: .95 -> 3, .80 -> 13."""
    return int((1.0 - similarity) * HASH_BITS + 0.5)
