"""Image fingerprint search and duplicate detection as Spark DataFrame jobs."""

from mediamatch.schema import Settings
from mediamatch.session import build_session, checkpointed

__all__ = ["Settings", "build_session", "checkpointed"]
