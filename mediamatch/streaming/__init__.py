from mediamatch.streaming.changes import ChangeStream, Stalled, apply_changes
from mediamatch.streaming.rate_limit import limit_requests, limit_stream

__all__ = ["ChangeStream", "Stalled", "apply_changes", "limit_requests", "limit_stream"]
