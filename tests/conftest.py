import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mediamatch import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session
    session.stop()


def pairs_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def sets_of_groups(groups):
    """{(match_type, frozenset of members)} of long-form groups."""
    out = {}
    for r in groups.collect():
        out.setdefault((r["match_type"], r["group_id"]), set()).add(r["attachment_id"])
    return {(kind, frozenset(members)) for (kind, _), members in out.items()}
