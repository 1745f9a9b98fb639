import hashlib
import random
import zlib

import numpy as np
import pytest

from mediamatch.llm import queries, tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, parent string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA)


def conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in out.items()}


def rebuilt(convs):
    out = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = convs.get(conv - conv % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(own), len(prefix), parent, len(own), len(children), len(leaves), saved, sha))
    return sorted(out, key=repr)


def as_rows(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def made(seed, n, words=3, most=5):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(n * 2), n):
        rows += [(conv, t, ("user", "assistant")[t % 2], "é" * rng.randint(1, words)) for t in range(rng.randint(1, most))]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_extents(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-1, 5, 60 + seed)
    table = tries.RangeTable(values)
    start = np.repeat(np.arange(len(values)), 6)
    bound = np.tile(np.arange(6), len(values))
    right, left = table.right_extent(start, bound), table.left_extent(start, bound)
    for s, b, r, le in zip(start, bound, right, left):
        want = s
        while want + 1 < len(values) and values[want + 1] >= b:
            want += 1
        assert r == want
        want = s
        while want > 0 and values[want] >= b:
            want -= 1
        assert le == want
    last = np.minimum(start + bound * 7, len(values) - 1)
    assert table.least(start, last).tolist() == [values[a : b + 1].min() for a, b in zip(start, last)]


@pytest.mark.parametrize("seed,block", ((1, 1), (2, 3), (3, 16), (4, 1 << 16)))
def test_nodes_equal_brute_force(spark, seed, block):
    rows = made(seed, 90)
    got = tries.nodes(tries.sequences(table(spark, rows).repartition(5)), block)
    assert as_rows(got) == brute(conversations(rows))


def test_rebuilt_conversations(spark):
    rows = made(7, 150)
    got = tries.nodes(queries.rebuilt(tries.sequences(table(spark, rows))), 20)
    assert as_rows(got) == brute(rebuilt(conversations(rows)))


def test_a_conversation_that_most_equal(spark):
    same = [("user", "hello"), ("assistant", "how are you"), ("user", "")]
    rows = [(c, t, role, text) for c in range(400) for t, (role, text) in enumerate(same)]
    rows += [(1000 + c, t, role, text if t < 2 else f"{c % 7}") for c in range(60) for t, (role, text) in enumerate(same)]
    rows += made(9, 40)[:100]
    rows = [r for r in rows if r[0] >= 100 or r[3] in ("hello", "how are you", "")]
    for block in (13, 1 << 16):
        got = tries.nodes(tries.sequences(table(spark, rows).repartition(6)), block)
        assert as_rows(got) == brute(conversations(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "", ""), (2, 0, "user", "a"),
        (-5, 3, "user", "x" * 5000), (-5, 3, "system", "b"), (7, 1, "ab", "c"), (8, 1, "a", "bc"), (9, None, None, "z"), (100, 0, None, None),
    ]
    rows += [(50, t, "user", str(t % 3)) for t in range(700)] + [(51, t, "user", str(t % 3)) for t in range(650)]
    for block in (1, 1 << 16):
        assert as_rows(tries.nodes(tries.sequences(table(spark, rows)), block)) == brute(conversations(rows))


def test_no_turns_and_empty_table(spark):
    assert as_rows(tries.nodes(tries.sequences(table(spark, [])))) == []
    none = spark.createDataFrame([(4, []), (2, [])], f"conv_id long, turns array<{tries.TURN}>")
    ends = hashlib.sha256(b"2,4").hexdigest()
    assert as_rows(tries.nodes(none)) == [(2, 0, None, 2, 0, 1, 0, ends)]


def test_ties_of_turn_numbers_have_one_order(spark):
    rows = [(c, 0, "user", t) for c in (1, 2) for t in (("x", "y") if c == 1 else ("y", "x"))]
    got = {r["conv_id"]: r["turns"] for r in tries.sequences(table(spark, rows)).collect()}
    assert got[1] == got[2]
