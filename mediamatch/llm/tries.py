"""Prefix trie of conversations from sorted sequences.

A turn is two 64-bit hashes of its role and text and the text's length; a conversation is the array of its turns. Sorted
range partitions put conversations with a common prefix side by side, so a trie node, a distinct prefix, is an interval
of rows. Blocks of rows are worked on one after another: the lengths of the longest common prefixes (LCPs) of neighbours
go into a sparse table of range minima, and every candidate prefix finds its left and its right extent by a binary
search of its own over that table, without a stack. The parent of a prefix is the same prefix, one turn shorter: its
left extent names the parent node. Sums over a subtree are differences of prefix sums over the interval, since each
row adds to the trie what it doesn't share with the row before.

An interval that reaches the edge of its block goes on in another one. Such prefixes belong to the first or the last row
of a block; their parts are summed by a digest of the prefix, one row for a block. So a conversation that a third of
all others equal is dealt to many tasks. To know LCPs across tasks, the driver reads the first and the last row of each
task.

The ids that end at a node are hashed where the interval lies in one block. For others each block gives its ids as one
text; those are streamed through the hash in order, since SHA-256 can't be merged.

Defined results: rows without conv_id are ignored; a null role or text is empty; turns are ordered with null first, and
equal turn numbers by role and the hashes of role and text, so repeated rows are turns of their own; a conversation
without turns is a member of the root only; an empty table has no node, not even a root; other columns are ignored.
A single conversation's array of turns must fit in a task; texts are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import partitions_of
from mediamatch.session import checkpointed

#: Conversations and turns after which a block ends.
BLOCK_ROWS = 1 << 16
BLOCK_TURNS = 1 << 19
#: Open nodes are broadcast up to this many; beyond it they are joined.
BROADCAST_NODES = 1 << 18
NO_ENDS = hashlib.sha256(b"").hexdigest()
TURN = "struct<high:bigint,low:bigint,chars:bigint>"

#: kind 0: a node; 1: a part of an open node; 2: ids that end at an open node, as text.
_PARTS = (
    "kind byte, digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, shared long, above long, task int, block long, ends string"
)
_NAMES = [field.split()[0] for field in _PARTS.split(", ")]
_TYPES = {"byte": pa.int8(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _PARTS.split(", ")])


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text): each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.xxhash64(role, text).alias("high"),
            F.xxhash64(F.lit("low"), role, text).alias("low"),
            F.length(text).cast("long").alias("chars"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["high"], t["low"], t["chars"])).cast(f"array<{TURN}>").alias("turns"))


class RangeTable:
    """Range minima over an array, by powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels, width = [values], 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum over first..last, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def right_extent(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place such that all values behind `start` up to it are at least `bound`."""
        place = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, values = 1 << k, self.levels[k]
            inside = place + step < len(self.levels[0])
            fits = inside.copy()
            fits[inside] = values[place[inside] + 1] >= bound[inside]
            place[fits] += step
        return place

    def left_extent(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place such that all values behind it up to `start` are at least `bound`."""
        place = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, values = 1 << k, self.levels[k]
            inside = place - step >= 0
            fits = inside.copy()
            fits[inside] = values[place[inside] - step + 1] >= bound[inside]
            place[fits] -= step
        return place


class Rows:
    """Conversations in sorted order: ids, and the hashes and lengths of their turns one after another."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, turns: np.ndarray):
        self.conv, self.sizes, self.turns = conv, sizes, turns  # turns: (high, low, chars) by row
        self.begin = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Rows:
        turns = batch.column("turns")
        if isinstance(turns, pa.ChunkedArray):
            turns = turns.combine_chunks()
        flat = turns.flatten()
        parts = [flat.field(name).to_numpy(zero_copy_only=False) for name in ("high", "low", "chars")]
        sizes = np.diff(turns.offsets.to_numpy())
        return cls(batch.column("conv_id").to_numpy(zero_copy_only=False), sizes.astype(np.int64), np.stack(parts, axis=1).reshape(-1, 3))

    def slice(self, low: int, high: int) -> Rows:
        first = int(self.begin[low]) if low < len(self.conv) else len(self.turns)
        last = int(self.begin[high]) if high < len(self.conv) else len(self.turns)
        return Rows(self.conv[low:high], self.sizes[low:high], self.turns[first:last])

    def join(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate([a, b]) for a, b in ((self.conv, other.conv), (self.sizes, other.sizes), (self.turns, other.turns))))

    def one(self, row: int) -> np.ndarray:
        return self.turns[self.begin[row] : self.begin[row] + self.sizes[row]]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two conversations share from the start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero((a[:n, :2] != b[:n, :2]).any(axis=1))
    return int(apart[0]) if len(apart) else n


def neighbour_lcps(rows: Rows) -> np.ndarray:
    """LCP of each row with the one before it; -1 for the first."""
    out = np.zeros(len(rows.conv), np.int64)
    open_rows = np.arange(1, len(out))
    depth = 0
    while len(open_rows):
        open_rows = open_rows[np.minimum(rows.sizes[open_rows], rows.sizes[open_rows - 1]) > depth]
        a, b = rows.begin[open_rows] + depth, rows.begin[open_rows - 1] + depth
        open_rows = open_rows[(rows.turns[a, 0] == rows.turns[b, 0]) & (rows.turns[a, 1] == rows.turns[b, 1])]
        depth += 1
        out[open_rows] = depth
    if len(out):
        out[0] = -1
    return out


def _prefix_digests(turns: np.ndarray) -> list[bytes]:
    """A digest of each prefix of a conversation, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for turn in np.ascontiguousarray(turns[:, :2]):
        state.update(turn.tobytes())
        out.append(state.copy().digest())
    return out


def block_nodes(rows: Rows, before: np.ndarray | None, after: np.ndarray | None, task: int, block: int) -> pa.RecordBatch:
    """The nodes of a block as rows of `_PARTS`; `before` and `after` are the turns of the rows next to it, if any."""
    n = len(rows.conv)
    lcp = neighbour_lcps(rows)
    entry = -1 if before is None else common(before, rows.one(0))
    leave = -1 if after is None else common(rows.one(n - 1), after)
    true_lcp = np.r_[entry, lcp[1:]]
    chars = np.r_[0, np.cumsum(rows.turns[:, 2])]
    until = lambda row, depth: chars[rows.begin[row] + depth] - chars[rows.begin[row]]
    every = np.arange(n)
    shared = np.r_[0, np.cumsum(np.where(true_lcp > 0, until(every, np.maximum(true_lcp, 0)), 0))]
    leaves = np.r_[0, np.cumsum(np.r_[lcp[1:], leave] < rows.sizes)]
    table, ids = RangeTable(lcp), RangeTable(rows.conv)

    # Each row brings the prefixes longer than what it shares with the row before; the block's first row brings all.
    fresh = rows.sizes - lcp
    base = np.cumsum(fresh) - fresh
    left = np.repeat(every, fresh)
    depth = np.arange(len(left)) - base[left] + lcp[left] + 1
    right = table.right_extent(left, depth)
    holder = table.left_extent(left, depth - 1)  # left extent of the prefix one turn shorter
    parent = base[holder] + depth - 1 - lcp[holder] - 1
    parent[depth == 0] = -1

    came = (left == 0) & (depth <= entry)
    goes = (right == n - 1) & (depth <= leave)
    is_open = came | goes
    n_convs = right - left + 1
    least = ids.least(left, right)
    n_children = np.bincount(parent[(depth > 0) & ~came], minlength=len(left))
    n_leaves = leaves[right + 1] - leaves[left]
    inner = shared[right + 1] - np.where(came, shared[left], shared[left + 1])
    above = until(left, np.maximum(depth - 1, 0))

    # Rows equal to the prefix itself come first in its interval.
    copies = np.r_[False, (lcp[1:] == rows.sizes[1:]) & (lcp[1:] == rows.sizes[:-1])]
    run_end = np.r_[np.flatnonzero(~copies)[1:], n]
    run_of = np.cumsum(~copies) - 1
    ended = np.flatnonzero(rows.sizes[left] == depth)
    texts = [",".join(map(str, rows.conv[i : run_end[run_of[i]]].tolist())) for i in left[ended]]
    ends = np.full(len(left), NO_ENDS, object)
    ends[ended] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    firsts, lasts = _prefix_digests(rows.one(0)), _prefix_digests(rows.one(n - 1))
    digests = np.full(len(left), None, object)
    of_open = np.flatnonzero(is_open)
    digests[of_open] = [(firsts if left[i] == 0 else lasts)[depth[i]] for i in of_open]

    has_parent = depth > 0
    parent_open = has_parent & is_open[parent]
    parents = np.full(len(left), None, object)
    parents[parent_open] = digests[parent[parent_open]]
    parent_conv = pa.array(least[parent], mask=~has_parent | parent_open)

    closed = ~is_open
    spread = ended[is_open[ended]]
    nodes = {
        "kind": is_open.astype(np.int8), "digest": digests, "parent": parents, "conv_id": least, "depth": depth, "parent_conv_id": parent_conv,
        "n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "shared": inner, "above": above, "task": np.full(len(left), task),
        "block": np.full(len(left), block), "ends": pa.array(ends, pa.string(), mask=~closed),
    }
    found = pa.RecordBatch.from_arrays([pa.array(nodes[f.name]).cast(f.type) if not isinstance(nodes[f.name], pa.Array) else nodes[f.name].cast(f.type) for f in _SCHEMA], schema=_SCHEMA)
    if not len(spread):
        return found
    of_spread = {"kind": [2] * len(spread), "digest": list(digests[spread]), "task": [task] * len(spread), "block": [block] * len(spread)}
    of_spread["ends"] = [text for text, is_spread in zip(texts, is_open[ended]) if is_spread]
    chunks = pa.RecordBatch.from_arrays([pa.array(of_spread.get(f.name, [None] * len(spread)), f.type) for f in _SCHEMA], schema=_SCHEMA)
    return pa.Table.from_batches([found, chunks]).combine_chunks().to_batches()[0]


def _walk(batches: Iterator[pa.RecordBatch], neighbours: dict[int, tuple], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted rows; `neighbours` holds the turns around each task."""
    waiting: list[pa.RecordBatch] = []
    held: Rows | None = None
    task, before, block = -1, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if task < 0:
            task = batch.column("task")[0].as_py()
            before = neighbours[task][0]
        waiting.append(batch)
        n_turns = sum(len(b.column("turns").flatten()) for b in waiting)
        if sum(b.num_rows for b in waiting) <= block_rows and n_turns <= BLOCK_TURNS:
            continue
        held = _taken(held, waiting)
        waiting = []
        while len(held.conv) > block_rows or (len(held.turns) > BLOCK_TURNS and len(held.conv) > 1):
            cut = min(block_rows, len(held.conv) - 1, max(1, int(np.searchsorted(held.begin + held.sizes, BLOCK_TURNS, "right"))))
            now, held = held.slice(0, cut), held.slice(cut, len(held.conv))
            yield block_nodes(now, before, held.one(0), task, block)
            before, block = now.one(cut - 1), block + 1
    if waiting:
        held = _taken(held, waiting)
    if held is not None:
        yield block_nodes(held, before, neighbours[task][1], task, block)


def _taken(held: Rows | None, batches: list[pa.RecordBatch]) -> Rows:
    more = Rows.of(pa.Table.from_batches(batches))
    return more if held is None else held.join(more)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of the task."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1)
    if first is not None:
        yield from (first, last)


def _neighbours(rows: DataFrame) -> dict[int, tuple]:
    """For each task with rows, the turns of the row before its first and of the row behind its last."""
    edges = rows.mapInArrow(_edges, rows.schema).toArrow()
    held = Rows.of(edges)
    task = edges.column("task").to_numpy()
    order = np.argsort(task, kind="stable")  # two rows of each task, first and last
    out = {}
    for i in range(0, len(order), 2):
        before = held.one(order[i - 1]) if i else None
        after = held.one(order[i + 2]) if i + 2 < len(order) else None
        out[int(task[order[i]])] = (before, after)
    return out


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts of ids by digest, in order: the hash of all ids of each digest."""
    digest, state = None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    for batch in batches:
        for own, text in zip(batch.column("digest").to_pylist(), batch.column("ends")):
            if own != digest:
                if digest is not None:
                    yield done()
                digest, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_py().encode())
    if digest is not None:
        yield done()


def nodes(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each distinct prefix of
    the rows (conv_id, turns), one row for each conversation."""
    n = partitions_of(conversations)
    order = ("turns", "conv_id")
    dealt = conversations.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = checkpointed(dealt.withColumn("task", F.spark_partition_id()))
    found = checkpointed(rows.mapInArrow(partial(_walk, neighbours=_neighbours(rows), block_rows=block_rows), _PARTS))

    saved = (F.col("shared") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens")
    own = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", saved)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")]
    kept = [F.max(c).alias(c) for c in ("parent", "above", "depth")]
    merged = found.where("kind = 1").groupBy("digest").agg(F.min("conv_id").alias("conv_id"), *kept, *sums)
    chunks = found.where("kind = 2").select("digest", "task", "block", "ends")
    streamed = chunks.repartition(n, "digest").sortWithinPartitions("digest", "task", "block")
    ends = streamed.mapInArrow(_hash_ends, "digest binary, ends_sha256 string")
    open_nodes = checkpointed(
        merged.join(ends, "digest", "left").select("digest", "parent", *own, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    )

    closed = found.where("kind = 0").select("parent", "parent_conv_id", *own, F.col("ends").alias("ends_sha256"))
    every = closed.unionByName(open_nodes.drop("digest"), allowMissingColumns=True)
    parents = open_nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("open_conv_id"))
    if open_nodes.count() <= BROADCAST_NODES:
        parents = F.broadcast(parents)
    asking = every.where(F.col("parent").isNotNull()).join(parents, "parent").withColumn("parent_conv_id", F.col("open_conv_id"))
    known = every.where(F.col("parent").isNull())
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return known.select(*names).unionByName(asking.select(*names))
