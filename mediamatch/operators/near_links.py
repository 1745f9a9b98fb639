"""Links between near hashes, for components, without all their pairs.

Components need to know what hangs together, not every pair. Hashes meet on the keys of the same covers as in
the bit-distance join, but a task that holds the hashes of some keys gives back only a star for each set of
them that its pairs connect. So a dense cluster costs comparisons, yet no more links than keyed rows.

Rows reach a task in key order and are held a few groups at a time. A key with more rows than a block is split
into a grid: those that own the key (the key is part of their bits) are dealt to its rows, all to its columns,
so every pair still meets. A key that nobody owns links nothing.

At large distances a key brings much of the table together, and most hashes hang together anyway. Then samples link
first: all hashes are compared with few of them, those outside the largest component with more, and what is still
outside with all. Pairs within the largest component need no comparison, as they are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.operators.blocks import block_pairs, near_places
from mediamatch.operators.components import connected_components
from mediamatch.operators.hamming_join import HOT_BUCKET, Cover, NearBands, self_cover, spread_hashes, task_count
from mediamatch.session import checkpointed

#: Rows whose groups are compared together.
HELD_ROWS = 1 << 16
#: Links kept before they are reduced to stars.
HELD_LINKS = 1 << 20
#: From this many hashes on those of a cover with near bands are linked by samples first; the sizes of the samples.
DENSE_ROWS = 1 << 15
SAMPLES = (1 << 12, 1 << 16)
#: Rows of a block of samples, and rows compared with it at once.
SAMPLE_BLOCK = 1 << 17
STREAMED_AT_ONCE = 16
_KEY = ("part", "key", "row", "column")


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value connected to it) for every value but the smallest ones."""
    values, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def linked(values: np.ndarray, starts: np.ndarray, owners: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links between owners and members; a group is its owners, then its other members."""
    sizes = np.diff(np.r_[starts, len(values)])
    first, own = np.repeat(starts, sizes), np.repeat(owners, sizes)
    rows = np.arange(len(values))
    lefts, rights, n = [values[:0]], [values[:0]], 0
    for rank in range(int(owners.max(initial=0))):
        rows = rows[(own[rows] > rank) & (rows - first[rows] > rank)]
        a, b = values[rows], values[first[rows] + rank]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        if near.any():
            lefts.append(a[near])
            rights.append(b[near])
            n += len(lefts[-1])
            if n > HELD_LINKS:
                a, b = stars(np.concatenate(lefts), np.concatenate(rights))
                lefts, rights, n = [a], [b], 0
    return stars(np.concatenate(lefts), np.concatenate(rights))


def _meet(distance: int):
    def ready(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """The rows of complete groups, and those of the group that may go on."""
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(name).to_numpy() for name in _KEY])
        cut = len(table) if last else int(np.argmax((keys == keys[:, -1:]).all(axis=0)))
        return table.slice(0, cut), table.slice(cut).to_batches()

    def links(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table.column(name).to_numpy() for name in _KEY])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        owners = np.add.reduceat(table.column("owns").to_numpy().astype(np.int64), starts)
        bits = table.column("bits").to_numpy().view(np.uint64)
        pair = linked(bits, starts, owners, distance)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], names=["left_bits", "right_bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                done, held = ready(held, False)
                # What is open is at most one group, so the wait for the next comparison starts anew.
                n = 0
                if len(done):
                    yield links(done)
        if held:
            yield links(ready(held, True)[0])

    return run


class _Held:
    """Hashes of a block; `root` names, for each, one that the links given out so far connect it with."""

    def __init__(self, table: pa.Table):
        self.bits = table.column(0).to_numpy().view(np.uint64)
        self.root = np.arange(len(self.bits))

    def links(self, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """New links that connect `bits` with the block, and hashes of the block through them."""
        i, j, apart = near_places(bits, self.bits, distance)
        other = apart > 0
        i, j = i[other], self.root[j[other]]
        first = np.full(len(bits), len(self.bits))
        np.minimum.at(first, i, j)
        tied = j != first[i]
        if tied.any():
            moved, to = stars(first[i[tied]], j[tied])
            into = np.arange(len(self.root))
            into[moved] = to
            self.root = into[self.root]
            merged = self.bits[moved], self.bits[to]
        else:
            merged = self.bits[:0], self.bits[:0]
        found = np.flatnonzero(first < len(self.bits))
        left, right = np.r_[bits[found], merged[0]], np.r_[self.bits[first[found]], merged[1]]
        return left[left != right], right[left != right]


def _link_to_block(distance: int):
    def match(held: _Held, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits = batch.column(0).to_numpy().view(np.uint64)
        some = range(0, len(bits), STREAMED_AT_ONCE)
        pairs = [held.links(bits[low : low + STREAMED_AT_ONCE], distance) for low in some]
        both = [np.concatenate(side).view(np.int64) for side in zip(*pairs)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["left_bits", "right_bits"])

    return match


def _outside_largest(hashes: DataFrame, links: DataFrame) -> DataFrame:
    """The hashes that are not in the largest component of `links`."""
    labels = checkpointed(connected_components(links))
    largest = labels.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if largest is None:
        return hashes
    inside = labels.where(F.col("component") == largest["component"]).select(F.col("node").alias("bits"))
    return checkpointed(hashes.join(inside, "bits", "left_anti"))


def dense_links(hashes: DataFrame, size: int, distance: int, samples: Sequence[int] = SAMPLES, block: int = SAMPLE_BLOCK) -> DataFrame | None:
    """`near_links` by way of samples; None if the first of them does not link most hashes."""
    links, rest, n = None, hashes, size
    for wanted in [w for w in samples if 2 * w <= size] + [size]:
        if not n:
            break
        step = max(1, size // max(1, wanted))
        # another seed than the one that deals rows to blocks
        held = hashes.where(F.pmod(F.xxhash64("bits", F.lit(wanted)), F.lit(step)) == 0) if step > 1 else hashes
        sizes = n, size // step
        met = block_pairs(rest, held, sizes, _Held, _link_to_block(distance), "left_bits long, right_bits long", block)
        found = checkpointed(met)
        links = found if links is None else links.unionByName(found)
        if wanted < size:
            rest = _outside_largest(hashes, links)
            n = rest.count()
            if wanted == samples[0] and 2 * n > size:
                return None
    return links


def near_links(hashes: DataFrame, distance: int, cover: Cover | None = None, block: int = HOT_BUCKET) -> DataFrame:
    """(left_bits, right_bits): links that connect exactly what all pairs within `distance` bits connect.

    `hashes` holds distinct non-null hashes in a column `bits`. They are counted, so they should be materialised.
    """
    size = hashes.count()
    if cover is None:
        cover = self_cover(hashes, size, distance)
        if size >= DENSE_ROWS and isinstance(cover, NearBands):
            links = dense_links(hashes, size, distance)
            if links is not None:
                return links
    tasks = task_count(hashes, cover.cost(size, size))
    keyed = cover.emit(spread_hashes(hashes, tasks), wide=True).withColumn("owns", cover.owns(F.col("part"), F.col("key"), F.col("bits")))

    def placed(rows: DataFrame, owns: Column, row: Column, column: Column) -> DataFrame:
        at = rows.select("part", "key", row.alias("row"), owns.alias("owns"), "bits", column.alias("column"))
        return at.select(*_KEY, "owns", "bits")

    zero = F.lit(0)
    dealt = placed(keyed, F.col("owns"), zero, zero)
    if size > block:  # a hash has a key at most once, so fewer hashes crowd none
        counts = keyed.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("owns").alias("own_n"))
        crowded = checkpointed(counts.where(F.col("n") > block))
        if not crowded.isEmpty():
            calm = keyed.join(crowded, ["part", "key"], "left_anti")
            hot = keyed.join(crowded.where("own_n > 0"), ["part", "key"])
            rows, columns = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("own_n", "n"))
            own = lambda n: F.pmod(F.xxhash64("bits"), n).cast("int")
            every = lambda n: F.explode(F.sequence(zero, n - 1))
            dealt = (
                placed(calm, F.col("owns"), zero, zero)
                .unionByName(placed(hot.where("owns"), F.lit(True), own(rows), every(columns)))
                .unionByName(placed(hot, F.lit(False), every(rows), own(columns)))
            )
    met = dealt.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, F.desc("owns"), "bits")
    return met.mapInArrow(_meet(distance), "left_bits long, right_bits long")
