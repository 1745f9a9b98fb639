"""All pairs of two tables, block by block.

Where a bit distance lets a fixed share of all pairs through, join keys do not pay: what they bring together must be
moved, compared several times, and moved again. Here the tables are dealt to a grid instead. A task holds a block of
one table, the rows of the other stream past it, and only results leave the task. So memory is bounded by a block,
what is moved by the rows of both tables times the sides of the grid, and the sides follow the number of cores.

Wide rows need not move at all: `packed` writes them once, many to a piece, and `met_pieces` lets tasks read the pieces
they compare, as often as they need them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.session import checkpointed

#: Rows of a held block, at most about.
HELD_ROWS = 1 << 16
#: Pairs that are worth a task, up to a few tasks a core.
PAIRS_PER_TASK = 1 << 29
TASKS_PER_CORE = 2
#: Rows of a piece, and pieces that a partition may hold before its rows are dealt out again.
PIECE_ROWS = 1 << 13
PIECES_TOGETHER = 8
#: Distances taken at once, few enough to stay in a core's cache.
DISTANCES_AT_ONCE = 1 << 17


def true_places(mask: np.ndarray) -> np.ndarray:
    """Places of the true values; eight at a time are passed over, as few are true."""
    whole = len(mask) // 8 * 8
    words = np.flatnonzero(mask[:whole].view(np.uint64))
    at = np.flatnonzero(mask[:whole].reshape(-1, 8)[words].ravel())
    return np.concatenate([words[at >> 3] * 8 + (at & 7), whole + np.flatnonzero(mask[whole:])])


def near_places(bits: np.ndarray, held: np.ndarray, distance: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in `bits`, place in `held`, differing bits) of the pairs within `distance`, in order; both are unsigned.

    `distance` is one for all, or one for each of `bits`.
    """
    rows = max(1, min(len(bits), DISTANCES_AT_ONCE // max(1, len(held))))
    most = np.broadcast_to(np.asarray(distance).astype(np.uint8), len(bits))[:, None]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    differing, counts = (np.empty((rows, len(held)), kind) for kind in (np.uint64, np.uint8))
    for low in range(0, len(bits) if len(held) else 0, rows):
        n = min(rows, len(bits) - low)
        np.bitwise_xor(bits[low : low + rows, None], held[None, :], out=differing[:n])
        apart = np.bitwise_count(differing[:n], out=counts[:n])
        at = true_places((apart <= most[low : low + rows]).ravel())
        i = at // len(held)
        found.append((low + i, at - i * len(held), apart.ravel()[at]))
    i, j, apart = (np.concatenate(column) for column in zip(*found))
    return i, j, apart


def sides(streamed: int, held: int, cores: int, block: int = HELD_ROWS) -> tuple[int, int]:
    """(parts of the streamed table, blocks of the held one): few rows moved, enough tasks, no block too large."""
    tasks = max(1, min(math.ceil(streamed * held / PAIRS_PER_TASK), TASKS_PER_CORE * cores))
    even = round(math.sqrt(tasks * held / max(1, streamed)))
    blocks = max(1, math.ceil(held / block), min(even, tasks))
    return max(1, math.ceil(tasks / blocks)), blocks


def _met(prepare: Callable[[pa.Table], object], match: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: int | None = None
        waiting: list[pa.RecordBatch] = []
        block: object = None
        for batch in batches:
            cells = batch.column(0).to_numpy()
            streams = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                # rows of one cell and one side
                end = at + 1
                same = (cells[at:] == cells[at]) & (streams[at:] == streams[at])
                end = at + (int(same.argmin()) if not same.all() else len(same))
                if cells[at] != cell:
                    cell, waiting, block = int(cells[at]), [], None
                piece = batch.slice(at, end - at)
                if not streams[at]:
                    waiting.append(pa.RecordBatch.from_struct_array(piece.column(2)))
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = prepare(pa.Table.from_batches(waiting).combine_chunks()), []
                    yield from match(block, pa.RecordBatch.from_struct_array(piece.column(3)))
                at = end

    return run


def block_pairs(
    streamed: DataFrame,
    held: DataFrame,
    sizes: tuple[int, int],
    prepare: Callable[[pa.Table], object],
    match: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
    block: int = HELD_ROWS,
) -> DataFrame:
    """What `match(prepare(block of held), batch of streamed)` gives, for every row of `streamed` with every row of `held`.

    Rows are dealt by the first column of each table, its id; `sizes` are the numbers of rows.
    """
    cores = streamed.sparkSession.sparkContext.defaultParallelism
    parts, blocks = sides(*sizes, cores, block)
    own = lambda rows, n: F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pack = lambda rows: F.struct(*rows.columns)

    def placed(rows: DataFrame, part: Column, column: Column, streams: bool) -> DataFrame:
        at = rows.select(pack(rows).alias("row"), part.alias("part"), column.alias("column"))
        cell = (F.col("part") * blocks + F.col("column")).alias("cell")
        none = lambda other: F.lit(None).cast(other.select(pack(other).alias("row")).schema["row"].dataType)
        left, right = (none(held), F.col("row")) if streams else (F.col("row"), none(streamed))
        return at.select(cell, F.lit(streams).alias("streams"), left.alias("held"), right.alias("streamed"))

    both = placed(held, every(parts), own(held, blocks), False).unionByName(placed(streamed, own(streamed, parts), every(blocks), True))
    dealt = both.repartitionById(parts * blocks, "cell").sortWithinPartitions("cell", "streams")
    return dealt.mapInArrow(_met(prepare, match), schema)


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(pa.Table.from_batches(waiting).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

        waiting, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                waiting.append(batch.slice(at, most - n))
                at, n = at + waiting[-1].num_rows, n + waiting[-1].num_rows
                if n == most:
                    yield piece()
                    waiting, n = [], 0
        if n:
            yield piece()

    return run


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all().combine_chunks()


def packed(rows: DataFrame, size: int, parts: int = 1, most: int = PIECE_ROWS) -> DataFrame:
    """(piece, rows): the `size` rows in pieces of at most `most`, on disk, in about `parts` partitions or as many as it takes.

    Rows are packed where they lie; they are dealt out again only where they lie in far too few partitions.
    """
    wanted = max(1, parts, math.ceil(size / most))
    given = rows.rdd.getNumPartitions()
    rows = rows.repartition(wanted) if given * PIECES_TOGETHER < wanted else rows.coalesce(wanted)
    return checkpointed(rows.mapInArrow(_pack(most), "rows binary").select(F.monotonically_increasing_id().alias("piece"), "rows"))


def met_pieces(
    left: DataFrame, right: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """What `run` gives for (piece, left, right): every packed piece of `left` with every one of `right`.

    A task reads one partition of `left` and, one after the other, all of `right` or a run of them; there is no shuffle.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    own = max(1, left.rdd.getNumPartitions())
    tasks = own * math.ceil(TASKS_PER_CORE * cores / own)
    every = left.withColumnRenamed("rows", "left").hint("shuffle_replicate_nl").crossJoin(right.select(F.col("rows").alias("right")))
    return every.coalesce(tasks).mapInArrow(run, schema)
