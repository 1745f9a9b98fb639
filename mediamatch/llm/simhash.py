"""Near duplicates by SimHash with a generalised pigeonhole search.

Every text gets a 64-bit fingerprint of its word shingles. Fingerprints that differ in few bits are found
by splitting the bits into parts: with radii r_i that sum to `distance - parts + 1`, two fingerprints within
`distance` bits differ by at most r_i in some part i. Correlated bits go to the same part, so that parts are
as independent as the corpus allows, and dynamic programming deals out unequal radii by the estimated number
of candidates. Part values within a radius of each other meet on a probe key and are verified.

Only distinct fingerprints are searched, so copies never multiply. Rows that meet on a key are streamed in
key order; each block of them yields a spanning forest of its links, never all pairs, and a key with more
rows than a block holds is split into a grid of block pairs. Bit statistics cover all fingerprints and are
64 x 64 numbers whatever the corpus size.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows share
their component; a null id never names a component unless all ids of the component are null; an empty table
gives no row; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import filled, partitions_of, unused
from mediamatch.operators.components import connected_components
from mediamatch.session import checkpointed

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Rows of one key that are compared with each other at once.
BLOCK = 4096
#: Cost of moving one probe row, in comparisons.
ROW_COST = 200.0
PART_COUNTS = (2, 3, 4, 5)
MAX_RADIUS = 2


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of the words of a text, A-Z lower-cased; 0 for a text without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in filled(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], names=["doc_id", "text_hash", "bits"])

    text = docs[text_col]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, bits long")


@dataclass(frozen=True)
class Part:
    positions: tuple[int, ...]
    radius: int  # -1: not probed


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits the number of fingerprints that set both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 65536):
                block = np.ascontiguousarray(values[at : at + 65536]).view(np.uint8).reshape(-1, 8)
                ones = np.unpackbits(block, axis=1, bitorder="little").astype(np.float32)
                n, both = n + len(ones), both + (ones.T @ ones).astype(float)
        if n:
            pair = np.arange(BITS * BITS, dtype=np.int32)
            counts = both.ravel().round().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts), pa.array(np.full(len(pair), n))], names=["pair", "c", "n"])

    rows = prints.select("bits").mapInArrow(run, "pair int, c long, n long").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    got = rows.toPandas()
    both = np.zeros(BITS * BITS)
    both[got["pair"]] = got["c"]
    return int(got["n"].max()) if len(got) else 0, both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in groups of nearly equal size, each grown by the bit most correlated with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (tied[b, group].sum(), -b)))
            free.remove(group[-1])
        out.append(tuple(sorted(group)))
    return out


def _within(share: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, ... of these bits."""
    odds = np.array([1.0])
    for b in positions:
        differ = 2 * share[b] * (1 - share[b])
        odds = np.convolve(odds, [1 - differ, differ])
    return np.cumsum(odds)


def deal_radii(groups: list[tuple[int, ...]], n: int, share: np.ndarray, distance: int) -> tuple[float, list[Part]]:
    """Radii of least estimated cost that sum to distance - parts + 1, by dynamic programming over the parts."""
    pairs = n * max(n - 1, 1) / 2
    total = distance - len(groups) + 1
    best: dict[int, tuple[float, list[Part]]] = {0: (0.0, [])}
    for group in groups:
        within = _within(share, group)
        ahead: dict[int, tuple[float, list[Part]]] = {}
        for spent, (cost, chosen) in best.items():
            for radius in range(-1, MAX_RADIUS + 1):
                probes = sum(comb(len(group), i) for i in range(radius + 1))
                more = cost + (ROW_COST * n * probes + pairs * within[radius] * (1 + (radius > 0)) if radius >= 0 else 0.0)
                if spent + radius not in ahead or more < ahead[spent + radius][0]:
                    ahead[spent + radius] = (more, [*chosen, Part(group, radius)])
        best = ahead
    return best.get(total, (np.inf, []))


def plan_parts(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[Part]:
    """The cheapest partition and radii over the allowed numbers of parts."""
    share = np.diag(both) / max(n, 1)
    plans = [deal_radii(correlated_parts(n, both, m), n, share, distance) for m in PART_COUNTS]
    return [p for p in min(plans, key=lambda plan: plan[0])[1] if p.radius >= 0]


def _probe_keys(values: np.ndarray, parts: list[Part]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(part number, key, whether it is the value itself) for every probe of every part."""
    for number, part in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in part.positions))
        yield number, values & mask, True
        for flips in range(1, part.radius + 1):
            for chosen in combinations(part.positions, flips):
                yield number, (values & mask) ^ np.uint64(sum(1 << b for b in chosen)), False


def _forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (value, smallest value of its component) of the given links between rows."""
    touched = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(touched, left), np.searchsorted(touched, right)
    label = np.arange(len(touched))
    while True:
        low = np.minimum(label[a], label[b])
        ahead = label.copy()
        np.minimum.at(ahead, a, low)
        np.minimum.at(ahead, b, low)
        np.minimum.at(ahead, label[a], low)
        np.minimum.at(ahead, label[b], low)
        ahead = ahead[ahead]
        if np.array_equal(ahead, label):
            break
        label = ahead
    moved = label != np.arange(len(label))
    return values[touched[moved]], values[touched[label[moved]]]


def _links(values: np.ndarray, group: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links inside groups; rows come sorted by group, a group has at most a few blocks of rows."""
    lefts, rights = [], []
    sizes = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])) if len(group) else np.zeros(0, int)
    rows = np.arange(len(values))
    for lag in range(1, int(sizes.max(initial=1))):
        rows = rows[rows + lag < len(values)]
        rows = rows[group[rows] == group[rows + lag]]
        near = np.bitwise_count(values[rows] ^ values[rows + lag]) <= distance
        near &= (own[rows] | own[rows + lag]) & (values[rows] != values[rows + lag])
        if near.any():
            lefts.append(rows[near])
            rights.append(rows[near] + lag)
            if sum(map(len, lefts)) > 1 << 20:  # keep a forest of what was found so far
                a, b = _row_forest(np.concatenate(lefts), np.concatenate(rights))
                lefts, rights = [a], [b]
    if not lefts:
        return values[:0], values[:0]
    return _forest(values, np.concatenate(lefts), np.concatenate(rights))


def _row_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _forest(np.arange(int(max(left.max(), right.max())) + 1), left, right)


def near_links(prints: DataFrame, parts: list[Part], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (left_bits, right_bits) that connect all distinct fingerprints within `distance` bits of each other."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 16384):
                bits = np.ascontiguousarray(values[at : at + 16384])
                for number, keys, own in _probe_keys(bits.view(np.uint64), parts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(bits), number, np.int32)),
                            pa.array(keys.view(np.int64)),
                            pa.array(np.full(len(bits), own)),
                            pa.array(bits),
                        ],
                        names=["part", "key", "own", "bits"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
                part, key, cell = held[0], held[1], held[2]
                last = len(key) - 1
                same = (part == part[last]) & (key == key[last]) & (cell == cell[last])
                ready = int(np.argmax(same))  # rows are sorted, so the open group is a suffix
                if ready < 1 << 15:
                    continue
            elif held is None:
                return
            else:
                ready = len(held[0])
            part, key, cell, bits = (x[:ready] for x in held)
            held = [x[ready:] for x in held]
            if not ready:
                continue
            edge = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            group = np.cumsum(np.r_[0, edge])
            values = bits.view(np.uint64)
            mask = np.array([sum(1 << b for b in p.positions) for p in parts], np.uint64)
            own = (values & mask[part]) == key.view(np.uint64)
            left, right = _links(values, group, own, distance)
            if len(left):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["left_bits", "right_bits"]
                )

    rows = prints.select("bits").mapInArrow(probes, "part int, key long, own boolean, bits long")
    crowded = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("any_own"))
    crowded = checkpointed(crowded.where(F.col("n") > block))
    shares = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(float(block))).cast("int")
    if crowded.isEmpty():
        dealt = rows.select("part", "key", F.lit(0).alias("cell"), "bits")
    else:
        # A crowded key becomes a grid: every two shares of its rows meet in one cell. Rows around a hot value
        # also crowd the keys beside it; a key that is nobody's own value links nothing and goes.
        placed = rows.join(crowded, ["part", "key"], "left").where(F.coalesce("any_own", F.lit(True))).withColumn("shares", shares)
        mine = F.pmod(F.xxhash64("bits"), F.col("shares")).cast("int")
        cells = F.transform(
            F.sequence(F.lit(0), F.col("shares") - 1),
            lambda other: F.least(other, F.col("mine")) * F.col("shares") + F.greatest(other, F.col("mine")),
        )
        dealt = placed.withColumn("mine", mine).select("part", "key", F.explode(cells).alias("cell"), "bits")
    n = partitions_of(prints)
    met = dealt.repartition(n, "part", "key", "cell").sortWithinPartitions("part", "key", "cell", "bits")
    return met.mapInArrow(meet, "left_bits long, right_bits long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _labels(prints: DataFrame, distance: int) -> DataFrame:
    """(bits, component) of every distinct fingerprint."""
    distinct = prints.select("bits").distinct()
    n, both = bit_statistics(distinct)
    if n < 2:
        return distinct.withColumn("component", F.col("bits"))
    linked = connected_components(near_links(distinct, plan_parts(n, both, distance), distance))
    linked = linked.select(F.col("node").alias("bits"), "component")
    return distinct.join(linked, "bits", "left").select("bits", F.coalesce("component", "bits").alias("component"))


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; a component is named by its smallest id."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    smallest = prints.groupBy("bits").agg(F.min("doc_id").alias("first_doc"))
    labels = checkpointed(_labels(prints, distance))
    names = labels.join(smallest, "bits").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = labels.join(names, "component").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row, columns unchanged, of each component: that of the smallest id, null ids last."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    smallest = prints.groupBy("bits").agg(F.min(order).alias("first"))
    chosen = smallest.join(_labels(prints, distance), "bits").groupBy("component").agg(F.min("first").alias("first"))
    own_id, own_hash = unused(docs, "kept_id"), unused(docs, "kept_hash")
    chosen = chosen.select(F.col("first.doc_id").alias(own_id), F.col("first.text_hash").alias(own_hash))
    same = docs[id_col].cast("long").eqNullSafe(chosen[own_id]) & (F.xxhash64(docs[text_col]) == chosen[own_hash])
    kept = docs.join(chosen, same, "left_semi")
    if prints.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
