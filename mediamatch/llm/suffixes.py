"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of `LENGTH` bytes over it also starts earlier (in a smaller document, or earlier in
the same one). Equal windows of that length hold equal minimizers, so all windows are dealt to the smallest
`GRAM`-byte hash they hold: an anchor, with the run of windows that chose it. Runs with equal anchor,
offset and bytes are repeats of the first of them; that settles whole copies and the inside of passages
by three numbers for each run. What remains are runs that share an anchor with different bytes around it,
at the edges of passages. Only their bytes travel: per anchor the windows are sorted as truncated suffixes, the
previous and the next smaller position in suffix order give the array of longest previous factors, and windows whose
factor reaches `LENGTH` are repeats.

Runs repeated within a slice of a task are settled before the shuffle, so a passage that a third of all
documents share is one row per slice. Rows of an anchor are streamed in key order and never held together;
only the distinct surroundings of an anchor are, up to `CROWDED`. An anchor with more (a short phrase in very
many documents) is taken apart: its windows are dealt by their own hashes, and only the bytes of windows whose
hash recurs are fetched and compared, as runs of one window.

Defined results: a null text is empty; a document shorter than `LENGTH` bytes loses nothing; documents of
null id come first; rows that repeat an id are ordered by the hash of their text, and a later one loses what
it repeats; a text of any length is read whole, in overlapping parts; an empty table gives no row; columns
other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import filled, partitions_of, text_slices
from mediamatch.session import checkpointed

LENGTH = 100
GRAM = 32
#: Rows of a sorted stream that are worked on at once, at least.
STREAM_ROWS = 1 << 15
#: Most runs of an anchor that are compared as a group; the windows of an anchor with more are dealt by hash.
CROWDED = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Low bits of a ranked hash that hold a place in a slice; slices are smaller than this.
_PLACE = np.uint64((1 << 24) - 1)
PART_BYTES = 2 << 20


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _join_hashes(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Hash of n_left + n_right bytes at each place from the hashes of its two parts."""
    n = len(right) - n_left
    return left[:n] * _power(n_right) + right[n_left:]


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM and of the LENGTH bytes that start at each place."""
    by_size, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * size <= LENGTH:
        by_size[2 * size] = _join_hashes(by_size[size], by_size[size], size, size)
        size *= 2

    def of(length: int) -> np.ndarray:
        out, done = by_size[size], 0
        for s in sorted(by_size, reverse=True):
            if (length - done) & s:
                out = by_size[s] if not done else _join_hashes(out, by_size[s], done, s)
                done += s
        return out

    return of(GRAM), of(LENGTH)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(33))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor hash, run hash) of every run of windows with one anchor.

    Windows are counted from the start of their text. The run hash covers the anchor's place and all bytes.
    """
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    gram, window = _hashes(data)
    ranked = _mixed(gram)
    low = _sliding_min((ranked & ~_PLACE) | np.arange(len(ranked), dtype=np.uint64), LENGTH - GRAM + 1)
    start = np.arange(len(text)) + np.repeat(offsets[:-1] - np.cumsum(np.r_[0, counts[:-1]]), counts)
    anchor = (low[start] & _PLACE).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    size = np.diff(np.r_[begin, len(text)])
    head, tail = start[begin], start[begin + size - 1]
    shape = ((anchor[begin] - head) << 32 | size).astype(np.uint64)
    run = _mixed(window[head] * _BASE + _mixed(window[tail] + shape))
    return text[begin], head - offsets[text[begin]], size, ranked[anchor[begin]].view(np.int64), run.view(np.int64)


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, base, bytes, offsets) of slices of texts; a long text comes in parts that share LENGTH - 1 bytes."""
    for low, end, data, offsets in text_slices(column, PART_BYTES):
        if len(data) <= 2 * PART_BYTES:
            yield np.arange(low, end), np.zeros(end - low, np.int64), data, offsets
            continue
        for row in range(low, end):
            own = data[offsets[row - low] : offsets[row - low + 1]]
            for base in range(0, len(own), PART_BYTES):
                piece = own[base : base + PART_BYTES + LENGTH - 1]
                yield np.array([row]), np.array([base]), piece, np.array([0, len(piece)])


#: A run as it travels: `span` is its first window, shifted, and its number of windows; settled runs are repeats.
#: A row of no windows says that its anchor is crowded.
RUNS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("key", pa.int64()), ("span", pa.int64()), ("settled", pa.bool_())])
RUN_TYPES = "anchor long, run long, key long, span long, settled boolean"
_SPAN_BITS = 32


def _merged(key: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows with those that touch in one document joined; sorted by key, first."""
    order = np.lexsort([first, key])
    key, first, size = key[order], first[order], size[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (first[1:] != first[:-1] + size[:-1])] if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(key)] - 1 if len(begin) else begin
    return key[begin], first[begin], first[last] + size[last] - first[begin]


def _run_batch(anchor, run, key, first, size, settled: bool) -> pa.RecordBatch:
    span = (first.astype(np.int64) << _SPAN_BITS) | size
    flags = np.full(len(key), settled)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, run, key, span, flags)], schema=RUNS)


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text; one that the slice also holds earlier is settled on the spot."""
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(key)
        key = key[order]
        for rows, base, data, offsets in _parts(filled(batch.column(1)).take(pa.array(order))):
            text, first, size, anchor, run = anchor_runs(data, offsets)
            if not len(text):
                continue
            own, first = key[rows[text]], first + base[text]
            fresh = np.zeros(len(run), bool)
            fresh[np.unique(run, return_index=True)[1]] = True
            yield _run_batch(anchor[fresh], run[fresh], own[fresh], first[fresh], size[fresh], False)
            if not fresh.all():
                k, f, n = _merged(own[~fresh], first[~fresh], size[~fresh])
                yield _run_batch(k, np.zeros(len(k), np.int64), k, f, n, True)


def _settle(batches: Iterator[pa.RecordBatch], crowded: int = CROWDED) -> Iterator[pa.RecordBatch]:
    """From rows by anchor, run, key, span: repeats as settled, and the first of each run whose anchor has other runs;
    besides, a row of no windows for each anchor with more than `crowded` runs."""
    previous: tuple | None = None
    runs = 0  # of the open anchor
    lone: list[np.ndarray] | None = None  # the first run of the open anchor, as long as it is the only one
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        ready = columns[4].astype(bool)
        if ready.any():
            yield _run_batch(*(c[ready] for c in columns[:3]), columns[3][ready] >> _SPAN_BITS, columns[3][ready] & 0xFFFFFFFF, True)
            columns = [c[~ready] for c in columns]
        anchor, run, key, span = columns[:4]
        if not len(anchor):
            continue
        same_anchor = np.r_[previous is not None and previous[0] == anchor[0], anchor[1:] == anchor[:-1]]
        same_run = same_anchor & np.r_[previous is not None and previous[1] == run[0], run[1:] == run[:-1]]
        previous = (anchor[-1], run[-1])
        if same_run.any():
            k, f, n = _merged(key[same_run], span[same_run] >> _SPAN_BITS, span[same_run] & 0xFFFFFFFF)
            yield _run_batch(k, np.zeros(len(k), np.int64), k, f, n, True)
        lead = np.flatnonzero(~same_run)
        if not len(lead):
            continue
        follows = same_anchor[lead]  # another run of the anchor came before
        begin = np.flatnonzero(np.r_[True, ~follows[1:]])
        before = np.zeros(len(begin), np.int64)
        before[0] = runs if follows[0] else 0
        after = before + np.diff(np.r_[begin, len(lead)])
        runs = int(after[-1])
        full = anchor[lead[begin[(before <= crowded) & (after > crowded)]]]
        if len(full):
            none = np.zeros(len(full), np.int64)
            yield _run_batch(full, none, none, none, none, False)
        shared = follows.copy()
        shared[:-1] |= follows[1:]
        chosen = [c[lead[shared]] for c in (anchor, run, key, span)]
        if follows[0] and lone is not None:
            chosen = [np.r_[c, x] for c, x in zip(chosen, lone)]
        if shared[-1]:
            lone = None
        else:
            lone = [c[lead[-1:]] for c in (anchor, run, key, span)]
        if len(chosen[0]):
            yield _run_batch(*chosen[:3], chosen[3] >> _SPAN_BITS, chosen[3] & 0xFFFFFFFF, False)


def _take_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, key, first, bytes) of every wanted run of each text."""
    for batch in batches:
        anchors, keys, firsts, parts = [], [], [], []
        for key, text, wanted in zip(batch.column(0).to_pylist(), filled(batch.column(2)), batch.column(3)):
            data = text.as_py().encode()
            for want in wanted.as_py():
                first, size = want["span"] >> _SPAN_BITS, want["span"] & 0xFFFFFFFF
                anchors.append(want["anchor"])
                keys.append(key)
                firsts.append(first)
                parts.append(data[first : first + size + LENGTH - 1])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((anchors, keys, firsts, parts), kinds)], names=["anchor", "key", "first", "bytes"]
        )


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `starts` sorted by group, then by their first `length` bytes, ties by position; and for each entry
    how many bytes, up to `length`, it shares with the entry before it (0 across groups)."""
    order = np.lexsort([starts, group])
    rank = np.cumsum(np.r_[0, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    shared = np.where(np.r_[True, np.diff(rank) != 0], 0, length) if len(order) else np.zeros(0, np.int64)
    padded = np.r_[data, np.zeros(length + 8, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for depth in range(0, length, 8):
        tied = np.zeros(len(order), bool)
        tied[1:] = shared[1:] == length
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        taken = min(8, length - depth)
        block = np.ascontiguousarray(words[starts[order[at]] + depth]).copy()
        block[:, taken:] = 0
        key = block.view(">u8").ravel().astype(np.uint64)
        own = np.cumsum(np.r_[0, shared[at[1:]] != length])
        sub = np.lexsort([starts[order[at]], key, own])
        order[at], key = order[at][sub], key[sub]
        inner = np.flatnonzero((own[1:] == own[:-1]) & (key[1:] != key[:-1])) + 1
        apart = key[inner] ^ key[inner - 1]
        shared[at[inner]] = depth + sum((apart >> np.uint64(shift)) == 0 for shift in range(56, 0, -8))
    return order, shared


def _shared_with_smaller(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many bytes each entry of a suffix order shares with the nearest entry before it of smaller position, given what
    neighbours share; 0 without one. Entries jump over what the entries that they meet have jumped over already."""
    n = len(place)
    before = np.r_[np.arange(-1, n - 1), -1]  # the last is what lies before all: of no position, sharing nothing
    place, common = np.r_[place, -1], np.r_[shared, 0]
    if n:
        common[0] = 0
    open_entries = np.arange(n)
    while True:
        open_entries = open_entries[place[before[open_entries]] > place[open_entries]]
        if not len(open_entries):
            return common[:-1]
        at = before[open_entries]
        common[open_entries] = np.minimum(common[open_entries], common[at])
        before[open_entries] = before[at]


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix the longest prefix, up to `length`, that a suffix of its group at an earlier place shares.

    In suffix order the candidates are the previous and the next entry of smaller position.
    """
    order, shared = suffix_order(data, starts, group, length)
    place = starts[order]
    earlier = _shared_with_smaller(place, shared)
    later = _shared_with_smaller(place[::-1], np.r_[shared[1:], 0][::-1] if len(shared) else shared)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(earlier, later)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where the longest previous factor reaches `length`. Windows whose hash no other window of their group has are left
    out of the suffix order: they repeat nothing, and nothing repeats them."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    _, window = _hashes(data)
    mark = _mixed(window[starts] + _mixed(group.astype(np.uint64)))
    _, inverse, counts = np.unique(mark, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    out[again[longest_previous_factors(data, starts[again], group[again], length) >= length]] = True
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ranges (key, first, stop) among the surroundings of each anchor, which come in position order.

    Of a group that goes on beyond `STREAM_ROWS` only rows with a fresh window stay; that is one row of a recurring
    window, and other groups are not so large.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in _then_none(batches):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < STREAM_ROWS:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = table.column(0).to_numpy()
        ready = len(anchor)
        if batch is not None:
            ready = int(np.searchsorted(anchor, anchor[-1], "left"))
        if ready:
            yield _compared(table.slice(0, ready))[0]
        open_group = table.slice(ready)
        if open_group.num_rows >= STREAM_ROWS:
            found, fresh = _compared(open_group)
            yield found
            open_group = open_group.filter(pa.array(fresh)).combine_chunks()
        held = open_group.to_batches()
        rows = open_group.num_rows


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _windows(anchor: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bytes of all parts, start, row, place in the row, group number) with one entry for each window of the parts."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    windows = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(parts)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, windows[:-1]]), windows)
    starts = np.repeat(np.cumsum(np.r_[0, sizes[:-1]]), windows) + inside
    return data, starts, row, inside, np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])[row]


def _compared(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """The repeated ranges, and which rows have a window that is no repeat."""
    anchor, key, first = (table.column(i).to_numpy() for i in range(3))
    data, starts, row, inside, group = _windows(anchor, table.column(3).to_pylist())
    again = repeated_windows(data, starts, group)
    k, f, n = _merged(key[row[again]], first[row[again]] + inside[again], np.ones(int(again.sum()), np.int64))
    found = pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(f + n - 1 + LENGTH)], names=["key", "first", "stop"])
    return found, np.bincount(row[~again], minlength=len(key)) > 0


def _take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the runs of crowded anchors: windows that the same slice holds earlier as settled, others as runs of one
    window whose anchor is the hash of their bytes."""
    for batch in _take_bytes(batches):
        table = pa.Table.from_batches([batch]).sort_by([("anchor", "ascending"), ("key", "ascending"), ("first", "ascending")])
        for low in range(0, table.num_rows, STREAM_ROWS):
            anchor, key, first, parts = (c.to_numpy() for c in table.slice(low, STREAM_ROWS).combine_chunks().columns)
            data, starts, row, inside, group = _windows(anchor, list(parts))
            again = repeated_windows(data, starts, group)
            own, place = key[row], first[row] + inside
            mark = _mixed(_hashes(data)[1][starts[~again]]).view(np.int64)
            yield _run_batch(mark, np.zeros(len(mark), np.int64), own[~again], place[~again], np.ones(len(mark), np.int64), False)
            if again.any():
                k, f, n = _merged(own[again], place[again], np.ones(int(again.sum()), np.int64))
                yield _run_batch(k, np.zeros(len(k), np.int64), k, f, n, True)


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by anchor: those that are settled, and those whose anchor other rows that are not settled have too."""
    last: pa.RecordBatch | None = None  # the last row, as long as its anchor is not seen again
    previous: int | None = None
    for batch in batches:
        settled = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
        if settled.any():
            yield batch.filter(pa.array(settled))
            batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        follows = np.r_[previous is not None and previous == anchor[0], anchor[1:] == anchor[:-1]]
        if follows[0] and last is not None:
            yield last
        shared = follows.copy()
        shared[:-1] |= follows[1:]
        last = None if shared[-1] else batch.slice(batch.num_rows - 1)
        previous = anchor[-1]
        if shared.any():
            yield batch.filter(pa.array(shared))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text), `key` unique and in document order: the id itself unless ids are missing or repeat."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    ordered = rows.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return checkpointed(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its repeated ranges."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, ranges in zip(batch.column(1).to_pylist(), filled(batch.column(2)), batch.column(3)):
            data = text.as_py().encode()
            kept, at, removed, spans = [], 0, 0, 0
            reach = -1
            for r in sorted(ranges.as_py() or [], key=lambda r: r["first"]):
                if r["first"] > reach:
                    kept.append(data[max(at, 0) : r["first"]])
                    spans += 1
                    removed += r["stop"] - r["first"]
                elif r["stop"] > reach:
                    removed += r["stop"] - reach
                reach = at = max(reach, r["stop"])
            kept.append(data[at:])
            out.append((doc, len(data), removed, spans, b"".join(kept)))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes of every document that are no repeats."""
    texts = _keyed(docs, id_col, text_col)
    n = partitions_of(docs)
    runs = texts.select("key", "text").mapInArrow(_emit_runs, RUN_TYPES)
    dealt = runs.repartition(n, "anchor").sortWithinPartitions("anchor", "run", "key", "span")
    settled = checkpointed(dealt.mapInArrow(partial(_settle, crowded=crowded), RUN_TYPES))

    # No key is null. Saying so gives an inner and a left join the same scan, so that both read one shuffle of the texts.
    whole = texts.where(F.col("key").isNotNull()).repartition(n, "key")

    def around(runs: DataFrame) -> DataFrame:
        wanted = runs.groupBy("key").agg(F.collect_list(F.struct("anchor", "span")).alias("wanted"))
        return whole.join(wanted, "key").select("key", "doc_id", "text", "wanted")

    no_windows = F.col("span").bitwiseAND(0xFFFFFFFF) == 0
    open_runs, inside = settled.where(~F.col("settled") & ~no_windows), settled.where("settled")
    full = settled.where(~F.col("settled") & no_windows).select("anchor")
    if not full.isEmpty():
        # one row for each `crowded` runs at most
        full = F.broadcast(full)
        apart = around(open_runs.join(full, "anchor", "left_semi")).mapInArrow(_take_apart, RUN_TYPES)
        met = apart.repartition(n, "anchor").sortWithinPartitions("anchor")
        # Not checkpointed: a job of its own would shuffle the texts once more. Both readers share the shuffle by anchor.
        windows = met.mapInArrow(_recurring, RUN_TYPES)
        open_runs = open_runs.join(full, "anchor", "left_anti").unionByName(windows.where(~F.col("settled")))
        inside = inside.unionByName(windows.where("settled"))
    bytes_of = around(open_runs).mapInArrow(_take_bytes, "anchor long, key long, first long, bytes binary")
    met = bytes_of.repartition(n, "anchor").sortWithinPartitions("anchor", "key", "first")
    edges = met.mapInArrow(_compare, "key long, first long, stop long")

    first = F.shiftright("span", _SPAN_BITS)
    stop = first + F.col("span").bitwiseAND(0xFFFFFFFF) - 1 + LENGTH
    inside = inside.select("key", first.alias("first"), stop.alias("stop"))
    ranges = inside.unionByName(edges).groupBy("key").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))
    return (
        whole.join(ranges, "key", "left")
        .select("key", "doc_id", "text", "ranges")
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )
