"""Sequence packing by minimum bin slack.

A document becomes its token ids and one closing id. Whole windows are cut off its front; what remains is
shorter than a window and waits in a pool. A window starts with the longest waiting piece, and a bitset
subset-sum over the multiset of waiting lengths finds the fill that comes closest to capacity; walking the
stored bitsets back gives how many pieces of each length it takes. What the pool holds at the end of a
partition is laid end to end and cut into windows and powers of two, so the tail needs no padding.

Each task packs the rows of its own partition: nothing is shuffled, and what a task holds is bounded by the
pool. A partition that is computed again gives the same pieces, as its rows and their order are the same.

Defined results: a null or empty text is one closing id; a repeated row is packed again; a text longer than
a window spans several sequences; an empty table gives no row; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mediamatch.llm.frames import arrow_rows

WINDOW = 2048
CLOSING_ID = 1
#: Pieces that wait for a fill; more pieces find closer fills and cost more work for each window.
POOL = 384
END_OF_TEXT = "<|endoftext|>"
#: Scripts for which both libraries cut words alike; other texts go through the vocabulary's own library.
OTHER_SCRIPTS = re.compile("[^\u0000-\u024f\u2010-\u2027]")
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(vocabulary: str, ranks: str) -> Callable[[str], list[int]]:
    """Ids of a text by the byte-pair vocabulary; `ranks` names the same vocabulary for the faster library."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(ranks), "rb") as file:
        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if OTHER_SCRIPTS.search(text) or END_OF_TEXT in text:
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def closest_fill(counts: Counter, room: int) -> dict[int, int]:
    """How many pieces of each length bring the sum closest to `room` without passing it."""
    full = (1 << (room + 1)) - 1
    reached = 1
    steps: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            steps.append((length, reached))
            reached |= (reached << length) & full
            if reached >> room:
                break
        if reached >> room:
            break
    at = reached.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return taken


class _Pool:
    def __init__(self) -> None:
        self.waiting: dict[int, deque] = {}
        self.counts: Counter = Counter()
        self.size = 0

    def add(self, piece: tuple) -> None:
        self.waiting.setdefault(len(piece[2]), deque()).append(piece)
        self.counts[len(piece[2])] += 1
        self.size += 1

    def take(self, length: int) -> tuple:
        self.size -= 1
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.waiting[length].popleft()

    def window(self, window: int) -> list[tuple]:
        """Pieces that fill a window; the slack the best fill leaves is closed by cutting one more piece."""
        longest = max(self.counts)
        out = [self.take(longest)]
        for length, n in closest_fill(self.counts, window - longest).items():
            out.extend(self.take(length) for _ in range(n))
        slack = window - sum(len(p[2]) for p in out)
        while slack and self.size:
            doc, start, ids, total = self.take(max(self.counts))
            out.append((doc, start, ids[:slack], total))
            if len(ids) > slack:
                self.add((doc, start + slack, ids[slack:], total))
            slack -= len(out[-1][2])
        return out

    def rest(self) -> list[tuple]:
        return [self.take(length) for length in sorted(self.counts, reverse=True) for _ in range(self.counts[length])]


def cut_tail(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Lay pieces end to end and cut them into full windows, then into falling powers of two."""
    left = sum(len(p[2]) for p in pieces)
    queue = deque(pieces)
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, ids, total = queue.popleft()
            out.append((doc, start, ids[:room], total))
            if len(ids) > room:
                queue.appendleft((doc, start + room, ids[room:], total))
            room -= len(out[-1][2])
        yield out


def sequences(documents: Iterator[tuple], window: int = WINDOW, pool_size: int = POOL) -> Iterator[list[tuple]]:
    """Pieces (doc, start, ids, doc_tokens) of each sequence, from (doc, ids)."""
    pool = _Pool()
    for doc, ids in documents:
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            yield [(doc, start, ids[start : start + window], len(ids))]
        if whole < len(ids):
            pool.add((doc, whole, ids[whole:], len(ids)))
            if pool.size >= 2 * pool_size:
                while pool.size > pool_size:
                    yield pool.window(window)
    while sum(length * n for length, n in pool.counts.items()) >= window:
        yield pool.window(window)
    yield from cut_tail(pool.rest(), window)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    window: int = WINDOW,
    pool_size: int = POOL,
) -> DataFrame:
    """One row for each piece: its document, place in the document, checksum of ids, sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        base = TaskContext.get().partitionId() << 40

        def documents() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "")
                    ids.append(CLOSING_ID)
                    yield doc, np.array(ids, "<u4")

        rows: list[tuple] = []
        for number, pieces in enumerate(sequences(documents(), window, pool_size)):
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, base + number, offset))
                offset += len(ids)
            if len(rows) >= 8192:
                yield arrow_rows(PIECES, **dict(zip(PIECES.names, zip(*rows))))
                rows = []
        if rows:
            yield arrow_rows(PIECES, **dict(zip(PIECES.names, zip(*rows))))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
