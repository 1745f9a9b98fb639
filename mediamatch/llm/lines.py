"""Line deduplication that returns keep bitmaps.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Keys of at least
`LEAST` code points lose all their lines but those in the smallest document that holds them. Lines travel as
two 64-bit hashes of their key with the document and the position, never as text. Range partitions over (hash,
document, position), sorted the same way, make the lines of a key consecutive, and a stream over them keeps of the
open key nothing but its first document. The ranges are cut inside a key as well, so a line that a third of all
documents share is dealt to many tasks. Only a task's first key can have begun in an earlier task: its lines are
passed on undecided, and each task adds the first document of its first and of its last key. Those are two rows a
task at most, and their minimum decides the rest.

What comes back is a bitmap for each document: bit i, lowest bit of a byte first, says that line i stays;
packed by zlib. Texts are read again only by `kept_texts`.

Defined results: a null or empty text is one empty line; a null id counts as the smallest document; rows that share
an id are one document with several texts, so none of them loses a line to another; rows that also share the text
have one bitmap; an empty table gives no row; a text of any length is read whole; columns other than id and text are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import filled, partitions_of, text_slices
from mediamatch.session import checkpointed

#: Least number of code points of a key.
LEAST = 10
SPACES = " \t\n\v\f\r"
SLICE_BYTES = 8 << 20
#: Stands for a null id, so that it sorts first.
NO_ID = -(1 << 63)

_LINES = "high long, low long, doc long, digest long, line int"
_FOUND = _LINES + ", kind byte"
#: Kinds of rows that the stream gives back.
DROPPED, UNDECIDED, FIRST = 0, 1, 2


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, digest, doc_id, text): id and digest of the text tell rows apart."""
    text = F.coalesce(docs[text_col], F.lit(""))
    doc_id = docs[id_col].cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("digest"), doc_id.alias("doc_id"), text.alias("text"))


def _hash_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(high, low, doc, digest, line) of every line whose key is long enough."""
    names = [field.split()[0] for field in _LINES.split(", ")]
    for batch in batches:
        doc, digest = (batch.column(i).to_numpy() for i in (0, 1))
        column = filled(batch.column(2))
        for low, end, _, _ in text_slices(column, SLICE_BYTES):
            lines = pc.split_pattern(column.slice(low, end - low), "\n")
            counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(low, end), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = pc.ascii_lower(pc.utf8_trim(lines.flatten(), characters=SPACES))
            enough = pc.greater_equal(pc.utf8_length(keys), least)
            chosen = enough.to_numpy(zero_copy_only=False)
            keys, row, place = keys.filter(enough), row[chosen], place[chosen]
            hashes = b"".join(xxhash.xxh3_128_digest(key) for key in keys.cast(pa.large_binary()).to_pylist())
            both = np.frombuffer(hashes, np.int64).reshape(-1, 2)
            columns = (both[:, 0], both[:, 1], doc[row], digest[row], place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lines sorted by key, document, position: those behind a key's first document, those of the task's first key,
    and the first document of the task's first and last key."""
    names = [field.split()[0] for field in _FOUND.split(", ")]

    def rows(columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), kind, np.int8))], names=names)

    begun: tuple | None = None  # the task's first key
    key: tuple | None = None  # the open key and its first line
    first: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        high, low, doc = columns[:3]
        new = np.r_[(high[0], low[0]) != key, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        if begun is None:
            begun = (high[0], low[0])
            yield rows([c[:1] for c in columns], FIRST)
        group = np.cumsum(new) - 1  # -1: the key that was open before
        begin = np.flatnonzero(new)
        least = np.r_[doc[begin], first[2] if first else doc[:1]][group]
        early = (high == begun[0]) & (low == begun[1])
        if early.any():
            yield rows([c[early] for c in columns], UNDECIDED)
        late = ~early & (doc > least)
        if late.any():
            yield rows([c[late] for c in columns], DROPPED)
        if len(begin):
            first = [c[begin[-1] : begin[-1] + 1] for c in columns]
        key = (high[-1], low[-1])
    if first and key != begun:
        yield rows(first, FIRST)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dropped = [], []
        for n, gone in zip(batch.column(1).to_pylist(), batch.column(2)):
            stays = np.ones(n, bool)
            if gone.is_valid:
                stays[gone.values.to_numpy()] = False
            keep.append(zlib.compress(np.packbits(stays, bitorder="little").tobytes()))
            dropped.append(n - int(stays.sum()))
        columns = [batch.column(0), batch.column(3), batch.column(1), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_lines", "n_dropped", "keep"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, digest, line): the lines that go; `doc` is the id, or `NO_ID` for null, `digest` xxhash64 of the text."""
    texts = _documents(docs, id_col, text_col).select("doc", "digest", "text")
    lines = texts.mapInArrow(lambda batches: _hash_lines(batches, least), _LINES)
    order = ("high", "low", "doc", "digest", "line")
    sorted_lines = lines.repartitionByRange(partitions_of(docs), *order).sortWithinPartitions(*order)
    found = checkpointed(sorted_lines.mapInArrow(_first_occurrences, _FOUND))
    # two rows a task at most
    firsts = found.where(F.col("kind") == FIRST).groupBy("high", "low").agg(F.min("doc").alias("least"))
    rest = found.where(F.col("kind") == UNDECIDED).join(F.broadcast(firsts), ["high", "low"]).where("doc > least")
    place = ("doc", "digest", "line")
    return found.where(F.col("kind") == DROPPED).select(*place).unionByName(rest.select(*place))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, digest, n_lines, n_dropped, keep), one row for each document and text; `keep` as the module says."""
    gone = dropped_lines(docs, id_col, text_col, least).groupBy("doc", "digest").agg(F.collect_list("line").alias("gone"))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    counted = _documents(docs, id_col, text_col).select("doc", "digest", "doc_id", n_lines.alias("n_lines"))
    every = counted.groupBy("doc", "digest").agg(F.first("doc_id").alias("doc_id"), F.first("n_lines").alias("n_lines"))
    rows = every.join(gone, ["doc", "digest"], "left").select("doc_id", "n_lines", "gone", "digest")
    return rows.mapInArrow(_bitmaps, "doc_id long, digest long, n_lines long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, n, dropped, keep in zip(filled(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
            if not dropped:
                kept.append(text.as_py())
                continue
            stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little")
            kept.append("\n".join(line for line, stay in zip(text.as_py().split("\n"), stays) if stay))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in (0, 2, 3)), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"]
        )


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the texts of all rows without the lines that go."""
    maps = bitmaps.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).drop("doc_id")
    rows = _documents(docs, id_col, text_col).join(maps, ["doc", "digest"])
    return rows.select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept string")
