"""Quality classifier: a byte-level convolutional network in numpy.

Every byte becomes a learned vector; learned filters of `WIDTH` bytes run over the whole text and are
max-pooled over overlapping chunks; a linear layer turns each chunk's pooled responses into a logit, and the
mean over all chunks of the document gives one probability. One more input marks bytes whose next eight
bytes come again a few bytes later, which a filter of this width could not see.

The network is fitted on the driver on at most `SAMPLE_ROWS` labelled rows, chosen by hashes of ids. Their whole
texts are cut into chunks on the executors; `SAMPLE_CHUNKS` of them, drawn evenly from the whole text, stand
for a longer one, as the steps of the fit draw no more from it. Scoring reads whole texts in a narrow map;
the convolution is a sum of table rows, one table for each place of the filter.

Defined results: a null or empty text scores the share of good rows in the sample, 0.5 without a sample; a
document with several labels counts as its lowest; null labels and labels of unknown documents are ignored;
with labels of one class only every score is that class's share; repeated rows score alike; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import filled, held_out, text_slices

FOLDS = 5
THRESHOLD = 0.3
SAMPLE_ROWS = 4000
#: Chunks of one labelled text that reach the driver. All steps together draw about 22 from each of `SAMPLE_ROWS` texts.
SAMPLE_CHUNKS = 32
WIDTH = 5
FILTERS = 16
DEPTH = 6
#: Chunks are two blocks long and start at every block.
BLOCK = 128
#: Bytes that the filters of one chunk read.
CHUNK = 2 * BLOCK + WIDTH - 1
LAGS = range(3, 17)
#: Bytes after a text that belong to no other, so that its score depends on nothing else.
GAP = 32
STEPS = 900
BATCH = 96
RATE = 0.01
SLICE = 1 << 19


@dataclass(frozen=True)
class Network:
    tables: np.ndarray  # place x byte x filter
    repeats: np.ndarray  # place x filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float  # logit of a text without chunks


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with every text on blocks of its own, first block of each text and the end, length of each text)."""
    lengths = np.diff(offsets)
    blocks = np.where(lengths > 0, np.maximum(-(-(lengths + GAP) // BLOCK), 2), 0)
    edges = np.r_[0, np.cumsum(blocks)]
    out = np.zeros(edges[-1] * BLOCK + GAP, np.uint8)
    out[np.arange(len(data)) + np.repeat(edges[:-1] * BLOCK - offsets[:-1], lengths)] = data
    return out, edges, lengths


def repeated_marks(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """1 where the next eight bytes of a text come again within a few bytes."""
    wide = data.astype(np.uint64)
    wide = wide[:-1] | wide[1:] << np.uint64(8)
    wide = wide[:-2] | wide[2:] << np.uint64(16)
    wide = wide[:-4] | wide[4:] << np.uint64(32)
    out = np.zeros(len(data), bool)
    for lag in LAGS:
        out[: len(wide) - lag] |= (wide[:-lag] == wide[lag:]) & (wide[:-lag] != 0)
    out[(edges[1:, None] * BLOCK - np.arange(1, 9)).clip(0)] = False  # these read on into the next text
    return out.astype(np.float32)


def responses(tables: np.ndarray, repeats: np.ndarray, bias: np.ndarray, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Filter responses at each place where a whole filter fits."""
    n = len(data) - WIDTH + 1
    out = np.take(tables[0], data[:n], axis=0)
    for place in range(1, WIDTH):
        out += np.take(tables[place], data[place : place + n], axis=0)
    marked = np.flatnonzero(np.convolve(marks, np.ones(WIDTH), "full")[WIDTH - 1 : WIDTH - 1 + n] > 0.5) if marks.any() else ()
    if len(marked):
        for place in range(WIDTH):
            out[marked] += marks[marked + place, None] * repeats[place]
    return out + bias


def chunk_logits(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean chunk logit of each text."""
    laid, edges, lengths = laid_out(data, offsets)
    logits = np.full(len(lengths), net.prior)
    if edges[-1] == 0:
        return logits
    marks = repeated_marks(laid, edges)
    closing = np.zeros(edges[-1], bool)
    closing[edges[1:][np.diff(edges) > 0] - 1] = True
    pooled = np.empty((edges[-1], FILTERS), np.float32)
    step = 256
    for low in range(0, edges[-1], step):
        high = min(edges[-1], low + step)
        part = slice(low * BLOCK, high * BLOCK + WIDTH - 1)
        found = responses(net.tables, net.repeats, net.bias, laid[part], marks[part])
        found = found.reshape(high - low, BLOCK, FILTERS)
        found[closing[low:high], BLOCK - WIDTH + 1 :] = -np.inf  # these filters read on into the next text
        pooled[low:high] = found.max(axis=1)
    text = np.repeat(np.arange(len(lengths)), np.diff(edges))
    follows = np.flatnonzero(text[1:] == text[:-1])
    owner = text[follows]
    value = np.maximum(np.maximum(pooled[follows], pooled[follows + 1]), 0) @ net.out + net.out_bias
    n = np.bincount(owner, minlength=len(lengths))
    total = np.bincount(owner, value, minlength=len(lengths))
    logits[n > 0] = total[n > 0] / n[n > 0]
    return logits


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chunks_of(text: str, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, repeat marks) of at most `SAMPLE_CHUNKS` chunks of the whole text, a row for each."""
    data = np.frombuffer(text.encode(), np.uint8)
    laid, edges, _ = laid_out(data, np.array([0, len(data)]))
    n = max(int(edges[-1]) - 1, 0)
    chosen = np.arange(n)
    if n > SAMPLE_CHUNKS:
        chosen = np.sort(np.random.default_rng(seed & (2**63 - 1)).choice(n, SAMPLE_CHUNKS, replace=False))
    at = chosen[:, None] * BLOCK + np.arange(CHUNK)
    return laid[at], repeated_marks(laid, edges)[at].astype(np.uint8) if n else np.zeros((0, CHUNK), np.uint8)


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """Train on whole texts and their 0/1 labels."""
    return train([chunks_of(t, i) for i, t in enumerate(texts)], labels)


def train(chunks: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Network:
    """Train on the chunks of each text and the texts' 0/1 labels."""
    rng = np.random.default_rng(11)
    share = float(labels.mean()) if len(labels) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    byte = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
    weight = rng.normal(0, 0.4, (WIDTH, DEPTH, FILTERS)).astype(np.float32)
    repeats = rng.normal(0, 0.2, (WIDTH, FILTERS)).astype(np.float32)
    bias = np.zeros(FILTERS, np.float32)
    out = np.zeros(FILTERS, np.float32)
    out_bias = np.array([prior], np.float32)
    params = [byte, weight, repeats, bias, out, out_bias]
    owner = np.repeat(np.arange(len(chunks)), [len(x) for x, _ in chunks])
    if not len(owner) or share in (0.0, 1.0):
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), repeats * 0, bias, out, prior, prior)
    data, marks = (np.concatenate([c[i] for c in chunks]) for i in (0, 1))
    target = labels[owner].astype(np.float32)
    per_text = np.bincount(owner)[owner]
    odds = 1 / per_text / np.where(target > 0, share, 1 - share)
    odds /= odds.sum()
    importance = np.where(target > 0, share, 1 - share).astype(np.float32) * 2
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        chosen = rng.choice(len(owner), BATCH, p=odds)
        x, m = data[chosen], marks[chosen].astype(np.float32)
        tables = np.einsum("bd,kdf->kbf", byte, weight)
        z = np.zeros((BATCH, 2 * BLOCK, FILTERS), np.float32) + bias
        for k in range(WIDTH):
            z += tables[k][x[:, k : k + 2 * BLOCK]] + m[:, k : k + 2 * BLOCK, None] * repeats[k]
        best = z.argmax(axis=1)
        top = np.take_along_axis(z, best[:, None], 1)[:, 0]
        hidden = np.maximum(top, 0)
        p = _sigmoid(hidden @ out + out_bias)
        slope = ((p - target[chosen]) * importance[chosen] / BATCH).astype(np.float32)
        back = slope[:, None] * out * (top > 0)
        g_tables = np.zeros_like(tables)
        g_repeats = np.zeros_like(repeats)
        rows, columns = np.arange(BATCH)[:, None], np.arange(FILTERS)[None, :]
        for k in range(WIDTH):
            np.add.at(g_tables[k], (x[rows, best + k], columns), back)
            g_repeats[k] = (back * m[rows, best + k]).sum(0)
        grads = [
            np.einsum("kbf,kdf->bd", g_tables, weight),
            np.einsum("bd,kbf->kdf", byte, g_tables),
            g_repeats,
            back.sum(0),
            slope @ hidden,
            np.array([slope.sum()], np.float32),
        ]
        for i, g in enumerate(grads):
            g = g + 1e-5 * params[i]
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            params[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    tables = np.einsum("bd,kdf->kbf", byte, weight)
    return Network(tables, repeats, bias, out, float(out_bias[0]), prior)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int) -> tuple[list, np.ndarray]:
    """Chunks of at most `SAMPLE_ROWS` labelled rows that are not held out, and the rows' labels."""
    ids = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_label"))
    ids = ids.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id", folds))
    ids = ids.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [chunks_of(t.as_py(), i) for i, t in zip(batch.column(0).to_pylist(), filled(batch.column(2)))]
            both = [pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *both], names=["id", "label", "data", "marks"])

    rows = (
        docs.select(docs[id_col].cast("long").alias("_doc"), docs[text_col].alias("_text"))
        .join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
        .where(F.length("_text") > 0)
        .select("_id", "_label", "_text")
        .mapInArrow(cut, "id long, label int, data binary, marks binary")
        .groupBy("id", "label")
        .agg(F.min(F.struct("data", "marks")).alias("chunks"))
        .orderBy("id")
        .select("label", "chunks.*")
        .collect()
    )
    shaped = lambda raw: np.frombuffer(raw, np.uint8).reshape(-1, CHUNK)
    return [(shaped(r["data"]), shaped(r["marks"])) for r in rows], np.array([r["label"] for r in rows], int)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunk_logits(net, data, offsets) for _, _, data, offsets in text_slices(batch.column(2), SLICE)]
            values = _sigmoid(np.concatenate(parts)) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "held_out", "score"])

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held_out(id_col, folds).alias("held_out"), docs[text_col].alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    folds: int = FOLDS,
) -> DataFrame:
    """Train on a bounded sample of labelled rows and score all rows."""
    net = train(*sample(docs, labels, id_col, text_col, label_col, folds))
    return score(docs, net, id_col, text_col, folds).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
