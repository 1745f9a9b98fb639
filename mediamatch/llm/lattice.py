"""Language-model scoring by the marginal likelihood of a subword lattice.

An existing byte-level vocabulary names the pieces and orders them by weight. Every word, with the space
before it, is the sum over all its segmentations into pieces, computed by a forward recursion in log space;
the probability of a document is the product over its words and one end. The piece scores start from the
vocabulary's order, and expectation-maximisation over the counts of all training words fits them.

A text's score is a sum over words, so the lattice runs once for each distinct word of a block of documents
met in word order, not for each token. Word counts are summed within tasks before they are shuffled; the
word table grows with the corpus and never leaves the executors. Documents are dealt to blocks; a block
asks for its distinct words, the answers come back to it, and no row is made for a single token. What
reaches the driver is one number for each piece of the vocabulary, and totals.

Defined results: a null or empty text is one end; with no training rows every base term is 0 and piece
scores keep the vocabulary's order; rows of null id train; repeated rows count and are scored again; a word
of any length has a finite score, as all bytes are pieces; an empty table gives no row.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import filled, held_out, partitions_of

FOLDS = 10
SMOOTHING = 0.1
ROUNDS = 2
PIECE_SMOOTHING = 0.01
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 20
#: Words whose lattices are computed at once.
WORDS_AT_ONCE = 1 << 16
BLOCK_TOKENS = 4_000_000
#: Stands for the end of a document among the words; no word holds a line feed.
END = "\n"
_BASE = np.uint64(0x9E3779B97F4A7C15)
LOG10 = float(np.log(10))


@lru_cache(maxsize=2)
def vocabulary(ranks: str) -> list[bytes]:
    """All pieces in the vocabulary's own order."""
    import public_tokenizers

    with open(public_tokenizers.path(ranks), "rb") as file:
        table = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, file))
    return [piece for _, piece in table]


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)


def _prefix_hashes(letters: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, ... letters of each row."""
    out = np.zeros((letters.shape[1] + 1, letters.shape[0]), np.uint64)
    for i in range(letters.shape[1]):
        out[i + 1] = out[i] * _BASE + letters[:, i] + np.uint64(1)
    return out


@dataclass(frozen=True)
class Pieces:
    """Pieces of each length, in order of length, as sorted hashes with their numbers."""

    hashes: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    size: int

    @staticmethod
    def of(pieces: list[bytes]) -> Pieces:
        hashes, numbers = {}, {}
        lengths = np.array([len(p) for p in pieces])
        for length in np.unique(lengths).tolist():
            chosen = np.flatnonzero(lengths == length)
            letters = np.frombuffer(b"".join(pieces[i] for i in chosen), np.uint8).reshape(-1, length)
            h = _prefix_hashes(letters)[-1]
            order = np.argsort(h)
            hashes[length], numbers[length] = h[order], chosen[order]
        return Pieces(hashes, numbers, len(pieces))


def _edges(pieces: Pieces, letters: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, piece numbers) of every piece found in equally long words, by end."""
    length = letters.shape[1]
    prefix, powers = _prefix_hashes(letters), _powers(max(pieces.hashes))
    out = []
    for end in range(1, length + 1):
        for size, known in pieces.hashes.items():
            if size > end:
                break
            h = prefix[end] - prefix[end - size] * powers[size]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            rows = np.flatnonzero(known[at] == h)
            if len(rows):
                out.append((end - size, end, rows, pieces.numbers[size][at[rows]]))
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, letters with a space before each word) of words of one length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True]) if len(words) else np.zeros(1, int)
    for first, end in zip(edges[:-1], edges[1:]):
        index = order[first:end]
        text = b"".join(words[i] for i in index)
        letters = np.frombuffer(text, np.uint8).reshape(len(index), -1)
        yield index, np.concatenate([np.full((len(index), 1), 0x20, np.uint8), letters], axis=1)


def _forward(edges: list, n: int, length: int, weight: np.ndarray) -> np.ndarray:
    ahead = np.full((length + 1, n), -np.inf)
    ahead[0] = 0
    for start, end, rows, numbers in edges:
        ahead[end, rows] = np.logaddexp(ahead[end, rows], ahead[start, rows] + weight[numbers])
    return ahead


def log_marginals(pieces: Pieces, weight: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of the summed weight of all segmentations of each word."""
    out = np.zeros(len(words))
    for index, letters in _by_length(words):
        edges = _edges(pieces, letters)
        out[index] = _forward(edges, len(index), letters.shape[1], weight)[-1]
    return out


def expected_counts(pieces: Pieces, weight: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used over all segmentations, by their posterior weight."""
    out = np.zeros(pieces.size)
    for index, letters in _by_length(words):
        length = letters.shape[1]
        edges = _edges(pieces, letters)
        ahead = _forward(edges, len(index), length, weight)
        behind = np.full((length + 1, len(index)), -np.inf)
        behind[length] = 0
        for start, end, rows, numbers in reversed(edges):
            step = behind[end, rows] + weight[numbers]
            behind[start, rows] = np.logaddexp(behind[start, rows], step)
            used = np.exp(ahead[start, rows] + step - ahead[length, rows]) * counts[index[rows]]
            out += np.bincount(numbers, used, minlength=pieces.size)
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows, with `END` once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in filled(batch.column(0)):
                counts.update(text.as_py().encode().lower().split())
                counts[END.encode()] += 1
                if len(counts) >= HELD_WORDS:
                    yield handed()
                    counts.clear()
        if counts:
            yield handed()

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to about `WORDS_AT_ONCE` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Model:
    ranks: str
    weight: np.ndarray  # natural log of each piece's probability
    end: float  # log10 probability of an end


def fit(words: DataFrame, ends: int, ranks: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from the counts of all training words."""
    size = len(vocabulary(ranks))
    share = 1 / (np.arange(size) + 1.0)
    share /= share.sum()
    total = 0.0
    for _ in range(rounds):
        weight = np.log(share)

        def run(batches: Iterator[pa.RecordBatch], weight: np.ndarray = weight) -> Iterator[pa.RecordBatch]:
            pieces, used = Pieces.of(vocabulary(ranks)), np.zeros(size)
            for table in _gathered(batches):
                found = table.column(0).cast(pa.binary()).to_pylist()
                used += expected_counts(pieces, weight, found, table.column(1).to_numpy().astype(float))
            number = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(used[number])], names=["piece", "n"])

        rows = words.where(F.col("word") != END).select("word", "n").mapInArrow(run, "piece int, n double")
        got = rows.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        used = np.zeros(size)
        used[got["piece"]] = got["n"]
        total = used.sum()
        share = (used + PIECE_SMOOTHING) / (total + PIECE_SMOOTHING * size)
    stop = (ends + PIECE_SMOOTHING) / (total + ends + 2 * PIECE_SMOOTHING)
    return Model(ranks, np.log(share) + np.log1p(-stop), float(np.log10(stop)))


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = "byte_bpe_50k.tiktoken",
    folds: int = FOLDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: fold, token counts, word-unigram baseline and lattice score, in log10."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held_out(id_col, folds).alias("held_out"), docs[text_col].alias("text")
    )
    words = word_counts(rows.where(~F.col("held_out"))).persist(StorageLevel.DISK_ONLY)
    totals = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))
    ).first()
    tokens, distinct, ends = (int(x) for x in totals)
    model = fit(words, ends, ranks, rounds)
    base_end = float(np.log10(ends + SMOOTHING))
    base_all = float(np.log10(tokens + SMOOTHING * (distinct + 1)))

    blocks = max(partitions_of(docs), tokens // BLOCK_TOKENS)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select("doc_id", "held_out", "text", block).repartition(blocks, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, set[bytes]] = {}
        for batch in batches:
            for number, text in zip(batch.column(3).to_pylist(), filled(batch.column(2))):
                asked.setdefault(number, set()).update(text.as_py().encode().lower().split())
        for number, found in asked.items():
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number, np.int32)), words], names=["block", "word"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(vocabulary(ranks))
        for table in _gathered(batches):
            coded = table.column(1).combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            found = coded.dictionary.cast(pa.binary()).to_pylist()
            marginal = log_marginals(pieces, model.weight, found) / LOG10
            at = coded.indices.to_numpy()
            base = np.log10(table.column(2).to_numpy() + SMOOTHING)
            yield from pa.table(
                {"block": table.column(0), "mark": pa.array(_marks(found)[at]), "base": pa.array(base), "marginal": pa.array(marginal[at])}
            ).to_batches(1 << 16)

    # All columns, as in the join below, so that both read one shuffle of the texts.
    asked = dealt.mapInArrow(ask, "block int, word string")
    counted = asked.join(words, "word", "left").select("block", "word", F.coalesce("n", F.lit(0)).alias("n"))
    answers = counted.mapInArrow(answer, "block int, mark long, base double, marginal double")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        marks = right.column("mark").to_numpy()
        order = np.argsort(marks)
        marks, base, marginal = marks[order], right.column("base").to_numpy()[order], right.column("marginal").to_numpy()[order]
        index: dict[bytes, int] = {}
        texts = [t.as_py().encode().lower().split() for t in filled(left.column("text").combine_chunks())]
        numbers = [np.fromiter((index.setdefault(w, len(index)) for w in t), np.int64, len(t)) for t in texts]
        at = np.searchsorted(marks, _marks(list(index)))
        base, marginal = base[at], marginal[at]
        known = base > np.log10(SMOOTHING)
        n = np.array([len(t) + 1 for t in texts])
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array(n),
                "n_known": pa.array([int(known[x].sum()) + (ends > 0) for x in numbers], pa.int64()),
                "train_tokens": pa.array(np.full(len(n), tokens)),
                "base_score": pa.array(np.array([float(base[x].sum()) for x in numbers]) + base_end - n * base_all),
                "score": pa.array(np.array([float(marginal[x].sum()) for x in numbers]) + model.end),
            }
        )

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        add_up,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _marks(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)
