"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams of each language. A document is seen as a mixture of languages:
expectation-maximisation estimates the proportions from the trigram likelihoods, and the language set is
the one with the best penalised likelihood among the nested sets of its largest proportions.

Training sums counts over all rows; what reaches the driver is one number for each language and trigram
slot, whatever the corpus size. Prediction is a narrow map.

Defined results: a text that is null or has no letter gives `und` with score 0; rows of null language do
not train; with no training rows at all every document is `und`; equal proportions go to the language
that comes first in alphabetical order; repeated rows are predicted alike; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mediamatch.llm.frames import filled, held_out, text_slices

SLOTS = 1 << 15
FOLDS = 5
ROUNDS = 10
SMOOTHING = 0.5
#: Likelihood that one more language must gain, in units of log(number of trigrams).
PENALTY = 3.0
#: Three trigrams overlap each byte, so a third of them counts as independent evidence.
OVERLAP = 3.0
UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>"
_SPACE = 0x20
_CLASSES = np.full(256, _SPACE, np.uint32)
_CLASSES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASSES[128:] = np.arange(128, 256)


def gram_slots(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram slot at each byte of lower-cased texts, -1 where none begins."""
    c = _CLASSES[data]
    slots = np.full(len(c), -1, np.int64)
    if len(c) > 2:
        key = (c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)
        slots[:-2] = key >> np.uint32(17)
        blank = c == _SPACE
        slots[:-2][blank[1:-1] & (blank[:-2] | blank[2:])] = -1
    for back in (1, 2):
        at = offsets[1:] - back
        slots[at[at >= 0]] = -1
    return slots


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    likelihood: np.ndarray  # slot x language


def _counts_by_language(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, end, data, offsets in text_slices(pc.utf8_lower(filled(batch.column(0)))):
                slots = gram_slots(data, offsets)
                for row in range(first, end):
                    own = slots[offsets[row - first] : offsets[row - first + 1]]
                    if langs[row] not in tables:
                        tables[langs[row]] = np.zeros(SLOTS + 1, np.int64)
                    tables[langs[row]] += np.bincount(own + 1, minlength=SLOTS + 1)
        for lang, table in tables.items():
            seen = np.flatnonzero(table[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(table[1:][seen])],
                names=["lang", "slot", "n"],
            )

    pairs = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    return (
        pairs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .mapInArrow(run, "lang string, slot int, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram likelihoods of each language, from all given rows."""
    rows = _counts_by_language(docs, text_col, lang_col).toPandas()
    langs = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((SLOTS, len(langs)))
    counts[rows["slot"], [langs.index(x) for x in rows["lang"]]] = rows["n"]
    smooth = counts + SMOOTHING
    return Model(langs, smooth / smooth.sum(axis=0, keepdims=True) if langs else smooth)


def mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood after so many rounds of expectation-maximisation."""
    n = counts.sum()
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(rounds):
        mixed = likelihood @ share
        share = share * ((counts / mixed) @ likelihood) / n
    return share, float(counts @ np.log(likelihood @ share))


def select_languages(likelihood: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of each language, zero outside the set of best penalised likelihood."""
    n, known = counts.sum(), likelihood.shape[1]
    price = PENALTY * np.log(max(n, 2)) * OVERLAP
    alone = counts @ np.log(likelihood)
    best = int(np.argmax(alone))
    share = np.zeros(known)
    share[best] = 1
    if known == 1:
        return share
    full, most = mixture(likelihood, counts)
    if most - alone[best] <= price:  # no smaller set can gain more than all languages together
        return share
    value, order = alone[best], np.argsort(-full, kind="stable")
    for k in range(2, known + 1):
        own, reached = mixture(likelihood[:, order[:k]], counts, 2 * ROUNDS)
        if reached - price * (k - 1) > value:
            value, share = reached - price * (k - 1), np.zeros(known)
            share[order[:k]] = own
        if most - price * k <= value:
            break
    return share


def _judge(texts: pa.Array, model: Model) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, its share, languages, shares) of each text; no text may be null."""
    langs = np.array(model.langs, object)
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    found: list[tuple] = []
    for first, end, data, offsets in text_slices(pc.utf8_lower(texts)):
        slots = gram_slots(data, offsets)
        for row in range(first, end):
            if not lettered[row] or not len(langs):
                found.append((UNDETERMINED, 0.0, [], []))
                continue
            own = slots[offsets[row - first] : offsets[row - first + 1]]
            table = np.bincount(own + 1, minlength=SLOTS + 1)[1:]
            seen = np.flatnonzero(table)
            if len(seen):
                share = select_languages(model.likelihood[seen], table[seen].astype(float))
            else:
                share = np.full(len(langs), 1 / len(langs))
            order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
            found.append((langs[order[0]], min(1.0, float(share[order[0]])), list(langs[order]), share[order].tolist()))
    return found


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """Predicted language, its share and the whole language set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
        for batch in batches:
            columns = list(zip(*_judge(filled(batch.column(2)), model))) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "held_out", "lang_pred", "score", "langs", "shares"],
            )

    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), held_out(id_col, folds).alias("held_out"), docs[text_col].alias("text")
    ).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, columns unchanged, in which one language has a share of at least `least`."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judge(filled(batch.column(at)), model)
            yield batch.filter(pa.array([lang != UNDETERMINED and share >= least for lang, share, _, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS
) -> DataFrame:
    """Train on the rows that are not held out and predict all rows."""
    return predict(docs, fit(docs.where(~held_out(id_col, folds)), text_col, lang_col), id_col, text_col, folds)
