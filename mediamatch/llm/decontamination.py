"""Benchmark decontamination by spaced-seed hashing.

Fixed masks read the words at some offsets of a window and ignore the others, so a substituted word spoils
only the windows that read it. Training windows and benchmark windows join on the hash of the words read;
at every hit the item is laid over the text and compared word by word. The share of its words that stand at their
place is the overlap; the best place of an item in a document counts, and one of `SIMILARITY` or more is a leak.
The masks meet every placement of the substitutions that leave `SIMILARITY` of an item: a test goes through
them all from 9 to 17 words, and a longer item is a row of such pieces, one of which has no more than its share.
An item shorter than a window has masks of its own, which leave out each choice of words that may differ.

The benchmark is the small side: its seeds are counted and broadcast up to a bound, and training words stay inside
one pass over the scan. Beyond the bound the join shuffles hashes with the place of their window, and the words join
what was hit. Only verified hits leave the last pass. Long texts are read
in overlapping parts, so that what is held for a text full of leaks is bounded. Column functions only.

Defined results: words are runs of letters and digits, lower-cased; null and empty texts match nothing; an
item of any length is looked for by the same rule, one of up to four words as it stands; items of equal text
match alike; of several texts of one item id the one found best counts; a repeated row changes nothing; an empty table
gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.llm.frames import unused

#: Word offsets that each mask reads.
MASKS = ((0, 1, 2, 5, 8), (0, 1, 3, 6, 8), (0, 2, 3, 5, 6), (3, 4, 6, 7, 8))
WINDOW = max(o for mask in MASKS for o in mask) + 1
SIMILARITY = 0.8
#: Words of a text that are read at once; parts overlap by the longest item, so every item lies in one wholly.
PART_WORDS = 2048
#: Most benchmark seeds that are broadcast, about 100 MB.
BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def masks_of(span: int, similarity: float = SIMILARITY) -> Sequence[tuple[int, ...]]:
    """The masks of a window of `span` words; below `WINDOW` such a window is a whole item."""
    return MASKS if span >= WINDOW else list(combinations(range(span), math.ceil(similarity * span - 1e-9)))


def _seeds(rows: DataFrame, words: str, span: Column, spans: Sequence[int], similarity: float) -> DataFrame:
    """The rows once for each window of `span` words and mask, with the window's position and the hash of the words
    read; `spans` are the values that the column has."""
    offsets = sorted({o for s in spans for mask in masks_of(s, similarity) for o in mask})
    spanned = rows.select("*", span.alias("span"))
    count = F.greatest(F.size(words) - (F.col("span") - 1), F.lit(0))
    read = [F.slice(words, o + 1, count).alias(f"w{o}") for o in offsets]
    windows = spanned.select("*", F.posexplode(F.arrays_zip(*read)).alias("at", "w"))
    by_span = [
        F.array(*(F.xxhash64(F.lit(s << 8 | k), *(F.col(f"w.w{o}") for o in mask)) for k, mask in enumerate(masks_of(s, similarity))))
        for s in spans
    ]
    hashes = by_span[0]
    for s, own in zip(spans[1:], by_span[1:]):
        hashes = F.when(F.col("span") == s, own).otherwise(hashes)
    return windows.select(*rows.columns, "at", F.explode(hashes).alias("seed"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    mark: bool = False,
) -> DataFrame:
    """(doc_id, item_id, matched, item_words, similarity) of every leaked item; `mark` adds the hash of the text."""
    items = benchmark.select(benchmark[item_col].alias("item_id"), words_of(benchmark[item_text_col]).alias("item"))
    items = items.where(F.size("item") > 0).distinct().withColumn("n", F.size("item")).withColumn("item_key", F.xxhash64("item"))
    item_span = F.least("n", F.lit(WINDOW))
    spans = sorted(r[0] for r in items.select(item_span).distinct().collect()) or [WINDOW]
    item_seeds = _seeds(items, "item", item_span, spans, similarity)
    size = item_seeds.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    seeds = item_seeds.select("seed", "item_id", "item_key", F.col("at").alias("item_at")).distinct()
    texts = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), words_of(docs[text_col]).alias("words")
    )
    last = F.greatest(F.size("words") - 1, F.lit(0)) / PART_WORDS
    pieces = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.slice("words", k * PART_WORDS + 1, PART_WORDS + size[1]))
    parts = texts.select("doc_id", "text_hash", F.posexplode(pieces).alias("part", "words"))
    text_span = F.lit(spans[0]) if len(spans) == 1 else F.explode(F.array(*map(F.lit, spans)))
    windows = _seeds(parts, "words", text_span, spans, similarity)
    if size[0] <= BROADCAST_SEEDS:
        hits = windows.join(F.broadcast(seeds), "seed")
        items = F.broadcast(items)
    else:
        places = windows.select("doc_id", "text_hash", "part", "at", "seed").join(seeds, "seed").drop("seed").distinct()
        own = parts.select(*(F.col(c).alias(f"own_{c}") for c in ("doc_id", "text_hash", "part")), "words").dropDuplicates(
            ["own_doc_id", "own_text_hash", "own_part"]
        )
        same = [places[c].eqNullSafe(own[f"own_{c}"]) for c in ("doc_id", "text_hash", "part")]
        hits = places.join(own, same)
    names = ["doc_id", *(["text_hash"] if mark else [])]
    begin = F.col("at") - F.col("item_at")
    # words of the item that hang over the front have no place in the text
    stands = F.transform("item", lambda w, i: (begin + i >= 0) & F.coalesce(F.get("words", F.greatest(begin + i, F.lit(0))) == w, F.lit(False)))
    matched = F.size(F.filter(stands, lambda x: x))
    return (
        hits.join(items, ["item_id", "item_key"])
        .select(*names, "item_id", matched.alias("matched"), F.col("n").alias("item_words"))
        .withColumn("similarity", F.col("matched") / F.col("item_words"))
        .where(F.col("similarity") >= similarity)
        .groupBy(*names, "item_id")
        .agg(F.max(F.struct("similarity", "matched", "item_words")).alias("best"))
        .select(*names, "item_id", "best.matched", "best.item_words", "best.similarity")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, columns unchanged, that leak no benchmark item."""
    own_id, own_hash = unused(docs, "leak_id"), unused(docs, "leak_hash")
    found = leaks(docs, benchmark, id_col, text_col, mark=True)
    found = found.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(found[own_id]) & (F.xxhash64(docs[text_col]) == found[own_hash])
    return docs.join(found, same, "left_anti")
