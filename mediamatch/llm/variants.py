"""Spelling variants: words of a vocabulary that one edit turns into each other, and the form each belongs to.

Near words are what the composition V o T o V accepts: V is the minimised acceptor of the vocabulary, T a transducer that
inserts, deletes or replaces exactly one code point. V is cut by initial states: the words that share their first `START`
code points are the words of one state of V after `START` symbols, and an edit behind them stays below that state. Other
edits leave the last code points alone, so the reversed words are cut the same way and give the pairs whose first `START`
code points differ. Words of at least 2 * START + 1 code points lose no pair.

A task takes blocks of whole initial states. The acceptor of a block is a trie whose nodes of equal right language are one
state. Before the edit both acceptors are in one state, as they are deterministic; after it they read the same symbols. So
the composition starts with pairs of states one edit apart, follows common symbols, drops pairs from which no common end is
reached, and enumerates the rest: paths to a state, times edits, times common ends. A word is named by its rank, the sum of
the words that its path passes by. All of this are array operations over whole blocks.

An initial state of more than `CROWDED` words is cut again by one more symbol. Edits just at that symbol leave equal rests,
which meet in a join; a rest has at most one word for each symbol of the alphabet. This goes on until none is crowded.

Defined results: a null text has no words; a null id reads as `null`; a word of any length is read whole; rows that repeat
an id count each; an empty table gives no row; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.llm.frames import filled, partitions_of
from mediamatch.session import checkpointed

#: Least code points of a word, least occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: One in so many runs has a code point deleted.
SPOILED = 31
START = 3
BLOCK_WORDS = 1 << 15
CROWDED = 1 << 17
#: Words that a task counts before it passes them on.
HELD_WORDS = 1 << 18
_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the spoiled runs; a word comes again after `HELD_WORDS` others."""
    counts: Counter[str] = Counter()

    def done() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), filled(batch.column(1))):
            prefix = zlib.crc32(b"null:" if doc is None else b"%d:" % doc)
            for run, n in Counter(_RUN.findall(text.as_py().encode().lower().decode())).items():
                h = zlib.crc32(run.encode(), prefix)
                if h % SPOILED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                counts[run] += n
            if len(counts) >= HELD_WORDS:
                yield done()
    if counts:
        yield done()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts after one run in `SPOILED` has lost a code point."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    counted = rows.mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of the ranges first..first + counts."""
    which = np.repeat(np.arange(len(first)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]


class Acceptor:
    """Minimised acceptor of sorted, distinct words, and the trie it was made of.

    Nodes are numbered by depth, so children of a node are consecutive. `state` names the state of a node; edges of state s
    are `edge_first[s]` and the `edge_count[s] - 1` behind it, with `symbol`, `target` and `skip`, the words of s before
    those that go through the edge. `size` is the number of words that a state accepts.
    """

    def __init__(self, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        node, active = np.zeros(len(words), np.int64), np.arange(len(words))
        parents, symbols, lows, ends, self.levels, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [0], 1
        depth = 0
        while len(active):
            own = codes[begin[active] + depth]
            above = node[active]
            new = np.r_[True, (above[1:] != above[:-1]) | (own[1:] != own[:-1])]
            node[active] = count - 1 + np.cumsum(new)
            parents.append(above[new])
            symbols.append(own[new])
            lows.append(active[new])
            self.levels.append(count)
            count += int(new.sum())
            depth += 1
            ended = sizes[active] == depth
            ends.append(node[active[ended]])
            active = active[~ended]
        self.levels.append(count)
        self.parent, self.node_symbol, self.low = (np.concatenate(x) for x in (parents, symbols, lows))
        final = np.zeros(count, bool)
        final[np.concatenate(ends)] = True
        self.child_count = np.bincount(self.parent[1:], minlength=count)
        self.child_first = 1 + np.cumsum(self.child_count) - self.child_count
        self._merge(final)

    def _merge(self, final: np.ndarray) -> None:
        """Nodes of equal right language become one state."""
        accepted, masks, heights = final.astype(np.int64), final.astype(np.uint64), np.zeros(len(final), np.int64)
        seed = np.uint64(1)
        marks = [_mixed(final.astype(np.uint64) + seed * np.uint64(k)) for k in (3, 5)]
        for first, last in zip(self.levels[-2:0:-1], self.levels[:0:-1]):
            up = self.parent[first:last]
            begin = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            own = slice(first, last)
            symbol = self.node_symbol[own].astype(np.uint64)
            for k, mark in enumerate(marks):
                mark[up[begin]] += np.add.reduceat(_mixed(mark[own] * np.uint64(2 * k + 3) + _mixed(symbol + np.uint64(k))), begin)
            accepted[up[begin]] += np.add.reduceat(accepted[own], begin)
            turned = (masks[own] << np.uint64(1)) | (masks[own] >> np.uint64(63))
            masks[up[begin]] |= np.bitwise_or.reduceat(turned, begin)
            heights[up[begin]] = np.maximum.reduceat(heights[own], begin) + 1
        _, chosen, self.state = np.unique(marks[0], return_index=True, return_inverse=True)
        if (marks[1] != marks[1][chosen][self.state]).any():
            # two right languages of one mark: tell them apart by both
            both = np.stack(marks, axis=1)
            _, chosen, self.state = np.unique(both, axis=0, return_index=True, return_inverse=True)
            self.state = self.state.ravel()
        self.final, self.size, self.mask, self.height = final[chosen], accepted[chosen], masks[chosen], heights[chosen]
        self.edge_count = self.child_count[chosen]
        self.edge_first = np.cumsum(self.edge_count) - self.edge_count
        self.source, child = _ranges(self.child_first[chosen], self.edge_count)
        self.symbol, self.target = self.node_symbol[child], self.state[child]
        through = self.size[self.target]
        before = np.cumsum(through) - through
        self.skip = self.final[self.source] + before - before[self.edge_first[self.source]] if len(through) else through
        # the codes that occur, so that an edge's key stays small
        self.alphabet, code = np.unique(self.symbol, return_inverse=True)
        self.edge_key = self.source * max(1, len(self.alphabet)) + code
        self.code = code

    def common_edges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which pair, edge of left, edge of right) for all symbols that both states of a pair read."""
        which, edge = _ranges(self.edge_first[left], self.edge_count[left])
        wanted = right[which] * max(1, len(self.alphabet)) + self.code[edge]
        at = np.minimum(np.searchsorted(self.edge_key, wanted), len(self.edge_key) - 1) if len(self.edge_key) else np.zeros(0, np.int64)
        met = self.edge_key[at] == wanted if len(at) else np.zeros(0, bool)
        return which[met], edge[met], at[met]


def _edits(a: Acceptor, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, edge, other edge) of the edits at each state: two edges for a replaced symbol, -1 for none."""
    which, edge = _ranges(a.edge_first[states], a.edge_count[states])
    last = (a.edge_first + a.edge_count)[states][which]
    first, other = _ranges(edge + 1, last - edge - 1)
    at = states[which]
    return np.r_[at, at[first]], np.r_[edge, edge[first]], np.r_[np.full(len(edge), -1), other]


def _sides(a: Acceptor, at: np.ndarray, edge: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return a.target[edge], np.where(other < 0, at, a.target[other])


def _accepted(a: Acceptor, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sorted keys left * states + right of all pairs reached from the given ones that accept a common end; pairs of one
    state are not among them, they accept all that the state does."""
    n = len(a.final)

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x != y) & ((a.mask[x] & a.mask[y]) != 0)

    known = np.zeros(0, np.int64)
    ok = possible(left, right)
    fresh = np.unique(left[ok] * n + right[ok])
    froms, tos, good = [], [], []
    while len(fresh):
        known = np.union1d(known, fresh)
        x, y = fresh // n, fresh % n
        good.append(fresh[a.final[x] & a.final[y]])
        which, e, f = a.common_edges(x, y)
        to_x, to_y = a.target[e], a.target[f]
        good.append(fresh[which[to_x == to_y]])
        ok = possible(to_x, to_y)
        to = to_x[ok] * n + to_y[ok]
        froms.append(fresh[which[ok]])
        tos.append(to)
        to = np.unique(to)
        fresh = to[~np.isin(to, known, assume_unique=True)]
    alive = np.zeros(len(known), bool)
    if not len(known):
        return known
    alive[np.searchsorted(known, np.concatenate(good))] = True
    src, dst = np.searchsorted(known, np.concatenate(froms)), np.searchsorted(known, np.concatenate(tos))
    height = a.height[known // n] + a.height[known % n]
    order = np.argsort(height[src], kind="stable")
    src, dst = src[order], dst[order]
    begin = np.flatnonzero(np.r_[True, np.diff(height[src]) != 0]) if len(src) else src
    for low, high in zip(begin, np.r_[begin[1:], len(src)]):  # symbols only lead to lower states
        alive[src[low:high][alive[dst[low:high]]]] = True
    return known[alive]


def composed(words: list[str], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (left < right) of all pairs of the sorted, distinct words that one edit behind the first `start` code points
    turns into each other."""
    a = Acceptor(words)
    n = len(a.final)
    if start + 1 >= len(a.levels):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes = np.arange(a.levels[start], a.levels[-1])
    states = np.unique(a.state[nodes])
    at, edge, other = _edits(a, states)
    left, right = _sides(a, at, edge, other)
    pairs = _accepted(a, left, right)

    def lives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * n + y
        place = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
        return (x == y) | (pairs[place] == key if len(pairs) else False)

    ok = lives(left, right)
    order = np.argsort(at[ok], kind="stable")
    at, edge, other = at[ok][order], edge[ok][order], other[ok][order]
    # paths to a state: its nodes, each with all edits of the state
    first = np.searchsorted(at, a.state[nodes], "left")
    path, edit = _ranges(first, np.searchsorted(at, a.state[nodes], "right") - first)
    base = a.low[nodes[path]]
    x, y = _sides(a, at[edit], edge[edit], other[edit])
    u = base + a.skip[edge[edit]]
    v = base + np.where(other[edit] < 0, 0, a.skip[other[edit]])
    lefts, rights = [], []
    while len(u):
        same = x == y
        which, rank = _ranges(np.zeros(int(same.sum()), np.int64), a.size[x[same]])
        lefts.append(u[same][which] + rank)
        rights.append(v[same][which] + rank)
        u, v, x, y = (z[~same] for z in (u, v, x, y))
        both = a.final[x] & a.final[y]
        lefts.append(u[both])
        rights.append(v[both])
        which, e, f = a.common_edges(x, y)
        ok = lives(a.target[e], a.target[f])
        which, e, f = which[ok], e[ok], f[ok]
        u, v, x, y = u[which] + a.skip[e], v[which] + a.skip[f], a.target[e], a.target[f]
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.stack([np.concatenate(lefts), np.concatenate(rights)])
    # a deletion from a run of one symbol has several alignments
    key = np.unique(ends.min(axis=0) * len(words) + ends.max(axis=0))
    return key // len(words), key % len(words)


_PAIRS = "word string, n long, near string, near_n long"


def _compose(batches: Iterator[pa.RecordBatch], start: int, block: int) -> Iterator[pa.RecordBatch]:
    """Near pairs, in both orders, of words by (side, key, word); words of side 1 are reversed."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        for reverse in (0, 1):
            own = table.filter(pa.array(side == reverse))
            if not own.num_rows:
                continue
            words, n = own.column("word").to_pylist(), own.column("n").to_numpy()
            left, right = composed(words, start)
            if reverse:
                words = [word[::-1] for word in words]
                head = np.unique([word[:START] for word in words], return_inverse=True)[1]
                apart = head[left] != head[right]
                left, right = left[apart], right[apart]
            texts = pa.array(words, pa.string())
            for a, b in ((left, right), (right, left)):
                columns = [texts.take(pa.array(a)), pa.array(n[a]), texts.take(pa.array(b)), pa.array(n[b])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < block:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        side, key = table.column("side").to_numpy(), table.column("key").to_numpy(zero_copy_only=False)
        cut = int(np.argmax((side == side[-1]) & (key == key[-1])))
        if cut:
            yield from pairs(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        # what is open is at most one initial state, so the wait for the next block starts anew
        rows = 0
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _edits_at(rows: DataFrame, place: int) -> DataFrame:
    """Pairs of `rows`, which share `place` code points, with the edit at that place: their rests are equal."""
    word = F.col("word")
    rest = F.concat(F.substring(word, 1, place), F.substring(word, place + 2, 1 << 30))
    shorter = rows.select("side", word.alias("rest"), F.lit("").alias("symbol"), "word", "n")
    longer = rows.where(F.length("word") > place).select("side", rest.alias("rest"), F.substring(word, place + 1, 1).alias("symbol"), "word", "n")
    every = shorter.unionByName(longer)
    other = every.select("side", "rest", *(F.col(c).alias(f"near_{c}") for c in ("symbol", "word", "n")))
    # a deletion counts where the words first differ
    apart = (F.col("symbol") != F.col("near_symbol")) & (F.greatest("symbol", "near_symbol") != F.substring("rest", place + 1, 1)) | (
        (F.col("symbol") != F.col("near_symbol")) & (F.col("symbol") != "") & (F.col("near_symbol") != "")
    )
    met = every.join(other, ["side", "rest"]).where(apart)

    def plain(c: str) -> Column:
        return F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))

    pairs = met.select("side", plain("word").alias("word"), "n", plain("near_word").alias("near"), F.col("near_n"))
    kept = (F.col("side") == 0) | (F.substring("word", 1, START) != F.substring("near", 1, START))
    return pairs.where(kept).drop("side")


def near_words(words: DataFrame, crowded: int = CROWDED, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): all pairs of the distinct words (word, n) exactly one edit apart, in both orders. Words of
    fewer than `LEAST_LENGTH` code points take no part."""
    tasks = partitions_of(words)
    words = words.where(F.length("word") >= LEAST_LENGTH).select("word", "n")
    sides = [words.select(F.lit(side).alias("side"), (F.reverse("word") if side else F.col("word")).alias("word"), "n") for side in (0, 1)]
    rows = sides[0].unionByName(sides[1])
    found, place = [], START
    while True:
        keyed = rows.withColumn("key", F.substring("word", 1, place))
        full = checkpointed(keyed.groupBy("side", "key").count().where(F.col("count") > crowded).drop("count"))
        calm = keyed
        if is_full := not full.isEmpty():
            # one row for each `crowded` words at most
            full = F.broadcast(full)
            calm = keyed.join(full, ["side", "key"], "left_anti")
        dealt = calm.repartition(tasks, "side", "key").sortWithinPartitions("side", "key", "word")
        found.append(dealt.select("side", "key", "word", "n").mapInArrow(partial(_compose, start=place, block=block), _PAIRS))
        if not is_full:
            break
        rows = checkpointed(keyed.join(full, ["side", "key"], "left_semi").drop("key"))
        found.append(_edits_at(rows, place).select("word", "n", "near", "near_n"))
        rows = rows.where(F.length("word") > place)
        place += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: forms followed to the last. Each turn doubles the steps, and a form
    is `RATIO` times as frequent as its word, so a few turns do."""
    links = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpointed(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def group(words: DataFrame, crowded: int = CROWDED, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the distinct words (word, n); see `near_words`. The form is the most frequent
    near word, the smallest of several, where it is `RATIO` times as frequent as the word."""
    words = checkpointed(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, crowded, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    judged = checkpointed(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        )
    )
    followed = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(followed, "word", "left").withColumn("root", F.coalesce("root", "word"))
