import math
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import lattice

RANKS = "byte_bpe_50k.tiktoken"
WORDS = [w.encode() for w in "the a conformation éau www.example.org/a supercalifragilistic x".split()] + [b"z" * 200]


@pytest.fixture(scope="module")
def setting():
    pieces = lattice.vocabulary(RANKS)
    weight = np.log(1 / (np.arange(len(pieces)) + 1.0))
    return lattice.Pieces.of(pieces), weight, {p: i for i, p in enumerate(pieces)}


def segmentations(text, known):
    if not text:
        yield []
    for size in range(1, min(len(text), max(map(len, known))) + 1):
        if text[:size] in known:
            for rest in segmentations(text[size:], known):
                yield [text[:size], *rest]


def marginal(text, known, weight):
    sums = [0.0]
    for end in range(1, len(text) + 1):
        terms = [sums[i] + weight[known[text[i:end]]] for i in range(max(0, end - max(map(len, known))), end) if text[i:end] in known]
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return sums[-1]


def test_marginal_sums_all_segmentations(setting):
    pieces, weight, known = setting
    for word in WORDS[:3]:
        all_sums = [sum(weight[known[p]] for p in s) for s in segmentations(b" " + word, known)]
        want = math.log(sum(map(math.exp, all_sums)))
        assert abs(lattice.log_marginals(pieces, weight, [word])[0] - want) < 1e-9
    want = [marginal(b" " + w, known, weight) for w in WORDS]
    assert np.allclose(lattice.log_marginals(pieces, weight, WORDS), want, atol=1e-9)


def test_pieces_of_any_length_take_part(setting):
    pieces, weight, known = setting
    long = [p for p in known if len(p) > 16 and not p.strip().count(b" ") and p.strip() == p.split()[0] if p.split()]
    assert max(map(len, known)) > 16 and len(long) > 3
    words = [p.strip() for p in long] + [b"x" + p.strip() + b"y" for p in long]
    assert np.allclose(lattice.log_marginals(pieces, weight, words), [marginal(b" " + w, known, weight) for w in words], atol=1e-9)


def test_expected_counts_are_posterior_means(setting):
    pieces, weight, known = setting
    word = b"station"
    want = Counter()
    parts = list(segmentations(b" " + word, known))
    odds = np.array([math.exp(sum(weight[known[p]] for p in s)) for s in parts])
    for s, o in zip(parts, odds / odds.sum()):
        for p in s:
            want[known[p]] += 3 * o
    got = lattice.expected_counts(pieces, weight, [word, b"a"], np.array([3.0, 0.0]))
    assert np.allclose(got[list(want)], list(want.values()), atol=1e-9) and abs(got.sum() - sum(want.values())) < 1e-9


def tokens(text):
    return (text or "").encode().lower().split()


def test_scores(spark, setting):
    rows = [(i, t.title() if i % 3 else t, None, None) for i, t in enumerate(prose(21, 60, 80))] + odd_rows()
    got = lattice.score(frame(spark, rows)).collect()
    train = [t for d, t, *_ in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for t in train for w in tokens(t))
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    words = spark.createDataFrame([(w.decode(), c) for w, c in counts.items()], "word string, n long")
    model = lattice.fit(words, ends, RANKS)
    assert abs(np.exp(model.weight).sum() + 10**model.end - 1) < 1e-9  # a distribution over pieces and the end
    pieces = setting[0]
    want = []
    for d, t, *_ in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        score = float(lattice.log_marginals(pieces, model.weight, own).sum()) / math.log(10) + model.end
        held = d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        want.append((str(d), held, len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, round(base, 6), round(score, 6)))
    got = [(str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got]
    assert sorted(got) == sorted(want)


def test_fitting_raises_the_training_likelihood(spark):
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(prose(22, 40, 80))])
    totals = [sum(r["score"] for r in lattice.score(docs, rounds=k).collect()) for k in (0, 1, 2)]
    assert totals[0] < totals[1] < totals[2]


def test_empty_tables(spark):
    assert lattice.score(frame(spark, [])).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lattice.score(frame(spark, [(only_held, "some words", None, None)])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert math.isfinite(row["score"])
