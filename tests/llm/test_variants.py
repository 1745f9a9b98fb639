import random
import zlib
from collections import Counter

import pytest

from llm_fixtures import frame, odd_rows
from mediamatch.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def vocabulary_of(rows):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def brute(counts):
    forms, out = {}, []
    for word, n in counts.items():
        others = sorted((-m, w) for w, m in counts.items() if near(word, w))
        form = others[0][1] if others and -others[0][0] >= 10 * n else None
        forms[word] = (n, len(others), form, counts[form] if form else None)
    for word, (n, n_near, form, form_n) in forms.items():
        root = word
        while forms[root][2]:
            root = forms[root][2]
        out.append((word, n, n_near, form, form_n, root))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


def made(seed, n, alphabet="abé", length=(7, 10)):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        words.add("".join(rng.choices(alphabet, k=rng.randint(*length))))
    return sorted(words)


@pytest.mark.parametrize("seed,start", ((1, 0), (2, 3), (3, 3), (4, 5)))
def test_composition(seed, start):
    words = made(seed, 150)
    words = sorted({w[:start] and "abaab"[:start] + w[start:] for w in words} | set(made(seed, 40))) if start == 5 else words
    left, right = variants.composed(words, start)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b) and a[:start] == b[:start]}
    assert sorted(zip(left.tolist(), right.tolist())) == sorted(want)


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in ("xa", "xb", "ya") for b in ("kk", "ll") for c in ("s", "", "ing"))
    a = variants.Acceptor(words)
    languages = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(a.final) == len(languages)
    assert a.size[a.state[0]] == len(words)


@pytest.mark.parametrize("crowded,block", ((1 << 17, 1 << 15), (1 << 17, 20), (40, 30), (1, 1)))
def test_groups(spark, crowded, block):
    rng = random.Random(8)
    words = made(5, 220) + [f"aaaaaa{w}" for w in made(6, 60, "ab", (1, 8))]
    counts = {w: rng.choice((2, 3, 20, 30, 250, 4000, 50_000)) for w in dict.fromkeys(w for w in words if len(w) >= 7)}
    got = variants.group(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), crowded, block)
    assert rows_of(got) == brute(counts)


def test_chain_of_forms(spark):
    chain = ["abcdefgh", "abcdefgX", "abcdefYX", "abcdeZYX", "abcdWZYX", "abcVWZYX"]
    counts = {w: 2 * 10**i for i, w in enumerate(chain)}
    got = rows_of(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and {r[-1] for r in got} == {chain[-1]}


def test_documents(spark):
    rng = random.Random(3)
    pool = made(9, 60, "abcdeÉßé", (6, 9))
    rows = [(i, " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(r[0], r[1]) for r in odd_rows()] + [(3, "xy" * 3000 + " " + "xy" * 3000), (4, "Xy" * 3000), (5, "x" + "yx" * 3000), (6, "x" + "yx" * 3000)]
    docs = frame(spark, [(d, t, None, None) for d, t in rows]).repartition(4)
    want = vocabulary_of(rows)
    assert {r["word"]: r["n"] for r in variants.vocabulary(docs).collect()} == want
    assert rows_of(variants.group(variants.vocabulary(docs))) == brute(want)


def test_empty_table(spark):
    assert variants.group(variants.vocabulary(frame(spark, []))).collect() == []
    assert variants.group(variants.vocabulary(frame(spark, [(1, None, None, None), (2, "a b", None, None)]))).collect() == []
