import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, distance=4):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("text", ["", " \n", "One TWO three", "a b c d", "É x Y z w", "x " * 5000, "a\x1cb c\x85d e f g", *prose(2, 3)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_agrees_with_the_column_function(spark):
    got = spark.createDataFrame([("a b c d é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a b c d é".encode(), 42)


def near_values(seed, centres, around, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            v = c
            for b in rng.sample(range(64), rng.randint(0, flips)):
                v ^= 1 << b
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("radii", [[(64, 4)], [(32, 3), (32, 0)], [(22, 2), (21, 0), (21, 0)], [(16, 1), (16, 0), (16, 0), (16, 0)], None])
@pytest.mark.parametrize("block", [64, 4096])
def test_links_connect_what_brute_force_connects(spark, radii, block):
    values = near_values(3, 40, 25, 6)
    parts, at = [], 0
    for width, radius in radii or []:
        parts.append(simhash.Part(tuple(range(at, at + width)), radius))
        at += width
    if radii == [(64, 4)]:
        values = values[:60]
        parts = [simhash.Part(tuple(range(64)), 2)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame_ = spark.createDataFrame([(v,) for v in signed], "bits long")
    distance = 2 if radii == [(64, 4)] else 4
    if not parts:
        parts = simhash.plan_parts(*simhash.bit_statistics(frame_))
    links = simhash.near_links(frame_, parts, distance, block).collect()
    index = {v: i for i, v in enumerate(signed)}
    label = list(range(len(values)))
    for r in links:
        a, b = label[index[r[0]]], label[index[r[1]]]
        label = [a if x == b else x for x in label]
    want = brute_components(values, distance)
    assert len({*zip(label, want)}) == len(set(label)) == len(set(want))


def test_dense_cluster_makes_few_links(spark):
    rng = np.random.default_rng(4)
    flips = np.zeros(6000, np.uint64)
    for _ in range(3):
        flips ^= np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64)
    values = spark.createDataFrame([(int(v),) for v in np.unique(flips.view(np.int64))], "bits long")
    n, both = simhash.bit_statistics(values)
    parts = simhash.plan_parts(n, both)
    links = simhash.near_links(values, parts, block=512)
    assert links.count() < 200 * n
    assert simhash.connected_components(links).select("component").distinct().count() == 1


def test_rows_around_a_hot_value_do_not_meet_beside_it(spark):
    # All rows share the first 32 bits: each probe of a flipped bit would gather them again on a key without owner.
    rng = np.random.default_rng(9)
    values = np.unique(rng.integers(0, 1 << 32, 2000).astype(np.int64) << 32 | 5)
    near = np.unique(np.concatenate([values, values[:50] ^ (3 << 33)]))
    frame_ = spark.createDataFrame([(int(v),) for v in near], "bits long")
    parts = [simhash.Part(tuple(range(32)), 1), simhash.Part(tuple(range(32, 64)), 2)]
    links = simhash.near_links(frame_, parts, block=256)
    got = {frozenset((r[0], r[1])) for r in links.collect()}
    label = brute_components([int(v) % (1 << 64) for v in near])
    assert simhash.connected_components(links).select("component").distinct().count() == sum(label.count(x) > 1 for x in set(label))
    assert len(got) >= 50


def test_radii_cover_every_pair():
    rng = np.random.default_rng(5)
    ones = rng.integers(0, 2, (500, 64)).astype(float)
    for n in (10**3, 10**6, 10**9):
        parts = simhash.plan_parts(n, ones.T @ ones * (n / 500))
        groups = {b for p in parts for b in p.positions}
        unprobed = 64 - len(groups)
        assert sum(p.radius + 1 for p in parts) == simhash.DISTANCE + 1 and (unprobed == 0 or len(parts) < 5)


def test_components_of_odd_rows(spark):
    rows = odd_rows()
    base = prose(7, 6, 200)
    rows += [(300 + i, t, None, None) for i, t in enumerate(base)]
    rows += [(400 + i, t + " tail", "en", "s") for i, t in enumerate(base)]
    rows += [(200, base[0], None, None), (200, base[1], None, None)]
    got = simhash.components(frame(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    label = brute_components(prints)
    smallest = {}
    for (d, *_), c in zip(rows, label):
        if d is not None:
            smallest[c] = min(d, smallest.get(c, d))
    want = sorted((str(d), f"{p:016x}", smallest.get(c)) for (d, *_), p, c in zip(rows, prints, label))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.components(frame(spark, [])).collect() == []


def test_representatives(spark):
    base = prose(8, 4, 200)
    rows = [(10 * i + j, t + " tail" * (j > 0), "en", "s") for i, t in enumerate(base) for j in range(3)]
    rows += [(0, base[0], "en", "s"), (None, base[1], None, None)]
    docs = frame(spark, rows)
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    label = brute_components(prints)
    want = sorted(min(d for (d, *_), c in zip(rows, label) if c == k and d is not None) for k in set(label))
    assert sorted(r["doc_id"] for r in out.collect()) == want
    assert simhash.representatives(frame(spark, [])).collect() == []
