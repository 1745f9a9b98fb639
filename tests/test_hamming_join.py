import random

import pytest
from conftest import pairs_of

from mediamatch.operators.components import connected_components
from mediamatch.operators.hamming_join import EqualBands, NearBands, choose_cover, counted_self_pairs, hamming_pairs, hamming_self_pairs


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def clustered(n, seed, spread=6):
    """Hashes in loose clusters, so that all distances up to 2 * spread occur."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(6):
            v = centre
            for bit in rng.sample(range(64), rng.randint(0, spread)):
                v ^= 1 << bit
            out.add(signed(v))
    return sorted(out)


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "bits long")


def apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def brute(left, right, t, ordered):
    return sorted((a, b, apart(a, b)) for a in left for b in right if apart(a, b) <= t and (a < b or not ordered))


COVERS = [EqualBands(3, 4), EqualBands(3, 6), EqualBands(0, 1), EqualBands(7, 9), NearBands(3, 2), NearBands(13, 5), NearBands(20, 9), NearBands(6, 7)]


@pytest.mark.parametrize("cover", COVERS, ids=str)
def test_cover_finds_every_pair_once(spark, cover):
    left, right = clustered(150, 1), clustered(150, 1)[::2] + clustered(60, 2)
    right = sorted(set(right))
    got = pairs_of(hamming_pairs(table(spark, left), table(spark, right), cover.distance, cover), "left_bits", "right_bits", "distance")
    assert got == brute(left, right, cover.distance, False)
    own = pairs_of(hamming_self_pairs(table(spark, left), cover.distance, cover), "left_bits", "right_bits", "distance")
    assert own == brute(left, left, cover.distance, True)


@pytest.mark.parametrize("t", [1, 3, 8, 13, 20])
def test_chosen_cover_is_exact(spark, t):
    values = clustered(200, t)
    got = pairs_of(hamming_self_pairs(table(spark, values), t), "left_bits", "right_bits", "distance")
    assert got == brute(values, values, t, True)


@pytest.mark.parametrize("cover", [EqualBands(3, 4), EqualBands(10, 12), NearBands(9, 5)], ids=str)
def test_crowded_keys_are_split_without_loss(spark, cover):
    # A third of all hashes agree on three of four 16-bit bands.
    rng = random.Random(7)
    crowd = {signed(0xABCD_0000_1234_5678 | rng.getrandbits(16) << 32) for _ in range(150)}
    values = sorted(crowd | set(clustered(300, 3)))
    got = pairs_of(hamming_self_pairs(table(spark, values), cover.distance, cover, hot_bucket=20), "left_bits", "right_bits", "distance")
    assert got == brute(values, values, cover.distance, True)
    half = values[::2]
    got = pairs_of(hamming_pairs(table(spark, half), table(spark, values), cover.distance, cover, hot_bucket=20), "left_bits", "right_bits", "distance")
    assert got == brute(half, values, cover.distance, False)


def test_cover_grows_with_the_data():
    assert choose_cover(3, 10_000, 10_000) == EqualBands(3, 4)
    assert choose_cover(3, 10**9, 10**9).bands > 4
    assert isinstance(choose_cover(20, 1000, 1000), NearBands)
    # Keys of the finest cover for the default cap leave few hashes per key, whatever the data.
    assert EqualBands(3, 16).largest_bucket() == 4096


def components_by_search(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, seen = {}, set()
    for start in sorted(near):
        if start in seen:
            continue
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                out[n] = start
                stack.extend(near[n])
    return sorted(out.items())


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty", "loops"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {
        "random": [(rng.randint(-200, 200), rng.randint(-200, 200)) for _ in range(180)],
        "chain": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "star": [(999, i) for i in range(100)] + [(5000, 5001)],
        "empty": [],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[shape]
    df = spark.createDataFrame(edges, "left_bits long, right_bits long")
    got = pairs_of(connected_components(df), "node", "component")
    assert got == components_by_search([(a, b) for a, b in edges if a != b])


@pytest.mark.parametrize("block", [50, 1000])
def test_counted_pairs_in_blocks_travel_nowhere(spark, block):
    values = clustered(200, 9)
    hashes = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "bits long, n long")
    copies = {v: 1 + i % 3 for i, v in enumerate(values)}
    want = sorted((a, b, d, copies[a], copies[b]) for a in values for b in values if a < b and (d := apart(a, b)) <= 13)
    found = counted_self_pairs(hashes, 13, NearBands(13, 7), 10, block)
    assert pairs_of(found, *found.columns) == want and len(want) > 100
    assert pairs_of(counted_self_pairs(hashes, 13), *found.columns) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "Join" not in plan
