import random

import numpy as np
import pytest
from conftest import pairs_of
from test_hamming_join import COVERS, apart, clustered, signed, table

from mediamatch.operators.blocks import near_places
from mediamatch.operators.components import connected_components
from mediamatch.operators.hamming_join import EqualBands, NearBands, choose_cover, hamming_self_pairs, telling_bits
from mediamatch.operators.near_links import dense_links, near_links, stars


def components_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def wanted(values, t):
    return components_of((a, b) for i, a in enumerate(values) for b in values[:i] if apart(a, b) <= t)


def found(spark, values, t, **more):
    links = [(r[0], r[1]) for r in near_links(table(spark, values), t, **more).collect()]
    assert all(apart(a, b) > 0 for a, b in links)
    return components_of(links)


@pytest.mark.parametrize("cover", COVERS, ids=str)
@pytest.mark.parametrize("block", [20, 10_000])
def test_links_connect_what_pairs_connect(spark, cover, block):
    rng = random.Random(7)
    crowd = {signed(0xABCD_0000_1234_5678 | rng.getrandbits(16) << 32) for _ in range(100)}
    values = sorted(crowd | set(clustered(150, 1)))
    assert found(spark, values, cover.distance, cover=cover, block=block) == wanted(values, cover.distance)


@pytest.mark.parametrize("t", [1, 3, 13])
def test_chosen_cover(spark, t):
    values = clustered(200, t)
    assert found(spark, values, t) == wanted(values, t)


def test_empty_and_single(spark):
    assert found(spark, [], 3) == found(spark, [5], 3) == {}


@pytest.mark.parametrize("cover", [EqualBands(3, 4), NearBands(13, 7)], ids=str)
def test_dense_cluster_makes_few_links(spark, cover):
    # 10,000 hashes within 3 bits of a centre: 50 million pairs at 13 bits.
    rng = np.random.default_rng(4)
    values = set()
    while len(values) < 10_000:
        values.add(signed(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) ^ 0x0F0F_1234_5678_9ABC))
    df = table(spark, sorted(values))
    links = near_links(df, cover.distance, cover, block=2000)
    rows = cover.emit(df, wide=True).count()
    assert links.count() <= rows
    assert connected_components(links).select("component").distinct().count() == 1


@pytest.mark.parametrize("n,m", [(0, 5), (5, 0), (1, 1), (40, 300), (3, 200_000)])
def test_near_places_are_those_of_all_distances(n, m):
    rng = np.random.default_rng(2)
    bits, held = (rng.integers(0, 2**64, size, dtype=np.uint64) for size in (n, m))
    held[: min(n, m)] = bits[: min(n, m)]
    apart = np.bitwise_count(bits[:, None] ^ held[None, :])
    i, j = np.nonzero(apart <= 22)
    got = near_places(bits, held, 22)
    assert all(np.array_equal(a, b) for a, b in zip(got, (i, j, apart[i, j])))


def test_stars_name_the_smallest():
    left, right = np.array([9, 4, 7, 1], np.uint64), np.array([7, 9, 2, 3], np.uint64)
    assert dict(zip(*(x.tolist() for x in stars(left, right)))) == {9: 2, 4: 2, 7: 2, 3: 1}


@pytest.mark.parametrize("samples", [(20,), (10, 60), (400,)], ids=str)
def test_samples_link_what_pairs_link(spark, samples):
    rng = random.Random(3)
    values = {signed(0x0F0F_0000_1234_5678 ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12)))) for _ in range(300)}
    values = sorted(values | set(clustered(100, 2)))
    links = dense_links(table(spark, values), len(values), 13, samples, block=64)
    links = [(r[0], r[1]) for r in links.collect()]
    assert all(apart(a, b) > 0 for a, b in links) and len(links) < 60 * len(values)
    assert components_of(links) == wanted(values, 13)


def test_sparse_hashes_are_left_to_covers(spark):
    values = clustered(300, 9)
    assert dense_links(table(spark, values), len(values), 13, (20,)) is None


def test_bits_that_all_share_make_no_crowded_key(spark):
    rng = random.Random(8)
    # the lowest 16 bits hardly differ, as in hashes of texts
    values = sorted({signed(rng.getrandbits(48) << 16 | (1 << rng.randint(0, 15)) * (rng.random() < 0.1)) for _ in range(400)} | {signed(v << 16) for v in range(40)})
    hashes = table(spark, values)
    order, told = telling_bits(hashes)
    assert set(order[-16:]) >= set(range(16)) - set(order[:-20]) and 40 < told < 56
    plain, dealt = EqualBands(3, 4), EqualBands(3, 4, order, told)
    largest = lambda cover: cover.emit(hashes, wide=True).groupBy("part", "key").count().agg({"count": "max"}).first()[0]
    assert largest(plain) > 300 and largest(dealt) < 120
    for m in (4, 5, 7):
        assert found(spark, values, 3, cover=EqualBands(3, m, order, told)) == wanted(values, 3)
        got = pairs_of(hamming_self_pairs(hashes, 3, EqualBands(3, m, order, told), hot_bucket=20), "left_bits", "right_bits")
        assert got == sorted((a, b) for a in values for b in values if a < b and apart(a, b) <= 3)
    assert choose_cover(3, 50_000, 50_000, order, told).order == order
