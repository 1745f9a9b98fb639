"""The stored band index against all pairs, and the plan of a probe batch."""

import random

import pytest
from conftest import pairs_of
from pyspark.sql import functions as F
from test_search import index_of, library, probes_of

from mediamatch.functions.hashes import hash_to_long
from mediamatch.operators import search as S
from mediamatch.operators.hamming_join import EqualBands, NearBands
from mediamatch.operators.index import conform
from mediamatch.plans import bands as bands_module
from mediamatch.plans.bands import BandIndex
from mediamatch.plans.searching import reverse_search
from mediamatch.plans.store import IndexStore
from mediamatch.schema import MEDIA_SCHEMA, Settings

SIGNED = 1 << 63


def flipped(rng, value, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        value ^= 1 << bit
    return value


def hashes_of(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    return sorted({flipped(rng, rng.choice(centres), 14) - SIGNED for _ in range(n)})


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "bits long")


def brute(left, right, distance):
    return sorted((a, b, d) for a in left for b in right if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= distance)


def met(pairs):
    return sorted(tuple(r) for r in pairs.collect())


@pytest.mark.parametrize("cover", [NearBands(20, 6), EqualBands(6, 8), NearBands(12, 4)])
@pytest.mark.parametrize("crowd", [3, 10_000])
def test_pairs_equal_all_pairs_after_several_extensions(spark, tmp_path, cover, crowd):
    stored, probes = hashes_of(1, 240), hashes_of(2, 30) + hashes_of(1, 240)[:30]
    bands = BandIndex(spark, str(tmp_path), cover=cover, buckets=4, crowd=crowd)
    assert met(bands.pairs(frame(spark, probes))) == []
    sizes = [bands.extend(frame(spark, stored[i::3] + stored[:5] + stored[:5])) for i in range(3)]
    assert sum(sizes) == len(stored) and bands.extend(frame(spark, stored)) == 0
    again = BandIndex(spark, str(tmp_path), crowd=crowd)  # takes cover and buckets from the folder
    assert (again.cover, again.buckets) == (cover, 4) and sorted(r["bits"] for r in again.hashes().collect()) == stored
    for distance in (cover.distance, cover.distance // 2):
        assert met(again.pairs(frame(spark, probes), distance)) == brute(sorted(set(probes)), stored, distance)
    with pytest.raises(ValueError):
        again.pairs(frame(spark, probes), cover.distance + 1)


def test_crowded_keys_are_cut_into_cells(spark, tmp_path):
    rng = random.Random(3)
    same = rng.getrandbits(32) << 32  # all share the upper bands
    stored = sorted({(same | rng.getrandbits(32)) - SIGNED for _ in range(300)})
    bands = BandIndex(spark, str(tmp_path), cover=NearBands(12, 4), buckets=4, crowd=20)
    for i in range(4):
        bands.extend(frame(spark, stored[i::4]))
    sizes = [r["count"] for r in bands.rows().groupBy("part", "key", "cell").count().collect()]
    assert max(sizes) <= 3 * 20 and bands.cells().agg(F.max("cells")).first()[0] >= 15
    assert met(bands.pairs(frame(spark, stored[:40]))) == brute(stored[:40], stored, 12)


def test_probe_batch_leaves_the_stored_side_where_it_lies(spark, tmp_path):
    bands = BandIndex(spark, str(tmp_path), cover=NearBands(20, 6), buckets=4)
    bands.extend(frame(spark, hashes_of(4, 200)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bands.pairs(frame(spark, hashes_of(5, 20)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # that of the probes


def index_rows(spark, values, start=0):
    rows = [(start + i, f"{v & (2**64 - 1):016x}", "") for i, v in enumerate(values)]
    return conform(spark.createDataFrame(rows, "attachment_id long, phash string, error_code string"))


def test_follows_an_index_store(spark, tmp_path):
    values = hashes_of(6, 60)
    store, bands = IndexStore(spark, f"{tmp_path}/index"), BandIndex(spark, f"{tmp_path}/bands", cover=NearBands(20, 6), buckets=4)
    assert bands.follow(store) == 0
    store.write(index_rows(spark, values[:20]))
    assert bands.follow(store) == 20 and bands.follow(store) == 0
    gone = spark.createDataFrame([(3,)], "attachment_id long").withColumn("ts", F.current_timestamp())
    store.append(index_rows(spark, values[10:40], start=100), gone)
    store.append(index_rows(spark, values[40:50], start=200), gone)
    assert bands.follow(store) == 30
    store.compact()
    store.append(index_rows(spark, values[45:60], start=300), gone)
    store.prune()
    assert bands.follow(store) == 10
    held = store.read().select(hash_to_long("phash").alias("bits")).distinct()
    assert held.join(bands.hashes(), "bits", "left_anti").isEmpty()
    assert sorted(r["bits"] for r in bands.hashes().collect()) == values


def test_large_batches_do_not_pay(spark, tmp_path, monkeypatch):
    stored, asked = hashes_of(6, 300), hashes_of(6, 200)
    probes = frame(spark, asked)
    index = BandIndex(spark, str(tmp_path), cover=NearBands(20, 6), buckets=4)
    index.extend(frame(spark, stored))
    near = len(brute(asked, stored, 20))
    assert near and index.pays(probes, 20)
    monkeypatch.setattr(bands_module, "PAIRS_PER_ROW", 0)
    for most, pays in ((near, True), (near - 1, False), (len(asked) * len(stored), True)):
        monkeypatch.setattr(bands_module, "LEAST_PAIRS", most)
        assert index.pays(probes, 20) is pays
    emitted = index.cover.emit(probes, wide=True).count()
    assert emitted == len(asked) * index.cover.wide_keys()
    monkeypatch.setattr(bands_module, "KEYS_PER_ROW", 0)
    for most, pays in ((emitted, True), (emitted - 1, False)):
        monkeypatch.setattr(bands_module, "LEAST_KEYS", most)
        assert index.pays(probes, 20) is pays


@pytest.mark.parametrize("least", [0, 10**6])
def test_batches_of_any_size_find_the_same(spark, tmp_path, monkeypatch, least):
    rows = library(60, 1)
    probes, index = probes_of(spark, library(40, 2)), index_of(spark, rows)
    bands = BandIndex(spark, str(tmp_path), cover=NearBands(20, 6), buckets=4)
    bands.extend(S.with_bits(probes, index)[1].select("bits"))
    monkeypatch.setattr(bands_module, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(bands_module, "LEAST_PAIRS", least)
    asked = []
    monkeypatch.setattr(bands, "near", lambda *a: asked.append(1) or BandIndex.near(bands, *a))
    media = spark.createDataFrame([], MEDIA_SCHEMA)
    found, plain = (
        reverse_search(probes, index, media, Settings(match_threshold=0.7), 5, bands=b).withColumn("score", F.round("score", 9))
        for b in (bands, None)
    )
    key = ("probe_id", "rank", "attachment_id", "score")
    assert pairs_of(found, *key) == pairs_of(plain, *key) and bool(asked) == (least > 0)
    # no pair of hashes leaves a task when the batch is too large
    assert ("CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()) == (least == 0)
