import random

import pytest
from conftest import pairs_of
from pyspark.sql import functions as F

from mediamatch.functions.similarity import DEFAULT_PARTS, Part, composite_score
from mediamatch.operators import search as S
from mediamatch.plans.searching import public_search, reverse_search, widget_limit
from mediamatch.schema import INDEX_SCHEMA, Settings

FEATURES = "phash string, color_vector array<double>, edge_vector array<double>"


def library(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bits = 0x0F0F_3C3C_5A5A_9999
        for b in rng.sample(range(64), rng.randint(0, 20)):
            bits ^= 1 << b
        color = [rng.random() for _ in range(48)]
        color = [v / sum(color[c // 16 * 16 : c // 16 * 16 + 16]) for c, v in enumerate(color)]
        out.append((i, f"{bits:016x}", color, [rng.random() for _ in range(32)]))
    return out


def index_of(spark, rows, error=""):
    df = spark.createDataFrame(rows, "attachment_id long, " + FEATURES)
    from mediamatch.operators.index import conform

    return conform(df.withColumn("error_code", F.lit(error)))


def probes_of(spark, rows):
    return spark.createDataFrame(rows, "probe_id long, " + FEATURES)


def test_prefilter_cap():
    assert [S.prefilter_cap(t) for t in (0.5, 0.85, 0.9, 0.95, 1.0)] == [20, 20, 16, 8, 0]


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_search_equals_scoring_every_pair(spark, threshold):
    rows = library(60, 1)
    probes, index = probes_of(spark, library(25, 2)), index_of(spark, rows)
    got = pairs_of(S.search(probes, index, Settings(match_threshold=threshold), limit=5).withColumn("score", F.round("score", 9)), "probe_id", "rank", "attachment_id", "score")
    q = probes.select("probe_id", *[F.col(p.feature).alias("q_" + p.feature) for p in DEFAULT_PARTS])
    s = index.select("attachment_id", *[F.col(p.feature).alias("s_" + p.feature) for p in DEFAULT_PARTS])
    apart = F.bit_count(F.conv("q_phash", 16, -10).cast("bigint").bitwiseXOR(F.conv("s_phash", 16, -10).cast("bigint")))
    every = q.crossJoin(s).where(apart <= 20).withColumn("score", composite_score("q_", "s_")).where(F.col("score") >= threshold)
    want = pairs_of(S.top_matches(every, 5).withColumn("score", F.round("score", 9)), "probe_id", "rank", "attachment_id", "score")
    assert got == want and (threshold > 0.85 or got)


def test_crowded_hash_is_shared_out_without_loss(spark):
    rows = library(40, 3)
    rows += [(1000 + i, rows[0][1], rows[i % 40][2], rows[i % 40][3]) for i in range(90)]
    probes = probes_of(spark, [(i, *r[1:]) for i, r in enumerate(library(10, 3))] + [(50 + i, *rows[0][1:]) for i in range(30)])
    key = ("probe_id", "attachment_id", "distance")
    plain = pairs_of(S.candidates(probes, index_of(spark, rows)), *key)
    split = pairs_of(S.candidates(probes, index_of(spark, rows), share=8), *key)
    assert plain == split and len(plain) > 2000


def test_failed_and_unhashed_rows_are_not_found(spark):
    rows = library(3, 4)
    ok, failed = index_of(spark, rows[:1]), index_of(spark, rows[1:2], "unfingerprintable")
    blank = index_of(spark, [(2, "", None, None)])
    index = ok.unionByName(failed).unionByName(blank)
    probes = probes_of(spark, [(i, *r[1:]) for i, r in enumerate(rows)] + [(7, "nothex", rows[0][2], rows[0][3]), (8, rows[0][1].upper(), *rows[0][2:])])
    found = S.search(probes, index, Settings(match_threshold=0.5))
    assert {r["attachment_id"] for r in found.collect()} == {0}
    assert 7 not in {r["probe_id"] for r in found.collect()} and 8 in {r["probe_id"] for r in found.collect()}


def test_identical_flat_images_stay_below_threshold(spark):
    flat = [(1, "8000000000000000", [1 / 16] * 48, [0.0] * 32)]
    found = S.search(probes_of(spark, flat), index_of(spark, flat), Settings(match_threshold=0.75))
    assert [round(r["score"], 9) for r in found.collect()] == [0.75]
    assert S.search(probes_of(spark, flat), index_of(spark, flat)).count() == 0


def test_missing_part_scores_zero(spark):
    rows = [(1, "8000000000000000", None, [1.0] * 32)]
    assert S.search(probes_of(spark, rows), index_of(spark, rows), Settings(match_threshold=0.5)).count() == 0


def test_other_parts_may_be_given(spark):
    rows = library(20, 5)
    parts = (Part(1.0, "phash", DEFAULT_PARTS[0].similarity),)
    found = S.search(probes_of(spark, rows), index_of(spark, rows), Settings(match_threshold=0.9), 20, parts)
    got = {(r["probe_id"], r["attachment_id"]) for r in found.collect()}
    bits = {r[0]: int(r[1], 16) for r in rows}
    assert got == {(a, b) for a in bits for b in bits if (bits[a] ^ bits[b]).bit_count() <= 6}


def test_ties_rank_by_id_and_limit_applies(spark):
    row = library(1, 6)[0][1:]
    index = index_of(spark, [(i, *row) for i in (9, 3, 5, 7)])
    found = S.search(probes_of(spark, [(0, *row)]), index, limit=3)
    assert pairs_of(found, "rank", "attachment_id") == [(1, 3), (2, 5), (3, 7)]
    assert S.search(probes_of(spark, [(0, *row)]), index, limit=0).count() == 0


MEDIA = "attachment_id long, title string, filename string, post_type string, status string, parent_id long"


def test_public_search_limits_before_it_hides(spark):
    row = library(1, 6)[0][1:]
    index = index_of(spark, [(i, *row) for i in range(1, 9)])
    media = spark.createDataFrame(
        [
            (1, "one", "a/1.png", "attachment", "inherit", 100),
            (2, "two", "a/2.png", "attachment", "inherit", 101),
            (3, "three", "a/3.png", "attachment", "inherit", 0),
            (4, "four", "a/4.png", "page", "publish", 0),
            (5, "five", "a/5.png", "attachment", "publish", 101),
            (6, "six", "a/6.png", "attachment", "private", 100),
            (7, "seven", "a/7.png", "attachment", "inherit", 999),
        ],
        MEDIA,
    )
    posts = spark.createDataFrame([(100, "publish"), (101, "draft")], "post_id long, status string")
    probes = probes_of(spark, [(3, *row)])
    ids = lambda df: [r[0] for r in pairs_of(df, "attachment_id")]
    assert ids(public_search(probes, index, media, posts)) == [1, 5]
    assert ids(public_search(probes, index, media, posts, limit=2)) == [1]
    assert ids(public_search(probes, index, media, posts, limit=2, filter_first=True)) == [1, 5]
    closed = Settings(search_visibility="logged_in")
    with pytest.raises(PermissionError):
        public_search(probes, index, media, posts, closed)
    assert ids(public_search(probes, index, media, posts, closed, signed_in=True)) == [1, 5]
    full = reverse_search(probes, index, media)
    assert pairs_of(full, "attachment_id", "title")[-1] == (8, "") and full.count() == 8
    assert INDEX_SCHEMA.names == index.columns
    assert [widget_limit(x) for x in (None, 0, 100)] == [12, 1, 48]


def test_bound_is_no_less_than_the_score(spark):
    rows = library(50, 8)
    rows += [(200, rows[0][1], [0.0] * 48, [0.0] * 32), (201, rows[0][1], [0.4] * 70, [0.5] * 20), (202, rows[1][1], [], [-1.0, 2.0] * 16)]
    probes, index = probes_of(spark, rows), index_of(spark, rows)
    low = Settings(match_threshold=0.5)
    bounds = {tuple(r[:2]): r["bound"] for r in S.bounded_candidates(probes, index, low).collect()}
    scores = S.score_candidates(S.candidates(probes, index), low).collect()
    assert len(scores) > 1500
    for r in scores:
        assert bounds[r["probe_id"], r["attachment_id"]] >= r["score"] - 1e-9


@pytest.mark.parametrize("limit", [1, 10])
def test_refining_gives_the_ranks_of_scoring_all(spark, limit):
    rows = library(80, 11) + [(500 + i, *r[1:]) for i, r in enumerate(library(6, 11))]
    probes, index = probes_of(spark, library(30, 12)), index_of(spark, rows)
    settings = Settings(match_threshold=0.7)
    every = S.top_matches(S.score_candidates(S.candidates(probes, index), settings), limit)
    key = ("probe_id", "rank", "attachment_id")
    assert pairs_of(S.search(probes, index, settings, limit), *key) == pairs_of(every, *key)


def test_features_move_for_the_best_candidates_only(spark):
    rng = random.Random(13)
    spike = lambda n, at: [8.0 if i // 4 == at else 0.1 for i in range(n)]
    rows = [(i, h, [c / 16 for c in spike(16, rng.randrange(4)) * 3], spike(32, rng.randrange(8))) for i, h, _, _ in library(300, 13)]
    probes, index = probes_of(spark, rows[:20]), index_of(spark, rows)
    settings = Settings(match_threshold=0.5)
    found = S.bounded_candidates(probes, index, settings)
    plan = found._jdf.queryExecution().toString()
    scans = plan[plan.index("== Physical Plan ==") :]
    exchanges = [line for line in scans.splitlines() if "Exchange" in line]
    assert exchanges and not any("color_vector#" in line or "edge_vector#" in line for line in exchanges)
    moved = []
    original = S.score_candidates
    try:
        S.score_candidates = lambda met, *a: (moved.append(met.count()), original(met, *a))[1]
        S.refined(found, probes, index, settings, 5)
    finally:
        S.score_candidates = original
    assert moved[0] == 100 and moved[1] < 0.6 * found.count()


def test_lossless_cap_finds_what_the_prefilter_drops(spark):
    rows = library(2, 15)[:1]
    bits = int(rows[0][1], 16)
    far = [(i, f"{bits ^ ((1 << i) - 1):016x}", *rows[0][2:]) for i in (10, 20, 21, 24, 25, 40)]
    ids = lambda **more: [r[0] for r in pairs_of(S.search(probes_of(spark, rows), index_of(spark, far), **more), "attachment_id")]
    assert ids() == [10, 20] and ids(lossless=True) == [10, 20, 21, 24]
