import pytest
from conftest import pairs_of
from pyspark.sql import functions as F
from test_search import index_of, library, probes_of

from mediamatch.catalog import search as catalog
from mediamatch.functions.similarity import DEFAULT_PARTS, composite_score
from mediamatch.operators import search as S
from mediamatch.operators import block_search
from mediamatch.operators.block_search import best_pairs, scored_pairs
from mediamatch.operators.blocks import packed, sides, unpacked
from mediamatch.schema import Settings

SMALL = "/root/testdata/sf0.001"


def odd_library():
    rows = library(60, 21)
    color, edge = rows[0][2], rows[0][3]
    rows += [(100, rows[0][1], None, edge), (101, rows[1][1], color[:20], edge), (102, rows[2][1], [], [-1.0, 2.0] * 16)]
    return rows + [(103, rows[3][1], color, [0.0] * 32), (104, rows[4][1], color * 2, edge[:5]), (105, "", color, edge)]


def every_pair(probes, index):
    q = probes.select("probe_id", *[F.col(p.feature).alias("q_" + p.feature) for p in DEFAULT_PARTS])
    s = index.where("phash <> ''").select("attachment_id", *[F.col(p.feature).alias("s_" + p.feature) for p in DEFAULT_PARTS])
    apart = F.bit_count(F.conv("q_phash", 16, -10).cast("bigint").bitwiseXOR(F.conv("s_phash", 16, -10).cast("bigint")))
    return q.crossJoin(s).where(apart <= 20).withColumn("score", composite_score("q_", "s_"))


@pytest.mark.parametrize("block", [7, 1000])
def test_all_pairs_and_their_parts(spark, block):
    rows = odd_library()
    probes, index = probes_of(spark, rows), index_of(spark, rows)
    got = scored_pairs(*S.with_bits(probes, index), 20, DEFAULT_PARTS, block=block).withColumn("score", F.round("score", 9))
    want = every_pair(probes.where("phash <> ''"), index).withColumn("score", F.round("score", 9))
    key = ("probe_id", "attachment_id", "score")
    assert pairs_of(got, *key) == pairs_of(want, *key) and got.count() > 2000


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("limit", [1, 4, 50])
def test_best_of_each_block_hold_the_best(spark, block, limit):
    rows = odd_library() + [(500 + i, *r[1:]) for i, r in enumerate(library(9, 21))]
    probes, index = probes_of(spark, library(40, 22)), index_of(spark, rows)
    found = scored_pairs(*S.with_bits(probes, index), 20, DEFAULT_PARTS, 0.7, limit, block=block)
    want = S.top_matches(every_pair(probes, index).where("score >= 0.7"), limit)
    key = ("probe_id", "rank", "attachment_id")
    assert pairs_of(S.top_matches(found, limit), *key) == pairs_of(want, *key)


def test_empty_sides(spark):
    rows = library(5, 1)
    assert S.search(probes_of(spark, rows), index_of(spark, rows).where("false")).count() == 0
    assert S.search(probes_of(spark, rows).where("false"), index_of(spark, rows)).count() == 0


def moved_after_comparison(df):
    """Operators above the comparison in blocks, as far as they move rows."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Final Plan ==") :].split("== Initial Plan ==")[0] if "== Final Plan ==" in plan else plan
    assert "MapInArrow" in plan
    return [line.strip() for line in plan.split("MapInArrow")[0].splitlines() if "Exchange" in line]


def test_near_blocks_do_not_travel(spark):
    for query in (catalog.block_candidates, catalog.embedding_cosine):
        assert moved_after_comparison(query(spark, SMALL)) == []
    plan = moved_after_comparison(catalog.block_nearest(spark, SMALL))
    assert len(plan) <= 1 and "Broadcast" not in str(plan)


def test_nearest_blocks_leave_only_the_best(spark, tmp_path, monkeypatch):
    # alike but for one number, so that all are near all
    rows = [(i, [float(j * j % 17) + (j == i % 64) for j in range(64)]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    given = []
    monkeypatch.setattr(catalog, "scored_pairs", lambda *a: given.append(scored_pairs(*a)) or given[-1])
    got = pairs_of(catalog.block_nearest(spark, str(tmp_path)), "probe_id", "rank", "attachment_id")
    pairs = catalog.block_candidates(spark, str(tmp_path)).collect()
    near = {i: sorted((r["distance"], r["attachment_id"]) for r in pairs if r["probe_id"] == i) for i in range(80)}
    assert got == [(i, k + 1, near[i][k][1]) for i in range(80) for k in range(5)]
    assert given[0].count() == 6 * 80 < given[1].count()


def test_matches_travel_only_ranked(spark):
    rows = library(80, 3)
    found = S.search(probes_of(spark, rows), index_of(spark, rows), Settings(match_threshold=0.5), 2)
    assert len(moved_after_comparison(found)) <= 1
    cut = scored_pairs(*S.with_bits(probes_of(spark, rows), index_of(spark, rows)), 20, DEFAULT_PARTS, 0.5, 2)
    assert cut.count() <= 160 < S.candidates(probes_of(spark, rows), index_of(spark, rows)).count()


def test_grid_follows_cores_and_bounds_blocks():
    assert sides(100, 100, 8) == (1, 1)
    for n in (10**5, 10**6, 10**7):
        parts, blocks = sides(2 * n, n, 12)
        assert n / blocks <= 1 << 16 and 1 <= parts * blocks <= max(2 * 48, blocks)


@pytest.mark.parametrize("piece, limit, kept", [(7, 1, 8), (7, 4, 1), (16, 4, 8), (1000, 4, 8), (7, 50, 2)])
def test_pieces_hold_the_best(spark, piece, limit, kept, monkeypatch):
    rows = odd_library() + [(500 + i, *r[1:]) for i, r in enumerate(library(9, 21))]
    probes, index = probes_of(spark, library(40, 22)), index_of(spark, rows)
    monkeypatch.setattr(block_search, "PIECES_KEPT", kept)
    found = best_pairs(*S.with_bits(probes, index), 20, DEFAULT_PARTS, 0.7, limit, piece)
    want = S.top_matches(every_pair(probes, index).where("score >= 0.7"), limit)
    key = ("probe_id", "rank", "attachment_id", "score")
    rounded = lambda df: pairs_of(df.withColumn("score", F.round("score", 9)), *key)
    assert rounded(S.top_matches(found, limit)) == rounded(want)


def test_features_go_through_no_shuffle(spark):
    rows = library(80, 3)
    probes, index = (side.repartition(3) for side in (probes_of(spark, rows), index_of(spark, rows)))
    found = best_pairs(*S.with_bits(probes, index), 20, DEFAULT_PARTS, 0.5, 2, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    searched = S.search(probes, index, Settings(match_threshold=0.5), 2)._jdf.queryExecution().executedPlan().toString()
    assert searched.count("Exchange") <= 1 and "CartesianProduct" in searched.split("MapInArrow")[1]
    # a probe that meets the index in one task leaves it with its best alone
    assert found.rdd.getNumPartitions() <= 16 and found.count() <= 2 * 80 * -(-found.rdd.getNumPartitions() // 3)


def test_packed_pieces_hold_every_row(spark):
    rows = spark.range(1000).select("id", F.array(F.col("id") / 3, F.lit(None)).alias("v")).repartition(1)
    for most, parts in ((7, 1), (300, 4), (5000, 9)):
        pieces = packed(rows, 1000, parts, most).collect()
        tables = [unpacked(bytes(r["rows"])) for r in pieces]
        assert max(x.num_rows for x in tables) <= most and len({r["piece"] for r in pieces}) == len(pieces)
        got = [row for x in tables for row in x.to_pylist()]
        assert sorted((r["id"], tuple(r["v"])) for r in got) == [(i, (i / 3, None)) for i in range(1000)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_features_meet_their_membership_once(spark, monkeypatch, most):
    monkeypatch.setattr(catalog, "BROADCAST_IDS", most)
    probes, index = catalog._probes_and_index(spark, SMALL)
    listed = {r[0] for r in catalog.t.membership(spark, SMALL).select("attachment_id").collect()}
    every = {r[0] for r in catalog.t.media(spark, SMALL).select("attachment_id").collect()}
    assert {r["probe_id"] for r in probes.select("probe_id").collect()} == every - listed
    assert {r["attachment_id"] for r in index.select("attachment_id").collect()} == every & listed
    for side in (probes, index):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_later_rows_are_compared_only_as_near_as_the_floor_asks(spark, monkeypatch):
    rows = library(64, 5)
    probes, index = probes_of(spark, rows[:16]), index_of(spark, rows)
    q, s = (unpacked(bytes(packed(side, 64).collect()[0]["rows"])) for side in S.with_bits(probes, index))
    columns = ["bits", "color_vector", "edge_vector"]
    q, s = q.select(["probe_id", *columns]), s.select(["attachment_id", *columns])
    matcher = block_search._Matcher(DEFAULT_PARTS, 20, 0.5, 1)
    kept = block_search._Best(block_search._Rows(q, matcher.wide), 1, 0.5)
    asked, near_places = [], block_search.near_places
    monkeypatch.setattr(block_search, "near_places", lambda bits, held, most: asked.append(most) or near_places(bits, held, most))
    for _ in range(2):
        matcher.improve(kept, matcher.prepare(s))
    # every probe is in the index, so nothing but its own hash can still count
    assert (kept.floor > 0.7).all() and asked[0].min() == 20 and asked[1].max() < 20
    assert (asked[1][kept.floor > 0.99] <= 1).all()
    i, score, ids = (c.tolist() for c in kept.found[0])
    assert i == list(range(16)) and ids == q["probe_id"].to_pylist()


def test_near_places_takes_a_distance_for_each_row():
    import numpy as np

    from mediamatch.operators.blocks import near_places

    some, held = (np.random.default_rng(n).integers(0, 1 << 16, n, dtype=np.uint64) for n in (37, 1003))
    most = np.arange(37) % 9
    i, j, apart = near_places(some, held, most)
    whole = np.bitwise_count(some[:, None] ^ held[None, :])
    want_i, want_j = np.nonzero(whole <= most[:, None])
    assert (i == want_i).all() and (j == want_j).all() and (apart == whole[i, j]).all() and len(i) > 100
    assert [len(c) for c in near_places(some[:0], held, 3)] == [0, 0, 0] == [len(c) for c in near_places(some, held[:0], most)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_uploads_fingerprint_of_the_index_only_what_a_search_may_return(spark, monkeypatch, most):
    given, with_features = [], catalog.with_features
    monkeypatch.setattr(catalog, "BROADCAST_IDS", most)
    monkeypatch.setattr(catalog, "with_features", lambda rows, *a: given.append(rows) or with_features(rows, *a))
    monkeypatch.setattr(catalog, "search_uploads", lambda uploads, index, *a, **k: index.withColumn("score", F.lit(0.0)))
    index = catalog.search_uploaded(spark, SMALL)
    good = {r[0] for r in catalog.t.membership(spark, SMALL).where("error_code = ''").collect()}
    every = {r[0] for r in catalog.t.media(spark, SMALL).select("attachment_id").collect()}
    read = {r["attachment_id"] for r in given[0].select("attachment_id").collect()}
    assert read == (good & every if most else every)
    _, whole = catalog._probes_and_index(spark, SMALL)
    key = ("attachment_id", "phash", "color_vector", "edge_vector")
    assert pairs_of(index, *key) == pairs_of(whole.where("error_code = ''"), *key)


def test_similarities_of_plain_rows_come_from_rows_prepared_once(spark, monkeypatch):
    rows = library(40, 6)
    q, s = (unpacked(bytes(packed(side, 64).collect()[0]["rows"])) for side in S.with_bits(probes_of(spark, rows), index_of(spark, rows)))
    columns = ["bits", "color_vector", "edge_vector"]
    (batch,) = q.select(["probe_id", *columns]).to_batches()
    given = ["probe_id", "attachment_id", *block_search.part_columns(DEFAULT_PARTS)]
    taken = {}
    for way in ("_products", "_similarities"):
        matcher = block_search._Matcher(DEFAULT_PARTS, 20, None, None, given)
        if way == "_products":
            called = []
            before = block_search._similarities
            monkeypatch.setattr(block_search, "_similarities", lambda *a: called.append(a) or before(*a))
        else:
            monkeypatch.setattr(block_search, "_products", before)
        found = matcher.match(matcher.prepare(s.select(["attachment_id", *columns])), batch)
        taken[way] = {(r["probe_id"], r["attachment_id"]): r for b in found for r in b.to_pylist()}
    assert not called and len(taken["_products"]) > 40 and taken["_products"].keys() == taken["_similarities"].keys()
    for key, row in taken["_products"].items():
        assert list(row) == given and row == pytest.approx(taken["_similarities"][key], abs=1e-12)


def test_scores_at_the_threshold_are_those_of_the_similarities(spark):
    rows = library(30, 7)
    probes, index = probes_of(spark, rows), index_of(spark, rows)
    whole = {(r["probe_id"], r["attachment_id"]): r["score"] for r in every_pair(probes, index).collect()}
    for least in sorted(set(whole.values()))[-4:]:
        found = scored_pairs(*S.with_bits(probes, index), 20, DEFAULT_PARTS, least - 1e-13)
        assert {(r["probe_id"], r["attachment_id"]) for r in found.collect()} == {k for k, v in whole.items() if v >= least - 1e-12}
