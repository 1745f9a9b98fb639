import numpy as np
from pyspark.sql import functions as F

from mediamatch.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, query_id string, vector string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "?", "?", "?", "?") for i, v in rows], SCHEMA)


def brute(rows, k, every=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            score = (x * v).sum(1)
            order = [j for j in np.lexsort([ids, -score]) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in own}) for q, own in want.items()) / sum(map(len, want.values()))


def test_recall_on_clusters_of_unequal_norms(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 16))
    x = centres[rng.integers(0, 12, 3000)] * rng.uniform(0.5, 2, (3000, 1)) + rng.normal(0, 0.4, (3000, 16))
    rows = list(enumerate(x))
    got, want = found(nn.search(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows, 20)
    assert recall(got, want) >= 0.9 and set(got) == set(want)
    exact = {(q, i): s for q, own in brute(rows, 3000).items() for i, s in own}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, own in got.items() for i, s in own)
    assert all(own == sorted(own, key=lambda r: (-r[1], r[0])) for own in got.values())


def test_a_vector_that_a_third_of_rows_share(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(nn, "SHARE_QUERIES", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 8))
    x[::3] = x[0]
    rows = list(enumerate(x))
    got, want = found(nn.search(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows, 20)
    shared = [q for q in want if q % 3 == 0]
    assert shared and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in shared)
    assert recall(got, want) >= 0.9


def test_tree_walk_reaches_every_leaf_once():
    points = np.random.default_rng(3).normal(0, 1, (2000, 6))
    tree = nn.fit_tree(points, 8, 50)
    assert sorted(nn.best_bins(tree, points[0], 10**6)) == list(range(tree.leaves)) and tree.leaves > 20
    assert nn.best_bins(tree, points[0], 5) == nn.best_bins(tree, points[0], 10**6)[:5]
    leaf = nn.leaves_of(tree, points)
    assert np.mean([nn.best_bins(tree, p, 1)[0] == own for p, own in zip(points[:200], leaf)]) > 0.5


def test_unusable_few_repeated_and_no_vectors(spark):
    bad = [(1, None), (2, []), (20, [0, 0]), (3, [1, None]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [1, 2, 3]), (None, [1, 1])]
    good = [(0, [1, 0]), (40, [0, 1]), (7, [1, 1]), (8, [1, 1]), (8, [1, 1]), (-3, [-1, 0])]
    got = found(nn.search(table(spark, bad + good), F.col("vec_id") % 20 == 0))
    assert got == {
        0: [(7, 1.0), (8, 1.0), (8, 1.0), (40, 0.0), (-3, -1.0)],
        40: [(7, 1.0), (8, 1.0), (8, 1.0), (-3, 0.0), (0, 0.0)],
    }
    assert nn.search(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nn.search(table(spark, bad), F.col("vec_id") % 20 == 0).collect() == []
    assert nn.search(table(spark, [(1, [1, 2])]), F.col("vec_id") % 20 == 0).collect() == []
    assert nn.search(table(spark, [(20, [1, 2])]), F.col("vec_id") % 20 == 0).collect() == []


def test_ties_go_to_smaller_ids():
    rng = np.random.default_rng(7)
    vectors = rng.integers(0, 2, (2000, 12)).astype(float)
    vectors[:, 0] = 1
    ids = rng.permutation(5000)[:2000].astype(np.int64)
    queries, q_ids = vectors[:20], ids[:20]
    found = [np.concatenate(x) for x in zip(*nn.nearest_in(q_ids, queries, ids, vectors, 20))]
    for q, vector in zip(q_ids, queries):
        scores = vectors @ vector
        want = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:20]
        mine = found[0] == q
        assert list(zip(-found[2][mine], found[1][mine])) == want
