"""Neighbours against brute force."""

import math

import numpy as np
import pytest

from skytriage.llm import hash_forest as H


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in {i: v for i, v in good if i in queries}.items():
        near = {}
        for i, x in good:
            if i != q and len(x) == len(v):
                s = float(x @ v / math.sqrt(x @ x) / math.sqrt(v @ v))
                near[i] = max(s, near.get(i, -2))
        out[q] = sorted(((-round(s, 12), i) for i, s in near.items()))[:k]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(150)] + [(500, None), (None, [1.0] * 6), (550, [0.0] * 6), (600, [float("nan")] + [1.0] * 5), (650, [None] + [1.0] * 5), (700, [float("inf")] * 6), (750, [1.0, 1.0]), (800, [2.0, 1.0]), (850, [])]
    rows += [(7, rows[7][1]), (50, rows[50][1]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    queries = {i for i, _ in rows if i is not None and i % 50 == 0}
    got = collect(H.nearest(df, df.where("vec_id % 50 = 0"), fitted=(0, 1.0)))
    assert got == brute(rows, queries, 5)
    assert H.nearest(df.limit(0), df).count() == 0
    assert H.nearest(df, df.limit(0)).count() == 0
    single = df.where("vec_id = 100")
    assert H.nearest(single, single).count() == 0


def test_repeated_rows_leave_room_for_equal_vectors(spark):
    rows = [(1, [1.0, 2.0])] * 20 + [(i, [1.0, 2.0]) for i in (2, 3, 4)] * 4 + [(9, [1.0, -1.0]), (10, [2.0, 3.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(H.nearest(df, df.where("vec_id in (1, 9, 10)"), fitted=(0, 1.0)))
    assert got == brute(rows, {1, 9, 10}, 5)
    assert [i for _, i in got[10]] == [1, 2, 3, 4, 9]


def _true(v, queries, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[q]
        s[q] = -2
        out[q] = set(np.argpartition(-s, k)[:k].tolist())
    return out


def fit(v, k=5, shards=1):
    """The fit to a table that is its own sample."""
    v = v.astype(np.float64)
    score, near = H.true_neighbours(v, v[: H.FIT_QUERIES], k)
    return H.fit(v[: H.FIT_ROWS], v[: H.FIT_QUERIES], [x[s > -np.inf] for s, x in zip(score, near, strict=True)], shards)


def recall(spark, v, parts=4):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(parts)
    queries = range(0, len(v), 50)
    true, got = _true(v.astype(np.float64), queries), collect(H.nearest(df, df.where("vec_id % 50 = 0")))
    assert set(got) == set(queries)
    return sum(len(true[q] & {i for _, i in got[q]}) for q in queries) / sum(map(len, true.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    queries = {i for i, _ in rows if i % 50 == 0}
    true = brute(rows, queries, 5)
    got = collect(H.nearest(df, df.where("vec_id % 50 = 0")))
    hit = sum(len({i for _, i in true[q]} & {i for _, i in got[q]}) for q in queries)
    assert hit >= 0.9 * sum(map(len, true.values()))
    for q in queries:  # what is found has its own score and place
        rank = {i: s for s, i in brute(rows, {q}, len(rows))[q]}
        assert all(abs(rank[i] - s) < 1e-11 for s, i in got[q])


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_larger_tables(spark, clustered):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((10_000 if not clustered else 30_000, 64)).astype(np.float32)
    if clustered:
        v = v[rng.integers(0, 300, len(v))] + 0.25 * rng.standard_normal(v.shape).astype(np.float32)
    bits, share = fit(v[rng.permutation(len(v))])
    assert share < (0.75 if not clustered else 0.3)
    assert recall(spark, v) >= 0.9


def test_lengths_have_fits_of_their_own(spark, monkeypatch):
    """Clusters of one length beside random vectors of another: each reaches the recall, and few rows of a third are exact."""
    monkeypatch.setattr(H, "FIT_ROWS", 1000)
    monkeypatch.setattr(H, "SHARD_ROWS", 1500)
    rng = np.random.default_rng(12)
    a = (rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] + 1e-3 * rng.standard_normal((3000, 32))).astype(np.float32)
    b, c = rng.standard_normal((1500, 64)).astype(np.float32), rng.standard_normal((200, 8)).astype(np.float32)
    rows = [(i, x) for i, x in enumerate([*a.tolist(), *b.tolist(), *c.tolist()])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    fits = H._fits(df.selectExpr("vec_id as id", "embedding as v"), 5)
    assert set(fits) == {32, 64} and fits[32][1] < 0.3 < fits[64][1]
    got = collect(H.nearest(df, df.where("vec_id % 50 = 0")))
    start = 0
    for part, least in ((a, 0.9), (b, 0.9), (c, 1.0)):
        queries = [q for q in range(-(-start // 50) * 50 - start, len(part), 50)]
        true = _true(part.astype(np.float64), queries)
        hit = sum(len(true[q] & {i - start for _, i in got[q + start]}) for q in queries)
        assert hit >= least * 5 * len(queries)
        start += len(part)


def test_no_query_meets_all_shards(spark, monkeypatch):
    """Queries find their shards by search: the plan joins nothing, and rows of work are those of the prefix's ranges."""
    monkeypatch.setattr(H, "SHARD_ROWS", 200)
    rng = np.random.default_rng(13)
    v = rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    out = H.nearest(df, df.where("vec_id % 50 = 0"), fitted=(4, 1.0))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    route = H.routes(v)
    near = {}
    for r in out.collect():
        near.setdefault(r.query_id, []).append(r.vec_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, found in near.items():  # with the whole of each shard scored, all of the prefix's rows have been met
        own = np.flatnonzero(route >> np.uint64(28) == route[q] >> np.uint64(28))
        own = own[own != q]
        best = own[np.argmax(u[own] @ u[q])]
        assert u[found[0]] @ u[q] >= u[best] @ u[q] - 1e-12


def test_queries_go_to_the_ranges_of_their_prefix(spark, monkeypatch):
    """Tight clusters are told apart by the routing string, and a query leaves most shards alone."""
    monkeypatch.setattr(H, "SHARD_ROWS", 500)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((40, 32))[rng.integers(0, 40, 8000)] + 1e-3 * rng.standard_normal((8000, 32))
    bits, share = fit(v, shards=16)
    assert bits >= 2
    assert recall(spark, v.astype(np.float32)) >= 0.9


def test_ties_hold_at_any_partitioning(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((6, 64)).astype(np.float32)
    rows = [(i, base[i % 6].tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = []
    for most, parts in ((10_000, 1), (40, 5), (7, 3)):
        monkeypatch.setattr(H, "SHARD_ROWS", most)
        out.append(sorted(map(tuple, H.nearest(df.repartition(parts), df.where("vec_id % 50 = 0"), fitted=(0, 1.0)).collect())))
    assert out[0] == out[1] == out[2]
    assert all(r[2] % 6 == r[0] % 6 for r in out[0])


def test_small_tables_go_through_the_forest():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 3)) * 0.05 + np.repeat(np.eye(4, 3)[:, :] + 1, 10, axis=0)
    bits, share = fit(v)
    assert share < 1.0 and fit(v[:1]) == (0, 1.0) and fit(v[:3])[1] <= 1.0


def test_true_neighbours_by_brute_force():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 8))
    best = None
    for at in range(0, 300, 70):
        best = H.true_neighbours(v[at : at + 70], v[:9], 4, best)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(9):
        s = u @ u[q]
        s[q] = -2
        want = np.argsort(-s)[:4]
        order = np.argsort(-best[0][q])
        assert np.allclose(best[0][q][order], s[want], atol=1e-6) and np.allclose(best[1][q][order], v[want])


def test_forest_meets_more_when_asked():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 32)).astype(np.float32)
    forest, own = H.Forest(v), H.strings(v[:5])
    for q in range(5):
        few, many = forest.candidates(own[:, q], 20), forest.candidates(own[:, q], 900)
        assert len(few) >= 20 and len(many) >= 900 and q in few
        assert len(forest.candidates(own[:, q], 3000)) == 3000
