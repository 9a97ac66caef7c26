"""Components against union-find, in one partition and in several."""

import random

import pytest

from skytriage.llm import components as C


def test_too_few_rounds_raise(spark, monkeypatch):
    monkeypatch.setattr(C, "ONE_TASK", 0)
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="converged"):
        C.connected_components(links, most_rounds=2)


@pytest.mark.parametrize("one_task", [1 << 16, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    rnd = random.Random(6)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(80)] + [(7, 7), (-5, 1000)]
    root = {x: x for p in links for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {x: top(x) for p in links for x in p if p[0] != p[1]}
    got = C.connected_components(spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_rows_follow_members(spark, monkeypatch, held):
    """5,000 members with links to nine pivots each: a task leaves a link a member, whatever it holds at a time."""
    monkeypatch.setattr(C, "HELD", held)
    links = [(p, m) for p in range(9) for m in range(10, 5010)]
    thin = C._thinned(spark.createDataFrame(links, "u long, v long").coalesce(1))
    if held > len(links):
        assert thin.count() == 5008
    got = {r.node: r.root for r in C.connected_components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == {x: 0 for p in links for x in p}


def test_forest():
    import numpy as np

    rng = np.random.default_rng(3)
    chain = np.arange(5000)
    u, v = C.forest(chain[1:][::-1].copy(), chain[:-1][::-1].copy())
    assert len(u) == 4999 and not v.any()
    a, b = rng.integers(-50, 400, 300), rng.integers(-50, 400, 300)
    u, v = C.forest(a, b)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    top = lambda x: root.get(x, x)
    assert len(root) == len(u) and all(top(x) == top(y) and top(x) <= x for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert not set(u.tolist()) & set(v.tolist())
