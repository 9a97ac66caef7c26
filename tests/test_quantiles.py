"""Exact percentiles against NumPy: groups, columns, odd values, heavy ties, and how many scans they take."""

import math

import numpy as np
import pyarrow as pa
import pytest

from skytriage.operators import quantiles as Q


def test_keys_keep_the_order():
    x = np.array([-math.inf, -1e300, -1.5, -1e-310, 0.0, 5e-324, 1e-10, 1.0, 1.0 + 2**-52, 3.5, 1e300, math.inf])
    k = Q.keys_of(x)
    assert (k[1:] > k[:-1]).all() and (Q.values_of(k) == x).all()
    assert Q.keys_of(np.array([-0.0]))[0] == Q.keys_of(np.array([0.0]))[0]


@pytest.mark.parametrize("few,bits", [(50_000, 16), (40, 16), (0, 8), (0, 16)])
def test_groups_columns_and_shares_at_once(spark, monkeypatch, few, bits):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BITS", bits)
    rng = np.random.default_rng(4)
    rows = [(int(g), "ab"[i % 2] if i % 31 else None, None if i % 50 == 0 else float("nan") if i % 51 == 0 else float(np.round(rng.normal(), 1 if g else 6)), float(10.0 ** rng.uniform(-200, 200)) * (-1) ** i) for i, g in enumerate(rng.integers(0, 3, 900))]
    rows += [(7, "a", 2.5, 0.0), (8, "a", None, None)] + [(9, "b", 1.0, -0.0)] * 400 + [(10, "b", math.inf, -math.inf)]
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g int, h string, x double, y double").repartition(5)
    got = Q.percentiles_of(df, ["x", "y"], shares, ("g", "h"))
    want = {}
    for g, h, *values in rows:
        for name, v in zip("xy", values, strict=True):
            if v is not None and not math.isnan(v):
                want.setdefault((name, g, h), []).append(v)
    assert set(got) == set(want)
    assert got.pop(("x", 10, "b")) == [math.inf] * 5 and got.pop(("y", 10, "b")) == [-math.inf] * 5
    for k, v in want.items():
        if k not in got:
            continue
        assert np.array_equal(got[k], np.quantile(v, shares)) or np.allclose(got[k], np.quantile(v, shares), rtol=1e-12, atol=0), k
    assert Q.percentiles(df.limit(0), "x", shares) == {} and Q.percentiles(df.where("g = 8"), "x", shares) == {}
    assert Q.percentiles(df, "g", [0.5]) == {(): [float(np.median([r[0] for r in rows]))]}
    by_number = Q.percentiles(df, "x", lambda n: [0.0, 1.0] if n > 350 else [0.5], ("g",))
    assert len(by_number[9,]) == 2 and len(by_number[7,]) == 1


def test_scans(spark, monkeypatch):
    """Two scans where few rows are left in a prefix; one value that all rows share takes no more than the bits need."""
    scans = []
    real = Q._scan
    monkeypatch.setattr(Q, "_scan", lambda *a: scans.append(a[-1]) or real(*a))
    df = spark.range(20_000).selectExpr("cast(id as double) / 7 as x", "1.25D as one")
    assert Q.percentiles(df, "x", [0.25])[()] == [19_999 / 4 / 7]
    assert scans == [16, 64]
    scans.clear()
    monkeypatch.setattr(Q, "FEW", 5_000)
    assert Q.percentiles_of(df, ["x", "one"], [0.5]) == {("x",): [19_999 / 2 / 7], ("one",): [1.25]}
    assert scans == [16, 32, 48, 64]


def test_only_counts_leave_a_task(spark):
    df = spark.range(100_000).selectExpr("cast(id % 10 as double) as x")
    hist = Q._scan(df, ["x"], (), None, 0, 16)
    assert len(hist[0,][0]) == 10 and hist[0,][1].sum() == 100_000


def test_groups_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"a": [1, None, 1, None], "b": ["x", "x", None, "x"]})
    number, names = Q._numbered(batch, 2)
    assert [names[k] for k in number] == [(1, "x"), (None, "x"), (1, None), (None, "x")]
    assert Q._numbered(batch, 0)[1] == [()]


def test_what_the_driver_gets_is_bounded(spark, monkeypatch):
    """Many groups and shares of values that are nearly all different: no scan after the first sends more than 2^18 counts."""
    sent = []
    real = Q._scan
    monkeypatch.setattr(Q, "_scan", lambda *a: (found := real(*a), sent.append(sum(len(p) for p, _ in found.values())))[0])
    df = spark.range(0, 900_000, 1, 4).selectExpr("id % 9 as g", "pmod(id * 7919, 900001) / 900001D as x")
    shares = [i / 20 for i in range(21)]
    got = Q.percentiles(df, "x", shares, ("g",))
    assert max(sent[1:]) <= 1 << 18 and len(sent) <= 4
    i = np.arange(900_000)
    x = i * 7919 % 900001 / 900001
    assert set(got) == {(g,) for g in range(9)}
    for g in range(9):
        assert np.allclose(got[g,], np.quantile(x[i % 9 == g], shares), rtol=1e-13, atol=0)
