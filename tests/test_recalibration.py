"""Recalibration against a plain Newton on all rows, at any partitioning, on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytriage.operators.recalibration import SelectionAwareRecalibrator, newton

SCHEMA = "object_id long, y int, p_64 double, p_90 double, p_95 double, w double, S int, hostgal_photoz double"


def _rows(n=500, seed=3):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([2, 1, 1], n)
    y = [int(rng.choice([64, 90, 95], p=0.6 * q + 0.4 * np.roll(q, 1))) for q in p]
    return [(i, y[i], *map(float, p[i]), float(rng.uniform(1, 10)), 1, float(rng.uniform(0, 2))) for i in range(n)]


def _plain(rows, strength=1.0):
    """Dense Newton on the likelihood of all rows at once, by finite formulas of the 12 x 12 Hessian."""
    x = np.array([[*np.log(np.clip(r[2:5], 1e-7, 1 - 1e-7)), 1.0] for r in rows])
    y, w = np.array([(64, 90, 95).index(r[1]) for r in rows]), np.array([r[5] for r in rows])
    t, pen = np.zeros(12), np.diag([1.0, 1, 1, 0] * 3)
    for _ in range(60):
        g, h = pen @ t, pen.copy()
        for xi, yi, wi in zip(x, y, w, strict=True):
            z = t.reshape(3, 4) @ xi
            p = np.exp(z - z.max())
            p /= p.sum()
            g += strength * wi * np.kron(p - np.eye(3)[yi], xi)
            h += strength * wi * np.kron(np.diag(p) - np.outer(p, p), np.outer(xi, xi))
        step = np.linalg.pinv(h) @ g
        t = t - step
        if np.abs(step).max() < 1e-12:
            break
    z = x @ t.reshape(3, 4).T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("strength", [1.0, 0.01])
def test_against_a_plain_newton(spark, strength):
    rows = _rows()
    want = _plain(rows, strength)
    got = []
    for parts in (1, 5, 11):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        model = SelectionAwareRecalibrator(strength).fit(df)
        got.append(np.array([[r.q_64, r.q_90, r.q_95] for r in model.predict(df.withColumn("hostgal_photoz", F.lit(0.1))).orderBy("object_id").collect()]))
        assert np.abs(got[-1] - want).max() < 1e-9
    assert np.abs(got[0] - got[1]).max() < 1e-11 and np.abs(got[0] - got[2]).max() < 1e-11


def test_separated_classes_and_huge_weights(spark):
    rows = [(i, (64, 90, 95)[i % 3], *(1.0 if i % 3 == k else 0.0 for k in range(3)), 1e6 if i % 2 else 1e-6, 1, 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = SelectionAwareRecalibrator().fit(df).predict(df).collect()
    assert all(max((r.q_64, 64), (r.q_90, 90), (r.q_95, 95))[1] == r.y for r in out)
    assert all(abs(r.q_64 + r.q_90 + r.q_95 - 1) < 1e-12 for r in out)


def test_fewer_classes_and_missing_values(spark):
    rows = _rows(120)
    two = spark.createDataFrame([r for r in rows if r[1] != 95], SCHEMA)
    out = SelectionAwareRecalibrator().fit(two).predict(two.withColumn("hostgal_photoz", F.lit(None).cast("double"))).collect()
    assert {r.q_95 for r in out} == {0.0} and all(abs(r.q_64 + r.q_90 - 1) < 1e-12 for r in out)
    one = spark.createDataFrame([r for r in rows if r[1] == 90], SCHEMA)
    assert {(r.q_64, r.q_90, r.q_95) for r in SelectionAwareRecalibrator().fit(one).predict(one).where("hostgal_photoz <= 1.5").collect()} == {(0.0, 1.0, 0.0)}
    holes = spark.createDataFrame([*rows, (900, None, 0.2, 0.3, 0.5, 1.0, 1, 0.1), (901, 64, None, 0.3, 0.5, 1.0, 1, 0.1), (902, 64, 0.2, 0.3, 0.5, None, 1, 0.1)], SCHEMA)
    a, b = SelectionAwareRecalibrator().fit(holes), SelectionAwareRecalibrator().fit(spark.createDataFrame(rows, SCHEMA))
    assert np.allclose(a.theta, b.theta, atol=1e-10)
    assert a.predict(holes).where("object_id = 901").first().q_64 is None
    with pytest.raises(ValueError):
        SelectionAwareRecalibrator().fit(two.limit(0))
    with pytest.raises(ValueError):
        SelectionAwareRecalibrator().fit(two.withColumn("S", F.lit(0)))


def test_beyond_the_cutoff_raw_probabilities_stay(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    out = SelectionAwareRecalibrator(cutoff=0.8).fit(df).predict(df)
    assert out.where("hostgal_photoz > 0.8 and (q_64 <> p_64 or q_90 <> p_90 or q_95 <> p_95)").count() == 0
    assert out.where("hostgal_photoz <= 0.8 and q_64 = p_64").count() == 0


def test_steps_are_halved():
    """A loss whose full first step overshoots still ends at its minimum."""
    seen = []

    def sums(t):
        x = t[1, 0] - t[0, 0]
        seen.append(x)
        loss = 10 * (np.sqrt(1 + (x - 30) ** 2) - 1)
        d, dd = 10 * (x - 30) / np.sqrt(1 + (x - 30) ** 2), 10 / (1 + (x - 30) ** 2) ** 1.5
        g = np.array([-d, 0, d, 0])
        h = np.zeros((4, 4))
        h[np.ix_([0, 2], [0, 2])] = dd * np.array([[1, -1], [-1, 1]])
        return np.concatenate([[loss], g, h.ravel()])

    t = newton(sums, 2, 2, 1.0)
    x = t[1, 0] - t[0, 0]
    assert abs(10 * (x - 30) / np.sqrt(1 + (x - 30) ** 2) + x / 2) < 1e-6 and len(seen) > 3
