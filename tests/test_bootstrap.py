"""The registered bootstraps, 1,000 replicates each, by brute force on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytriage import query_triage as Q
from skytriage.operators import resample as R
from skytriage.plans.views import scored, selected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def drawn(spark):
    """Selected objects and each one's weights in all replicates."""
    rows = selected(spark, SF).select("object_id", "true_target", "S", "hostgal_photoz").orderBy("object_id").collect()
    return rows, R.weights(np.array([r.object_id for r in rows]), 1000, 42).T.astype(float)


def test_weights_are_those_of_the_columns(spark):
    ids = [0, 1, 2, 77, 10**9, 2**32, 2**32 + 1, 2**62 + 5, -3]
    df = spark.createDataFrame([(i,) for i in ids], "object_id long")
    for rate in (1.0, 0.4):
        w = R.weights(np.array(ids), 40, 42, rate).T
        got = {(r.object_id, r.replicate): r.weight for r in R.replicates(df, 40, 42, rate=rate).collect()}
        assert got == {(i, b): int(w[k, b]) for k, i in enumerate(ids) for b in range(40) if w[k, b]}


def test_weights_have_their_law():
    """Mean and variance of Poisson(1); neighbours in object and in replicate are not alike."""
    w = R.weights(np.arange(4000), 1000, 42).T.astype(float)
    assert abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.005
    assert abs(w.mean(axis=0) - 1).max() < 5 / np.sqrt(4000) and abs(w.mean(axis=1) - 1).max() < 5 / np.sqrt(1000)
    shares = np.bincount(w.astype(int).ravel(), minlength=6)[:5] / w.size
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6, 24]), atol=0.001)
    x = w - 1
    assert abs((x[1:] * x[:-1]).mean()) < 0.003 and abs((x[:, 1:] * x[:, :-1]).mean()) < 0.003
    far = R.weights(np.arange(4000) + (7 << 40), 1000, 42).T.astype(float) - 1
    assert abs((x * far).mean()) < 0.003 and abs((x * (R.weights(np.arange(4000), 1000, 43).T - 1.0)).mean()) < 0.003


def test_retention(spark, drawn):
    rows, w = drawn
    s, y = np.array([r.S for r in rows], float), np.array([r.true_target for r in rows])
    kept, all_ = {c: (w[y == c] * s[y == c, None]).sum(axis=0) for c in (64, 90, 95)}, {c: w[y == c].sum(axis=0) for c in (64, 90, 95)}
    got = {(r.replicate, r.true_target): r for r in Q.QUERIES["b6_retention_bootstrap"](spark, SF).collect()}
    assert len(got) == 3000
    for c in (64, 90, 95):
        assert np.allclose([got[b, c].retention for b in range(1000)], kept[c] / all_[c], atol=1e-6)
        assert np.allclose([got[b, c].share_shift for b in range(1000)], kept[c] / sum(kept.values()) - all_[c] / sum(all_.values()), atol=1e-6)
    value = kept[90] / all_[90]
    one = Q.QUERIES["b6_retention_interval"](spark, SF).first()
    assert one.n == 1000 and np.allclose([one.mean, one.low, one.high], [value.mean(), *np.percentile(value, [2.5, 97.5])], atol=1e-6)


def test_shift(spark, drawn):
    rows, w = drawn
    z, s = np.array([r.hostgal_photoz for r in rows], float), np.array([r.S for r in rows])
    own = R.weights(np.array([r.object_id for r in rows])[s == 1], 1000, 43).T.astype(int)
    got = {r.replicate: r for r in Q.QUERIES["b3_shift_bootstrap"](spark, SF).collect()}
    assert sorted(got) == list(range(1000)) and sum(r.ks is not None for r in got.values()) == 100
    for b in (0, 1, 57, 99, 100, 999):
        t, o = np.repeat(z, w[:, b].astype(int)), np.repeat(z[s == 1], own[:, b])
        pooled = np.sqrt(((len(t) - 1) * t.var(ddof=1) + (len(o) - 1) * o.var(ddof=1)) / (len(t) + len(o) - 2))
        want = [o.mean() - t.mean(), np.median(o) - np.median(t), (o.mean() - t.mean()) / pooled]
        assert np.allclose([got[b].mean_shift, got[b].median_shift, got[b].cohens_d], want, atol=2e-6)
        if b < 100:
            x = np.unique(np.concatenate([t, o]))
            f, g = (np.searchsorted(np.sort(v), x, side="right") / len(v) for v in (t, o))
            edges = np.linspace(x[0], x[-1], 101)
            p, q = (np.histogram(v, edges)[0] / len(v) for v in (t, o))
            m = (p + q) / 2
            js = sum((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum() for a in (p, q)) / 2
            assert np.allclose([got[b].ks, got[b].wasserstein, got[b].js], [abs(f - g).max(), (abs(f - g)[:-1] * np.diff(x)).sum(), js], atol=2e-6)


@pytest.mark.parametrize("places", [-1, 0, 2, 9])
def test_ranking(spark, monkeypatch, places):
    """One score for all, scores with many ties and with none, ranges and blocks of a few rows."""
    from skytriage.operators import shift

    monkeypatch.setattr(shift, "RANGE_VALUES", 100)
    monkeypatch.setattr(R, "DRAWS", 20_000)
    df = scored(spark, SF).where("epoch = 2").select("object_id", F.round("p_64", places).alias("x"), (F.col("y") == 64).cast("long").alias("hit"))
    rows = df.collect()
    w = R.weights(np.array([r.object_id for r in rows]), 1000, 42).T.astype(float)
    x, hit = np.array([r.x for r in rows]), np.array([r.hit for r in rows], float)
    got = {r.replicate: r for r in R.ranking(df, "x", 1000).collect()}
    assert sorted(got) == list(range(1000))
    values, which = np.unique(-x, return_inverse=True)
    for b in (0, 3, 500, 999):
        tp, fp = np.bincount(which, w[:, b] * hit), np.bincount(which, w[:, b] * (1 - hit))
        t, f = np.cumsum(tp), np.cumsum(fp)
        auc = (fp * (t - tp / 2)).sum() / (t[-1] * f[-1])
        ap = (tp * np.divide(t, t + f, out=np.zeros_like(t), where=t + f > 0)).sum() / t[-1]
        assert abs(got[b].roc_auc - auc) < 1e-9 and abs(got[b].avg_precision - ap) < 1e-9
    one = R.ranking(df.where("hit = 1"), "x", 5).collect()
    assert len(one) == 5 and all(r.roc_auc is None for r in one)
