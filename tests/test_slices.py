"""Objects of very many rows, co-located tables and mergeable moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytriage.operators import asof, features
from skytriage.operators import moments as M
from skytriage.query_features import colocated_rise_rates
from skytriage.sources.colocated import Colocated, exchanges, of_objects

SF = "/root/testdata/sf0.01"
OBS = "object_id long, mjd double, passband int, flux double, flux_err double, detected_bool int"


def _hot(spark, n):
    """One object of n rows beside small ones; times repeat, and both bands of a pair meet at the edges of slices."""
    rows = spark.range(n).select(F.lit(1).cast("long").alias("object_id"), (60000 + F.floor(F.col("id") / 3) * 0.01 + F.when(F.col("id") % 7 == 0, 0.003).otherwise(0.0)).alias("mjd"), (F.xxhash64("id") % 6).alias("b"), (50 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100))).cast("double").alias("flux"), F.lit(5.0).alias("flux_err"), F.lit(0).alias("detected_bool"))
    rows = rows.withColumn("passband", F.pmod("b", F.lit(6)).cast("int")).drop("b")
    return rows.unionByName(rows.where("mjd < 60000.2").withColumn("object_id", F.lit(2).cast("long"))).unionByName(rows.limit(3).withColumns({"object_id": F.lit(3).cast("long"), "flux": F.lit(0.0)})).select(*(c.split()[0] for c in OBS.split(", ")))


@pytest.mark.parametrize("size", [10, 37, 400])
def test_slices_change_nothing(spark, size):
    obs = _hot(spark, 2000)
    whole, cut = asof.epoch_sequences(obs, (0.0, 2.0, 5.0)), asof.epoch_sequences(obs, (0.0, 2.0, 5.0), slice_rows=size)
    assert cut.groupBy("object_id").agg(F.max("slice").alias("m")).where("object_id = 1").first().m > 0
    assert cut.where("object_id = 3").count() == 0
    assert whole.exceptAll(cut.drop("slice")).count() == 0 and whole.count() == cut.count()
    for f in (features.colors, features.support):
        assert sorted(map(str, f(cut).collect())) == sorted(map(str, f(whole).collect()))


def test_a_hot_object_lies_in_several_tasks(spark):
    """A million rows of one object: no task of the windows gets more than a few slices of it."""
    obs = _hot(spark, 1_000_000)
    cut = asof.epoch_sequences(obs, (4000.0,), slice_rows=50_000).where("object_id = 1 and det")
    met = cut.repartition(16, "object_id", "epoch", "slice").select(F.spark_partition_id().alias("t"), "slice").groupBy("t").count().collect()
    assert len(met) >= 8 and max(r["count"] for r in met) < 300_000
    got = features.colors(cut).collect()
    assert len(got) == 5 and all(r.status == 0 for r in got)


def test_ties_at_one_time(spark):
    rows = [(1, 60000.0, k % 2, 50.0 + k, 5.0, 1) for k in range(40)]
    cut = asof.epoch_sequences(spark.createDataFrame(rows, OBS), slice_rows=4)
    assert {r["slice"] for r in cut.collect()} == {0}
    whole = asof.epoch_sequences(spark.createDataFrame(rows, OBS))
    assert sorted(map(str, features.colors(cut).collect())) == sorted(map(str, features.colors(whole).collect()))


def test_no_exchange_between_scan_and_features(spark):
    before = spark.catalog.listTables()
    out = colocated_rise_rates(spark, SF, 8)
    assert exchanges(out) == 0 and out.count() > 0
    assert len(spark.catalog.listTables()) == len(before), "no table stays in the catalog"


def test_colocated_tables(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    a = Colocated.write(df, f"{tmp_path}/a", "k", ("v",), 4)
    b = Colocated.write(df.where("k < 20").select("k").distinct(), f"{tmp_path}/b", "k", (), 4)
    found = of_objects(a, b).groupBy("k").agg(F.sum("v").alias("s"))
    assert exchanges(found) == 0 and exchanges(df.groupBy("k").count()) == 1
    want = df.where("k < 20").groupBy("k").agg(F.sum("v").alias("s"))
    assert found.exceptAll(want).count() == 0 and found.count() == 20
    a.close()
    again = Colocated(spark, f"{tmp_path}/a", "k bigint, v bigint", "k", ("v",), 4)
    assert exchanges(again.rows().groupBy("k").count()) == 0 and again.rows().count() == 1000
    with pytest.raises(ValueError):
        of_objects(again, Colocated.write(df.limit(5), f"{tmp_path}/c", "k", (), 8))
    Colocated.write(df.limit(7), f"{tmp_path}/a", "k", ("v",), 4).close()
    assert spark.read.parquet(f"{tmp_path}/a").count() == 7


def test_moments_of_far_times(spark):
    """Times near 60,000 are not shifted: chi-square and condition number as from exact fractions."""
    from fractions import Fraction as Q

    rng = np.random.default_rng(2)
    x, e = 60000 + np.sort(rng.uniform(0, 3, 60)), rng.uniform(1, 9, 60)
    y = 100 + 7 * (x - 60000) + rng.normal(0, e)
    rows = [(i % 2, 2.0, 1, float(a), float(b), float(c), True) for i, (a, b, c) in enumerate(zip(x, y, e, strict=True))]
    df = spark.createDataFrame(rows, "object_id long, epoch double, passband int, mjd double, flux double, flux_err double, det boolean")
    for parts in (1, 7):
        for r in features.rise_diagnostics(df.repartition(parts)).collect():
            own = [tuple(map(Q, v[3:6])) for v in rows if v[0] == r.object_id]
            w = [1 / (c * c) for *_, c in own]
            s, mx, my = sum(w), sum(k * a for k, (a, _, _) in zip(w, own, strict=True)) / sum(w), sum(k * b for k, (_, b, _) in zip(w, own, strict=True)) / sum(w)
            cxx, cxy = sum(k * (a - mx) ** 2 for k, (a, _, _) in zip(w, own, strict=True)), sum(k * (a - mx) * (b - my) for k, (a, b, _) in zip(w, own, strict=True))
            chi2 = sum(k * (b - my - cxy / cxx * (a - mx)) ** 2 for k, (a, b, _) in zip(w, own, strict=True))
            assert s and math.isclose(r.chi2_red, float(chi2 / (len(own) - 2)), rel_tol=1e-9)
            t = [a for a, _, _ in own]
            n, st, stt = len(t), sum(t), sum(a * a for a in t)
            det = float(n * stt - st * st)
            top = (n + float(stt) + math.sqrt((n - float(stt)) ** 2 + 4 * float(st) ** 2)) / 2
            assert math.isclose(r.log10_condition, math.log10(top / math.sqrt(det)), rel_tol=1e-9)


def test_moments_merge(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(g), "ab"[i % 2] if i % 5 else None, float(rng.normal(1e6, 2)), float(rng.normal(-3, 1)), float(w)) for i, (g, w) in enumerate(zip(rng.integers(0, 4, 500), rng.uniform(-0.5, 3, 500), strict=True))]
    rows += [(9, "a", 1.0, 2.0, 1.0), (8, "a", None, 1.0, 1.0), (8, "a", 1.0, None, 1.0), (8, "a", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, h string, x double, y double, w double")
    want = {}
    for g, h, x, y, w in rows:
        if x is not None and y is not None and w is not None and w > 0:
            want.setdefault((g, h), []).append((x, y, w))
    for parts in (1, 6):
        got = {(r.g, r.h): r for r in M.moments(df.repartition(parts), ["g", "h"], "x", "y", "w").collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            x, y, w = np.array(v).T
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            assert got[k].n == len(x) and np.allclose([got[k].w, got[k].mx, got[k].my, got[k].tx], [w.sum(), mx, my, x.mean()], rtol=1e-12)
            assert np.allclose([got[k].cxx, got[k].cxy, got[k].cyy, got[k].txx], [(w * (x - mx) ** 2).sum(), (w * (x - mx) * (y - my)).sum(), (w * (y - my) ** 2).sum(), ((x - x.mean()) ** 2).sum()], rtol=1e-9, atol=1e-9)
    one = M.moments(df, [], "x", "y", "w").first()
    assert one.n == sum(map(len, want.values()))
    assert M.moments(df.limit(0), ["g"], "x", "y", "w").count() == 0
