"""Operators on small fixtures with known answers."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skytriage import config as cfg
from skytriage.functions import scalars
from skytriage.functions.binomial import clopper_pearson
from skytriage.operators import asof, calibration, decision, discrimination, features, models, novelty, population, recalibration, resample, shift, synthetic, validate, weights
from skytriage.plans import pipeline
from skytriage.sources import readers, sinks

OBS = "object_id long, mjd double, passband int, flux double, flux_err double, detected_bool int"
#: A quick riser, first detected at 58013 (32 / 4 = 8 sigma): three rows up to then, six in two days, eight in seven.
QUICK = [(58010.0, 1, 2.0, 4.0, 0), (58012.25, 2, 6.0, 4.0, 0), (58013.0, 2, 32.0, 4.0, 1), (58013.75, 3, 66.0, 6.0, 1), (58014.5, 2, 90.0, 5.0, 1), (58015.0, 4, 84.0, 7.0, 1), (58016.25, 3, 40.0, 5.0, 1), (58019.5, 5, 30.0, 5.0, 1), (58020.5, 5, 9.0, 5.0, 0), (58026.0, 4, 1.0, 5.0, 0)]
#: A slow one, detected from its first row at 58100 on: one, two and three rows.
SLOW = [(58100.0, 0, 27.0, 3.0, 1), (58101.0, 0, 60.0, 4.0, 1), (58105.0, 1, 200.0, 10.0, 1), (58108.0, 1, 250.0, 10.0, 1), (58112.0, 2, 100.0, 10.0, 1)]
DARK = [(58000.0 + i, 1, 0.6 * i, 5.0, 0) for i in range(3)]


@pytest.fixture(scope="module")
def curves(spark):
    rows = [(7001, *r) for r in QUICK] + [(7002, *r) for r in SLOW] + [(7003, *r) for r in DARK]
    return spark.createDataFrame(rows, OBS)


def test_objects_without_cutoff_drop_out(curves):
    cut = asof.first_detection(curves).where("t0 is not null").selectExpr("object_id", "t0 + 3.5 as cutoff")
    n = {r.object_id: r["count"] for r in asof.truncate_at_mjd(curves, cut).groupBy("object_id").count().collect()}
    assert n == {7001: 7, 7002: 2}


def test_golden_prefixes(curves):
    n = {(r.object_id, r.epoch): r["count"] for r in asof.epoch_sequences(curves).groupBy("object_id", "epoch").count().collect()}
    assert [n[7001, e] for e in (0.0, 2.0, 7.0)] == [3, 6, 8] and [n[7002, e] for e in (0.0, 2.0, 7.0)] == [1, 2, 3]
    assert not any(k[0] == 7003 for k in n)
    t0 = {r.object_id: r.t0 for r in asof.first_detection(curves).collect()}
    assert t0 == {7001: 58013.0, 7002: 58100.0, 7003: None}
    for e in (0.0, 2.0, 7.0):
        one = asof.truncate_at_epoch(curves, e)
        assert one.where("object_id = 7001").count() == n[7001, e]
        asof.assert_leakage_safety(one, asof.first_detection(curves), e)
    with pytest.raises(asof.LeakageError, match="LEAKAGE VIOLATION"):
        asof.assert_leakage_safety(curves, asof.first_detection(curves), 2.0)


def test_forbidden_columns_go(curves):
    bad = curves.withColumns({c: F.lit(1) for c in cfg.FORBIDDEN})
    assert asof.truncate_at_mjd(bad, 60010.0).columns == curves.columns
    assert not set(cfg.FORBIDDEN) & set(asof.epoch_sequences(bad).columns)
    with pytest.raises(ValueError):
        asof.truncate_at_mjd(curves.drop("object_id"), curves.select("object_id", F.lit(1.0).alias("cutoff")))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 30), st.integers(0, 5), st.floats(-500, 5000), st.floats(0.1, 50)), min_size=1, max_size=25))
def test_prefix_properties(spark, rows):
    data = [(1, 60000 + t, b, f, e, int(f / e >= 5)) for t, b, f, e in rows]
    df = spark.createDataFrame(data, OBS)
    seen = [r[1] for r in data if r[5]]
    got = {e: sorted(r.mjd for r in asof.epoch_sequences(df, (0.0, 2.0, 7.0)).where(F.col("epoch") == e).collect()) for e in (0.0, 2.0, 7.0)}
    for e, rows_ in got.items():
        assert rows_ == (sorted(r[1] for r in data if r[1] <= min(seen) + e) if seen else [])
    assert len(got[0.0]) <= len(got[2.0]) <= len(got[7.0])
    if seen:
        later = df.union(spark.createDataFrame([(1, min(seen) + 50.0, 1, 9e9, 1.0, 1)], OBS))
        assert sorted(r.mjd for r in asof.truncate_at_epoch(later, 7.0).collect()) == got[7.0]


def rise(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], OBS)
    return features.rise_rates(asof.epoch_sequences(df, (20.0,))).collect()[0]


def test_rise_rate_cases(spark):
    r = rise(spark, [(0.0, 1, 50.0, 5.0, 1), (2.0, 1, 90.0, 5.0, 1)])
    assert (r.status, r.slope, round(r.slope_err, 9)) == (0, 20.0, round(math.sqrt(50) / 2, 9))
    assert rise(spark, [(0.0, 1, 50.0, 5.0, 1)]).status == scalars.FEW_POINTS
    assert rise(spark, [(0.0, 1, 50.0, 5.0, 1), (0.0, 1, 60.0, 5.0, 1)]).status == scalars.NO_BASELINE
    r = rise(spark, [(60000.0 + x, 1, 50.0 + 10 * x, 5.0, 1) for x in range(5)])
    assert r.status == 0 and abs(r.slope - 10) < 1e-9
    assert rise(spark, [(0.0, 1, 50.0, 0.0, 1), (1.0, 1, 60.0, 5.0, 1), (2.0, 1, 70.0, 5.0, 1)]).status == scalars.FEW_POINTS
    d = features.rise_diagnostics(asof.epoch_sequences(spark.createDataFrame([(1, 60000.0 + x, 1, 50.0 + 10 * x + (x % 2), 5.0, 1) for x in range(5)], OBS), (20.0,))).collect()[0]
    import numpy as np

    t = np.arange(5) + 60000.0
    assert d.n == 5 and abs(10**d.log10_condition / np.linalg.cond(np.stack([np.ones(5), t], 1)) - 1) < 1e-3


def test_color_cases(spark):
    def one(rows):
        return features.colors(asof.epoch_sequences(spark.createDataFrame([(1, *r) for r in rows], OBS), (20.0,))).collect()

    c = one([(0.0, 1, 100.0, 5.0, 1), (0.3, 2, 50.0, 5.0, 1), (0.1, 2, 200.0, 5.0, 1)])[0]
    assert c.status == 0 and abs(c.color - -2.5 * math.log10(0.5)) < 1e-12 and abs(c.min_dt_days - 0.1) < 1e-12
    assert one([(0.0, 1, 100.0, 5.0, 1), (0.6, 2, 50.0, 5.0, 1)])[0].status == scalars.NO_PAIR
    assert one([(0.0, 1, -100.0, 5.0, 1), (0.1, 2, 50.0, 5.0, 1)])[0].status == scalars.NON_POSITIVE
    assert one([(0.0, 1, 100.0, 5.0, 1)]) == []


def test_nearest_pairs_by_brute_force(spark):
    import random

    rnd = random.Random(2)
    rows = [(o, 60000.0 + rnd.randrange(12) / 8, rnd.randrange(4), float(rnd.randrange(5, 9)), 1.0, 1) for o in range(12) for _ in range(rnd.randrange(1, 14))]
    got = {(r.object_id, r.b1): (r.min_dt_days, r.color) for r in features.colors(asof.epoch_sequences(spark.createDataFrame(rows, OBS), (20.0,))).collect()}
    want = {}
    for o in range(12):
        for b in range(5):
            pairs = [(abs(x[1] - y[1]), x[1], x[3], y[1], y[3]) for x in rows for y in rows if x[0] == y[0] == o and x[2] == b and y[2] == b + 1]
            if pairs:
                dt, _, f, _, g = min(pairs)
                want[o, b] = (dt, -2.5 * math.log10(f / g) if dt <= 0.5 else None)
    assert got.keys() == want.keys()
    for k, (dt, hue) in want.items():
        assert got[k][0] == dt and (got[k][1] is None) == (hue is None) and (hue is None or abs(got[k][1] - hue) < 1e-12)


def test_representation_of_unobserved(spark, curves):
    meta = spark.createDataFrame([(7001, 0.3, 0.1), (5, float("nan"), None), (6, 0.5, float("nan"))], "object_id long, hostgal_photoz double, hostgal_photoz_err double")
    rows = {(r.object_id, r.epoch): r for r in features.representation(meta, asof.epoch_sequences(curves), (0.0, 2.0)).collect()}
    assert len(rows) == 6
    none = rows[5, 2.0]
    assert none.alert_snr_0_status == scalars.NO_DETECTION and none.hostgal_photoz_status == scalars.FEW_POINTS and none.well_constrained_features == 0 and none.n_obs_total == 0
    assert rows[6, 0.0].hostgal_photoz_err == 0.0 and rows[6, 0.0].well_constrained_features == 1
    assert rows[7001, 0.0].alert_snr_0 == 8.0 and rows[7001, 0.0].n_obs_total == 3
    assert rows[7001, 2.0].rise_rate_pb2_status == 0 and abs(rows[7001, 2.0].rise_rate_pb2 - 58 / 1.5) < 1e-9


def meta_rows(spark, rows):
    return spark.createDataFrame(rows, "object_id long, hostgal_photoz double, hostgal_photoz_err double, true_target int")


def test_validation(spark):
    good = meta_rows(spark, [(1, 0.1, 0.0, 64), (2, 0.2, 0.1, 90)])
    assert validate.validate_metadata(good).count() == 2
    bad = meta_rows(spark, [(1, -0.1, 0.0, 64), (1, float("nan"), -1.0, None), (None, float("inf"), None, 15)])
    with pytest.raises(validate.SchemaError) as e:
        validate.validate_metadata(bad)
    assert e.value.failures == {"object_id null": 1, "hostgal_photoz not finite": 2, "hostgal_photoz negative": 1, "hostgal_photoz_err negative": 2, "true_target null": 1, "object_id repeated": 1}
    with pytest.raises(validate.SchemaError, match="missing"):
        validate.validate_metadata(good.drop("hostgal_photoz"))
    with pytest.raises(validate.SchemaError, match="outside the study"):
        validate.validate_true_population(meta_rows(spark, [(1, 0.1, 0.1, 15)]))
    with pytest.raises(validate.SchemaError) as e:
        validate.validate_observations(spark.createDataFrame([(1, 60000.0, 7, float("nan"), -2.0, 3)], OBS))
    assert set(e.value.failures) == {"passband not 0 to 5", "flux not finite", "flux_err negative", "detected_bool not 0 or 1"}
    with pytest.raises(ValueError):
        validate.check_boundary(good.withColumn("S", F.lit(0)))
    with pytest.raises(ValueError):
        validate.check_boundary(good, "TRUE")
    with pytest.raises(ValueError):
        validate.check_boundary(good.withColumn("population", F.lit("True")))
    validate.check_boundary(good.withColumn("population", F.lit("biased")).withColumn("S", F.lit(1)))
    with pytest.raises(ValueError):
        validate.check_classes(meta_rows(spark, [(1, 0.1, 0.1, 15)]), "true_target")
    assert validate.overlap(good, good.where("object_id = 1")).first().asDict() == {"n_a": 2, "n_b": 1, "n_both": 1}


def test_config_bounds(tmp_path):
    for bad in ({"p_floor": 0.0}, {"p_bright": 0.05}, {"z_50": 0.0}, {"w_z": -1.0}, {"p_bright": 1.1}):
        with pytest.raises(cfg.ConfigError):
            cfg.SelectionConfig(**bad)
    with pytest.raises(cfg.ConfigError):
        cfg.PopulationConfig(kilonova=65)
    with pytest.raises(cfg.ConfigError):
        cfg.DatasetConfig("a/b.csv")
    with pytest.raises(AttributeError):
        cfg.SelectionConfig().seed = 1
    (tmp_path / "s.yaml").write_text("seed: 7\nz_50: 0.6\n")
    assert cfg.load_yaml(str(tmp_path / "s.yaml"), cfg.SelectionConfig) == cfg.SelectionConfig(seed=7, z_50=0.6)
    (tmp_path / "s.yaml").write_text("sed: 7\n")
    with pytest.raises(cfg.ConfigError):
        cfg.load_yaml(str(tmp_path / "s.yaml"), cfg.SelectionConfig)


def test_selection_contract(spark):
    pop = meta_rows(spark, [(i, i / 200.0, 0.1, (64, 90, 95)[i % 3]) for i in range(400)])
    one = population.select(pop).collect()
    assert [r.S for r in one] == [r.S for r in population.select(pop.repartition(7)).orderBy("object_id").collect()]
    assert [r.S for r in one] != [r.S for r in population.select(pop, cfg.SelectionConfig(seed=1)).collect()]
    p = {r.hostgal_photoz: r.p_spec for r in one}
    assert abs(p[0.5] - 0.45) < 1e-12 and all(0.1 <= x <= 0.8 for x in p.values())
    assert sorted(p.values(), reverse=True) == [p[z] for z in sorted(p)]
    assert population.select(meta_rows(spark, [(1, 1e6, 0.1, 64)])).first().p_spec == 0.1
    assert 0 < sum(r.S for r in one) < 400


def test_shift_by_hand(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 0), (1.0, 1), (3.0, 0)], "x double, S int")
    k = shift.ks(df, "x").first()
    assert (k.n_true, k.n_biased, k.ks) == (4, 2, 0.25)
    assert abs(shift.wasserstein(df, "x").first()[0] - (0.25 * 1 + 0.25 * 2)) < 1e-12
    assert shift.js_divergence(spark.createDataFrame([(1.0, 1), (1.0, 0)], "x double, S int"), "x").first()[0] == 0.0
    assert shift.cohens_d(spark.createDataFrame([(1.0, 1), (1.0, 1)], "x double, S int"), "x").first().cohens_d == 0.0
    p = [r[0] for r in spark.createDataFrame([(0.0, 10, 10), (0.9, 100, 100), (0.3, 30, 40)], "d double, n long, m long").select(shift.ks_p_value(F.col("d"), F.col("n"), F.col("m"))).collect()]
    en = math.sqrt(30 * 40 / 70)
    t = (en + 0.12 + 0.11 / en) * 0.3
    assert p[0] == 1.0 and p[1] < 1e-6 and abs(p[2] - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 50))) < 1e-12


def test_hash_rank_is_a_window_s(spark):
    from pyspark.sql import Window

    df = spark.range(700).select(F.col("id").alias("object_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("c"))
    u = scalars.hash_uniform(5, F.col("object_id"))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(u, "object_id")).cast("long"))
    got = population.hash_rank(df, u, ("c",), rows=50)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 700


def test_zero_sum_and_missing_redshift(spark):
    got = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 3.0, 0.0)], "a double, b double, c double").select(*scalars.normalized(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.0) and tuple(got[1]) == (0.25, 0.75, 0.0)
    rows = [(i, (64, 90, 95)[i % 3], 0.2 + 0.3 * (i % 3 == 0), 0.3, 0.5 - 0.3 * (i % 3 == 0), 1.0, 1, None if i % 2 else float("nan")) for i in range(90)] + [(100, 64, 0.5, 0.3, 0.2, 1.0, 1, 1.6)]
    df = spark.createDataFrame(rows, "object_id long, y int, p_64 double, p_90 double, p_95 double, w double, S int, hostgal_photoz double")
    new = recalibration.SelectionAwareRecalibrator().fit(df).predict(df)
    assert new.where("object_id < 90 and q_64 = p_64").count() == 0 and new.where("object_id = 100 and q_64 <> p_64").count() == 0


def test_ranking_by_hand(spark):
    def run(rows):
        return discrimination.auc(spark.createDataFrame(rows, "x double, hit long"), "x").collect()

    assert run([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)])[0].roc_auc == 0.75
    assert run([(0.5, 1), (0.5, 0)])[0].roc_auc == 0.5
    assert abs(run([(0.9, 1), (0.8, 0), (0.7, 1)])[0].avg_precision - (1 + 2 / 3) / 2) < 1e-12
    assert run([(0.5, 1)])[0].roc_auc is None
    assert discrimination.auc_or_half(spark.createDataFrame([(0.5, 1)], "x double, hit long"), "x") == 0.5


def probabilities(spark, rows):
    return spark.createDataFrame(rows, "object_id long, y int, p_64 double, p_90 double, p_95 double")


def test_calibration_edges(spark):
    sure = probabilities(spark, [(1, 64, 1.0, 0.0, 0.0), (2, 90, 0.0, 1.0, 0.0)])
    assert calibration.brier(sure).first().brier == 0.0 and calibration.murphy(sure).first().mean_ece == 0.0
    edge = spark.createDataFrame([(k * 0.1, k) for k in range(11)] + [(0.3, 2), (0.6, 5)], "p double, b int")
    assert all(r.bin == min(r.b, 9) for r in edge.withColumn("bin", scalars.tenth_bin(F.col("p"))).collect())
    same = probabilities(spark, [(i, 64, 0.2, 0.3, 0.5) for i in range(120)])
    assert calibration.adaptive_bins(same).count() == 0
    few = probabilities(spark, [(i, 64, i / 20.0, 0.5, 0.5) for i in range(20)])
    assert {r.n for r in calibration.adaptive_bins(few).where("class_id = 64").collect()} == {20}
    assert sum(r.n for r in calibration.bin_counts(same).collect()) == 360


def test_weights_and_balance(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "hostgal_photoz double").withColumn("p", scalars.selection_probability(F.col("hostgal_photoz")))
    w = [1 / r.p for r in df.collect()]
    assert abs(w[0] - 1.28) < 0.05 and abs(w[1] - 2.2222) < 1e-3 and abs(w[3] - 10) < 0.01
    d = weights.weight_diagnostics(df.withColumn("w", 1.0 / F.col("p"))).first()
    assert abs(d.ess - sum(w) ** 2 / sum(x * x for x in w)) < 1e-9
    p = weights.positivity(df).first()
    assert (p.n, p.n_affected, p.pct_affected) == (4, 1, 25.0)


def test_novelty(spark):
    ref = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(70)], "f1 double, f2 double")
    fitted = novelty.fit(ref, ["f1", "f2"])
    rows = spark.createDataFrame([(3.0, 2.0), (50.0, 2.0), (3.0, None), (None, None), (3.0, float("nan"))], "f1 double, f2 double")
    s = [r.novelty for r in novelty.score(rows, fitted).collect()]
    assert s[1] > 10 > s[0] and s[3] == 0.0 and s[2] == s[4] == 0.0
    assert novelty.fit(rows.limit(0), ["f1"]) == {"f1": (0.0, 1.0)}
    assert novelty.fit(rows.limit(1), ["f1"]) == {"f1": (3.0, novelty.FLOOR)}
    with pytest.raises(RuntimeError):
        novelty.score(rows, None)


def arm(spark, rows):
    return spark.createDataFrame(rows, "object_id long, epoch double, y int, score double")


def test_decisions(spark):
    rows = [(i, e, 64 if i < 2 else 90, s) for e in (0.0, 2.0, 7.0) for i, s in enumerate([0.9, 0.5, 0.9, 0.2, 0.05])]
    got = {(r.object_id, r.trigger_epoch) for r in decision.sequential(arm(spark, rows), 2, 0.1, 2.0).collect()}
    assert got == {(0, 0.0), (2, 0.0), (1, 2.0), (3, 2.0)}
    assert decision.sequential(arm(spark, rows), 0, 0.1, 2.0).count() == 0
    assert decision.top_k(arm(spark, rows).where("epoch = 0"), 9, 2.0).count() == 0
    objects = arm(spark, rows).where("epoch = 0").select("object_id", "y")
    trig = decision.sequential(arm(spark, rows), 2, 0.1, 2.0)
    out = decision.outcomes(objects, trig)
    r = decision.regret(out, 5).first()
    assert (r.u_policy, r.u_oracle, r.regret, r.mhver) == (2.0, 4.0, 2.0, 0.0) and abs(r.false_trigger_rate - 2 / 3) < 1e-12
    perfect = decision.outcomes(objects, trig.where("object_id < 2"))
    assert decision.regret(perfect, 5).first().regret == 0.0
    j = decision.jackknife(out, 5).first()
    assert j.n_left_out == 2 and (j.regret_min, j.regret_max) == (2.0, 2.0)
    none = decision.regret(decision.outcomes(objects.where("y = 90"), trig), 5).first()
    assert none.mhver == 0.0 and none.target_rate == 0.0
    for cut in (0.0, 0.3, 0.95):
        for k in (1, 3):
            gone, walk = [], []
            for e in (0.0, 2.0):
                best = sorted((-s, i) for i, at, _, s in rows if at == e and s >= cut and i not in gone)[:k]
                walk += [(i, e) for _, i in best]
                gone += [i for _, i in best]
            assert [(r.object_id, r.trigger_epoch) for r in decision.sequential(arm(spark, rows), k, cut, 2.0).collect()] == walk
    with pytest.raises(ValueError):
        scalars.fused_score(F.lit(0.1), F.lit(0.1), 1.0, -0.1)
    assert decision.quota_threshold(arm(spark, rows), 2, 5) == 0.9


@pytest.mark.parametrize("u", [1.0, 2.0, 5.0])
@pytest.mark.parametrize("k", [1, 5, 10])
@pytest.mark.parametrize("w", [0.0, 0.05, 0.1])
def test_oracle_recovery(spark, u, k, w):
    c = cfg.DecisionConfig(u_tp=u, capacity=k, novelty_weight=w)
    objects = spark.createDataFrame([(i, 64 if i < 5 else 90) for i in range(20)], "object_id long, y int")
    trig = spark.createDataFrame([(i, 0.0) for i in range(min(k, 5))], "object_id long, trigger_epoch double")
    r = decision.regret(decision.outcomes(objects, trig, config=c), k, c).first()
    assert r.regret == 0.0 and r.u_policy == u * min(k, 5)


def test_exact_intervals():
    assert clopper_pearson(0, 0) == (0.0, 1.0)
    low, high = clopper_pearson(2, 2)
    assert abs(low - 0.15811388) < 1e-7 and high == 1.0
    assert abs(clopper_pearson(98, 98)[0] - 0.025 ** (1 / 98)) < 1e-9
    low, high = clopper_pearson(19, 133)
    assert abs(low - 0.0882787) < 1e-4 and abs(high - 0.2140797) < 1e-3
    assert clopper_pearson(0, 10)[0] == 0.0 and abs(clopper_pearson(0, 10)[1] - (1 - 0.025**0.1)) < 1e-9


def test_files_go_with_their_scope(spark, tmp_path, monkeypatch):
    """Queries that write on their way leave an empty shared folder when the scope ends, also after an error."""
    from skytriage import queries
    from skytriage.sources import shared

    monkeypatch.setattr(shared, "shared_base", lambda _: f"file://{tmp_path}/shared")
    left = lambda: sorted(p.name for p in (tmp_path / "shared").iterdir())
    for name in ("a18_ks_photoz", "d4_sensitivity_grid", "m3_recalibration", "s7_cached_columns", "s13_colocated_rise_rates"):
        with shared.scope():
            assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert left() == []
    with pytest.raises(ZeroDivisionError), shared.scope():
        shared.kept(spark.range(3), "some")
        with shared.scope():
            shared.kept(spark.range(3), "inner")
        assert len(left()) == 1
        1 / 0
    assert left() == []


def test_content_digests(spark):
    """The same for other partitions and orders, another for a changed, a repeated or a shifted value; parts add up."""
    rows = [(1, "a,b", None), (2, None, "x"), (2, None, "x"), (3, "", "1:a"), (None, None, None)]
    df = spark.createDataFrame(rows, "i long, s string, t string")
    of = lambda d, **k: sinks.content_digest(d, **k).first()
    base = of(df)
    assert base.n == 5 and len(base.digest) == 64
    assert of(df.repartition(4)).digest == of(df.orderBy(F.desc("i")).select("t", "s", "i")).digest == base.digest
    for other in ([*rows[:4], (None, None, "")], rows[:4], [*rows, rows[1]], [(1, "a", "b"), *rows[1:]], [(1, None, "a,b"), *rows[1:]]):
        assert of(spark.createDataFrame(other, df.schema)).digest != base.digest
    assert sinks.added(of(df.where("i = 2")).digest, of(df.where("i is null or i <> 2")).digest) == base.digest
    assert {(r.i, r.n) for r in sinks.content_digest(df, by=("i",)).collect()} == {(1, 1), (2, 2), (3, 1), (None, 1)}
    assert of(df.limit(0)).digest == "0" * 64 and of(df, columns=["i"]).digest != base.digest


def test_policy_grid_is_the_sequential_policy(spark):
    """Every capacity, 0 and one beyond all rows among them, with ties in scores, against one policy at a time."""
    rows = [(i, e, (64, 90, 95)[i % 3], ((i * 7 + e) % 10) / 10, ((i * 3) % 5) / 5) for i in range(60) for e in (0, 2, 7) if (i + e) % 11]
    df = spark.createDataFrame(rows, "object_id long, epoch int, y int, p_64 double, novelty double")
    gains, config = (1.0, 2.5), cfg.DecisionConfig()
    got = {(r.u_tp, r.k, r.weight): r for r in decision.policy_grid(df, 0.3, (0, 1, 4, 50), (0.0, 0.2), gains, 0.35, 2.0).collect()}
    assert len(got) == 16
    objects = df.where("epoch <= 2").select("object_id", "y").distinct()
    for (u, k, w), r in got.items():
        if u == 1.0:
            c = cfg.DecisionConfig(u_tp=u, capacity=k, novelty_weight=w, u_fp=config.u_fp)
            trig = decision.sequential(decision.with_score(df, w, 0.3), k, 0.35, 2.0)
            want = decision.regret(decision.outcomes(objects, trig, config=c), k, c).first()
            assert (r.u_policy, r.u_oracle, r.hits) == (want.u_policy, want.u_oracle, want.hits)
    assert all(got[2.5, k, w].hits == got[1.0, k, w].hits for _, k, w in got)


def test_resampling(spark):
    df = spark.range(4000).select(F.col("id").alias("object_id"), (F.col("id") % 10).cast("double").alias("v"))
    w = resample.replicates(df, 5)
    assert w.exceptAll(resample.replicates(df.repartition(9), 5)).count() == 0
    m = w.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 4000) < 300 for r in m)
    i = resample.interval(resample.mean(df, "v", 40), "v").first()
    assert i.low < 4.5 < i.high and i.high - i.low < 0.4


def test_classifier_and_recalibration(spark):
    rows = spark.range(600).select(F.col("id").alias("object_id"), F.element_at(F.array(F.lit(64), F.lit(90), F.lit(95)), (F.col("id") % 3 + 1).cast("int")).alias("y"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("double") + F.col("id") / 2000.0).alias("f1"), F.lit(1.0).alias("f2"), F.lit(1).alias("S"), (F.col("id") / 300.0).alias("hostgal_photoz"), F.lit(2.0).alias("w"))
    config = cfg.BaselineConfig(rounds=3, depth=2)
    model = models.BaselineClassifier(config).fit_epoch(rows, 2.0, ["f1", "f2"])
    got = model.predict(rows, 2.0)
    assert set(got.columns) == {*rows.columns, "p_64", "p_90", "p_95"}
    assert got.where("abs(p_64 + p_90 + p_95 - 1) > 1e-9 or p_64 < 0 or p_90 < 0 or p_95 < 0").count() == 0
    again = models.BaselineClassifier(config).fit_epoch(rows, 2.0, ["f1", "f2"]).predict(rows, 2.0)
    assert got.select("object_id", F.round("p_64", 9)).exceptAll(again.select("object_id", F.round("p_64", 9))).count() == 0
    with pytest.raises(KeyError):
        model.predict(rows, 7.0)
    with pytest.raises(ValueError):
        models.BaselineClassifier(config).fit_epoch(rows.withColumn("S", F.lit(0)), 2.0, ["f1"])
    two = models.BaselineClassifier(config).fit_epoch(rows.where("y <> 95"), 2.0, ["f1"]).predict(rows, 2.0)
    assert two.where("p_95 <> 0").count() == 0
    with pytest.raises(RuntimeError):
        recalibration.SelectionAwareRecalibrator().predict(got)
    new = recalibration.SelectionAwareRecalibrator().fit(got).predict(got)
    assert new.where("abs(q_64 + q_90 + q_95 - 1) > 1e-9").count() == 0
    assert new.where("hostgal_photoz > 1.5 and q_64 <> p_64").count() == 0 and new.where("hostgal_photoz <= 1.5 and q_64 <> p_64").count() > 0


def test_sources_and_pipeline(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("object_id,hostgal_photoz,hostgal_photoz_err,target,extra\n" + "".join(f"{i},{i / 100},0.1,{(64, 90, 95, 15)[i % 4]},x\n" for i in range(100)))
    out = pipeline.run_all(spark, str(tmp_path / "run"), str(raw))
    assert out.count() == 75 and {"p_spec", "S"} <= set(out.columns)
    text = (tmp_path / "run" / "biased.manifest.json").read_text()
    m = json.loads(text)
    assert text.endswith("}\n") and m["selection"]["overall"]["n_true"] == 75
    assert m["parent_sha256"] == json.loads((tmp_path / "run" / "true.manifest.json").read_text())["sha256"]
    raw.write_text("object_id,hostgal_photoz,hostgal_photoz_err,true_target\n1,nan,0.1,64\n")
    with pytest.raises(validate.SchemaError):
        pipeline.run_stage(spark, "interim", str(tmp_path / "bad"), str(raw))
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    for p, i in ((a, 1), (b, 2)):
        p.write_text(f"object_id,mjd,passband,flux,flux_err,detected\n{i},60000.5,2,50.0,5.0,1\n9,60000.5,2,50.0,NaN,1\n")
    got = readers.extract_objects(spark, [str(a), str(b)], spark.createDataFrame([(1,), (2,)], "object_id long"))
    assert sorted(r.object_id for r in got.collect()) == [1, 2] and "detected_bool" in got.columns
    assert readers.read_csv(spark, str(a), readers.OBSERVATION_SCHEMA, ["object_id", "flux_err"]).where("flux_err is null").count() == 1
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(a), readers.OBSERVATION_SCHEMA, ["nothing"])
    sinks.write_table(got, str(tmp_path / "t"), "csv")
    assert readers.read_csv(spark, str(tmp_path / "t"), readers.OBSERVATION_SCHEMA).count() == 2
    sinks.write_json(str(tmp_path / "m.json"), {"b": float("nan"), "a": [1, 2.5]})
    assert (tmp_path / "m.json").read_text() == '{\n  "a": [\n    1,\n    2.5\n  ],\n  "b": null\n}\n'
    assert "| S |" in sinks.markdown("Report", {"Counts": out.groupBy("S").count().select("S")})
    assert sinks.metrics(out.groupBy("S").count(), "S").keys() == {"0", "1"}


def test_generators(spark):
    """Shares within three points of the study's, at the alert and at two days, and slopes that are recovered."""
    objects = spark.range(6000).withColumnRenamed("id", "object_id")
    assert synthetic.sparsity(objects, 0.0, 64).where("n_det <> 1 or n_passbands <> 1 or det_span_days <> 0").count() == 0
    own = synthetic.sparsity(objects, 2.0, 64)
    share = {(r.n_det, r.n_passbands): r["count"] / 60 for r in own.groupBy("n_det", "n_passbands").count().collect()}
    assert share.keys() == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (5, 3)}
    assert abs(share[1, 1] - 50.0) < 3 and abs(share[2, 1] + share[2, 2] - 43.3) < 3 and abs(share[3, 2] + share[4, 3] - 5.8) < 2
    assert own.where("n_det = 1 and det_span_days <> 0 or det_span_days > 1.8 or n_det > 1 and det_span_days = 0").count() == 0
    other = synthetic.sparsity(objects, 2.0, 90)
    share = {r.n_det: r["count"] / 60 for r in other.groupBy("n_det").count().collect()}
    assert all(abs(share[k] - v) < 3 for k, v in {1: 27, 2: 25, 3: 38, 5: 10}.items())
    assert other.where("n_passbands > n_det or n_passbands not between 1 and 3 or n_det > 1 and det_span_days not between 0.01 and 1.9").count() == 0
    rates = {1: 20.0, 2: 35.0, 3: 50.0}
    curves = synthetic.light_curves(own, rates, {1: 60.0, 2: 80.0, 3: 100.0})
    each = curves.groupBy("object_id").agg(F.count("*").alias("n"), F.count_distinct("passband").alias("b"), F.min("mjd").alias("t"))
    assert each.join(own, "object_id").where("n <> n_det or b <> n_passbands or t <> 58000.0").count() == 0
    many = objects.limit(400).select("object_id", F.lit(6).alias("n_det"), F.lit(1).alias("n_passbands"), F.lit(5.0).alias("det_span_days"))
    found = features.rise_rates(asof.epoch_sequences(synthetic.light_curves(many, rates, {1: 60.0, 2: 80.0, 3: 100.0}), (20.0,))).where("status = 0")
    true = F.element_at(F.create_map(*(F.lit(x) for b, v in rates.items() for x in (b, v))), F.col("passband"))
    assert found.agg(F.avg((F.abs(F.col("slope") - true) < 3 * F.col("slope_err")).cast("double"))).first()[0] > 0.97
    assert synthetic.curve_metadata(own).first().true_target == 64


def test_cached_columns_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "object_id long, mjd double, x string")
    at = str(tmp_path / "columns")
    assert readers.cached_columns(df, at, ["object_id", "mjd"]).count() == 2
    assert readers.cached_columns(df.limit(0), at, ["mjd"]).count() == 2
    assert readers.cached_columns(df.limit(1), at, ["mjd", "x"]).count() == 1  # written again, a column was not there
    import hashlib

    (tmp_path / "t").mkdir()
    for n, text in (("b", "two"), ("a", "one"), ("_hidden", "x")):
        (tmp_path / "t" / n).write_text(text)
    each = [hashlib.sha256(t.encode()).hexdigest() for t in ("one", "two")]
    assert sinks.table_digest(spark, str(tmp_path / "t")) == sinks.table_digest(spark, f"file://{tmp_path}/t") == hashlib.sha256("".join(f"{x}\n" for x in each).encode()).hexdigest()
    assert sinks.sha256_of(str(tmp_path / "t" / "a")) == each[0]


def test_downloads(spark, tmp_path):
    """Against a server of this process: whole files only, targets left alone, several at once."""
    import functools
    import http.server
    import threading

    from skytriage.sources import download

    (tmp_path / "www").mkdir()
    for k in range(5):
        (tmp_path / "www" / f"part-{k}.csv").write_text("x" * (1000 * k) + "\n")

    class Short(http.server.SimpleHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path != "/short":
                return super().do_GET()
            self.send_response(200)
            self.send_header("Content-Length", "100")
            self.end_headers()
            self.wfile.write(b"less")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Short, directory=str(tmp_path / "www")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert download.fetch(f"{at}/part-1.csv", str(tmp_path / "in" / "one.csv")) == 1001
        (tmp_path / "in" / "one.csv").write_text("mine")
        assert download.fetch(f"{at}/part-1.csv", str(tmp_path / "in" / "one.csv")) == 4
        assert download.fetch(f"{at}/part-1.csv", str(tmp_path / "in" / "one.csv"), again=True) == 1001
        with pytest.raises(OSError):
            download.fetch(f"{at}/short", str(tmp_path / "in" / "short.csv"))
        assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["one.csv"]
        got = download.fetch_all(spark, [f"{at}/part-{k}.csv" for k in range(5)], f"file://{tmp_path}/all", at_once=3).collect()
        assert sorted(r.bytes for r in got) == [1000 * k + 1 for k in range(5)]
        assert (tmp_path / "all" / "part-3.csv").stat().st_size == 3001
    finally:
        server.shutdown()


def test_stream_state_is_bounded():
    """Rows leave the state when the watermark passes them, in whatever order they came; ties and late first detections count."""
    from skytriage.streaming import alerts

    rng = __import__("random").Random(3)
    rows = [(60000 + k * 0.25, k >= 5 and k % 3 == 0) for k in range(80)] + [(60002.0, True)]
    state, most = (False, -1.0, [0] * 3, [0] * 3, [0.0] * 3, [], []), 0
    for at in range(0, 81, 9):  # within a batch any order, the next is later
        part = rows[at : at + 9] if at + 9 < 81 else rows[at:]
        rng.shuffle(part)
        state = alerts.release((*state[:5], state[5] + [m for m, _ in part], state[6] + [d for _, d in part]), 60000 + (at - 4) * 0.25, (0.0, 2.0, 7.0))
        most = max(most, len(state[5]))
    state = alerts.release(state, 1e6, (0.0, 2.0, 7.0))
    t0 = min(m for m, d in rows[:80] if d)
    assert most <= 15 and state[1] == t0 and state[5] == []
    want = [[m for m, _ in rows if m <= t0 + e] for e in (0.0, 2.0, 7.0)]
    assert state[2] == [len(w) for w in want] and state[3] == [sum(d for m, d in rows if m <= t0 + e) for e in (0.0, 2.0, 7.0)]


def test_stream_equals_batch(spark, tmp_path):
    from skytriage.streaming import alerts

    base = 1577836800
    rows = [(o, base + int(d * 86400), 40587.0 + (base + int(d * 86400)) / 86400.0, bool(x)) for o, d, x in [(1, 0.5, 0), (1, 1.0, 1), (1, 2.5, 1), (1, 6.0, 0), (1, 12.0, 1), (2, 2.0, 0), (2, 3.0, 1)]]
    for k, part in enumerate((rows[:4], rows[4:], [(3, base + 86400 * 40, 40587.0 + base / 86400.0 + 40, True)], [(3, base + 86400 * 80, 40587.0 + base / 86400.0 + 80, True)])):
        spark.createDataFrame([(o, t, m, d) for o, t, m, d in part], "object_id long, s long, mjd double, det boolean").select("object_id", F.timestamp_seconds("s").alias("ts"), "mjd", "det").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("object_id long, ts timestamp, mjd double, det boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = alerts.prefix_counts(stream).writeStream.format("memory").queryName("prefixes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.object_id, r.epoch): (r.n_obs, r.n_det) for r in spark.table("prefixes").where("object_id < 3").collect()}
    want = {}
    for o in (1, 2):
        own = [r for r in rows if r[0] == o]
        t0 = min(r[2] for r in own if r[3])
        for e in (0.0, 2.0, 7.0):
            inside = [r for r in own if r[2] <= t0 + e]
            want[o, e] = (len(inside), sum(r[3] for r in inside))
    assert got == want


def test_all_objects_are_not_broadcast(spark):
    """The classes of representations' objects come with them or by a merge, however small the objects' file is."""
    from skytriage.query_basics import left_outer
    from skytriage.query_features import constrainability, wide
    from skytriage.query_metrics import _study

    folder = "/root/testdata/sf0.001"
    for df in (left_outer(spark, folder), constrainability(spark, folder), _study(wide(spark, folder), spark, folder)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("Inner" in x or "LeftSemi" in x)]
