"""Queries on validation, populations and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import SelectionConfig
from .functions.scalars import MAGNITUDES, absolute_magnitude_r, clipped_log, expected_snr, hash_uniform, inverse_weight
from .operators import population as P
from .operators import validate as V
from .plans.views import META_SQL, OBS_SQL, POP_SQL, SEL_SQL, metadata, observations, population, selected, sel_sql, uniform_sql
from .query_features import r6
from .registry import Registry, rounded

query = Registry()
_SOUND = "hostgal_photoz IS NOT NULL AND NOT isnan(hostgal_photoz) AND abs(hostgal_photoz) < 'inf'::DOUBLE"


def _rules_sql(source: str, rules: dict[str, str], unique: str | None = None) -> str:
    parts = [f"SELECT '{k}' AS rule, count(*) FILTER ({c}) AS n FROM {source}" for k, c in rules.items()]
    if unique:
        parts.append(f"SELECT '{unique} repeated' AS rule, (count(*) - count(DISTINCT {unique}))::BIGINT AS n FROM {source}")
    return " UNION ALL ".join(parts)


_META_RULES = {"object_id null": "object_id IS NULL", "hostgal_photoz not finite": f"NOT ({_SOUND})", "hostgal_photoz negative": "hostgal_photoz < 0", "hostgal_photoz_err negative": "hostgal_photoz_err IS NULL OR hostgal_photoz_err < 0", "true_target null": "true_target IS NULL"}
_OBS_RULES = {"object_id null": "object_id IS NULL", "mjd not finite": "mjd IS NULL", "passband not 0 to 5": "passband IS NULL OR passband NOT BETWEEN 0 AND 5", "flux not finite": "flux IS NULL", "flux_err not finite": "flux_err IS NULL", "flux_err negative": "flux_err < 0", "detected_bool not 0 or 1": "detected_bool NOT IN (0, 1)"}


@query("v1_validate_metadata", f"WITH {META_SQL} {_rules_sql('meta', _META_RULES, 'object_id')}")
def validate_metadata(spark, sf_dir):
    return V.failures(metadata(spark, sf_dir), V.metadata_rules(), "object_id")


@query("v3_validate_population", f"WITH {POP_SQL} {_rules_sql('pop', _META_RULES | {'true_target outside the study': 'true_target NOT IN (64, 90, 95)'}, 'object_id')}")
def validate_population(spark, sf_dir):
    return V.failures(population(spark, sf_dir), V.population_rules(), "object_id")


@query("v4_validate_observations", f"WITH {OBS_SQL} {_rules_sql('obs', _OBS_RULES)}")
def validate_observations(spark, sf_dir):
    return V.failures(observations(spark, sf_dir), V.observation_rules())


@query("v6_finite_photoz", f"WITH {POP_SQL} SELECT count(*) AS n, count(*) FILTER ({_SOUND}) AS n_finite FROM pop")
def finite_photoz(spark, sf_dir):
    ok = ~V.metadata_rules()["hostgal_photoz not finite"][1]
    return population(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_finite"))


@query("v8_boundary_rows", f"WITH {SEL_SQL} SELECT S, upper(CASE WHEN S = 1 THEN 'Biased' ELSE 'true' END) AS population, count(*) AS n FROM sel GROUP BY ALL")
def boundary(spark, sf_dir):
    rows = selected(spark, sf_dir).withColumn("population", F.when(F.col("S") == 1, "Biased").otherwise("true"))
    V.check_boundary(rows.where("S = 1"))
    return rows.groupBy("S", F.upper("population").alias("population")).agg(F.count("*").alias("n"))


@query("v9_class_domain", f"WITH {POP_SQL} SELECT DISTINCT true_target, true_target IN (64, 90, 95) AS allowed FROM pop")
def class_domain(spark, sf_dir):
    return population(spark, sf_dir).select("true_target").distinct().withColumn("allowed", F.col("true_target").isin(64, 90, 95))


def _overlap_sql(a: str, b: str) -> str:
    return f"SELECT (SELECT count(*) FROM {a}) AS n_a, (SELECT count(*) FROM {b}) AS n_b, (SELECT count(*) FROM (SELECT object_id FROM {a} INTERSECT SELECT object_id FROM {b})) AS n_both"


@query("v10_disjointness", f"WITH {SEL_SQL}, a AS (SELECT object_id FROM sel WHERE S = 1), b AS (SELECT object_id FROM sel WHERE S = 0) {_overlap_sql('a', 'b')}")
def disjointness(spark, sf_dir):
    sel = selected(spark, sf_dir)
    return V.overlap(sel.where("S = 1"), sel.where("S = 0"))


@query("v10_overlap", f"WITH {SEL_SQL}, a AS (SELECT object_id FROM sel WHERE S = 1), b AS (SELECT object_id FROM sel WHERE true_target = 64) {_overlap_sql('a', 'b')}")
def overlap(spark, sf_dir):
    """Two sets that do meet."""
    sel = selected(spark, sf_dir)
    return V.overlap(sel.where("S = 1"), sel.where("true_target = 64"))


@query("p1_class_filter", f"WITH {POP_SQL} SELECT object_id, true_target, {r6('hostgal_photoz')} FROM pop WHERE true_target IN (64, 90, 95)")
def class_filter(spark, sf_dir):
    return rounded(P.true_population(population(spark, sf_dir)).select("object_id", "true_target", "hostgal_photoz"))


@query("p2_held_out_class", f"WITH {POP_SQL} SELECT object_id, true_target FROM pop WHERE true_target = 15 ORDER BY object_id LIMIT 500")
def held_out(spark, sf_dir):
    return P.held_out(population(spark, sf_dir), 15, 500).select("object_id", "true_target")


@query("p7_membership_flag", f"WITH {META_SQL}, {OBS_SQL} SELECT object_id, (object_id IN (SELECT object_id FROM obs))::INT AS S FROM meta")
def membership(spark, sf_dir):
    return P.membership(metadata(spark, sf_dir), observations(spark, sf_dir)).select("object_id", "S")


@query("p8_absolute_magnitude", f"WITH {POP_SQL} SELECT object_id, round(-19.3::DOUBLE + distmod + 3.1::DOUBLE * mwebv, 6) AS m_r FROM pop")
def magnitude(spark, sf_dir):
    return rounded(population(spark, sf_dir).select("object_id", absolute_magnitude_r(F.col("distmod"), F.col("mwebv")).alias("m_r")))


_MAG = "CASE true_target " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in MAGNITUDES.items()) + " END"


@query("p9_expected_snr", f"WITH {SEL_SQL} SELECT object_id, round(log10(pow(10.0::DOUBLE, -0.4::DOUBLE * ({_MAG} + distmod + 3.1::DOUBLE * mwebv - 27.5::DOUBLE)) / 5.0::DOUBLE), 6) AS log_snr FROM sel")
def snr_of_class(spark, sf_dir):
    return rounded(selected(spark, sf_dir).select("object_id", F.log10(expected_snr(F.col("true_target"), F.col("distmod"), F.col("mwebv"))).alias("log_snr")))


@query("p10_varying_columns", f"WITH {SEL_SQL} SELECT unnest(['hostgal_photoz', 'mwebv', 'S', 'hostgal_photoz_err']) AS name, unnest([count(DISTINCT hostgal_photoz) > 1, count(DISTINCT mwebv) > 1, count(DISTINCT S) > 1, count(DISTINCT hostgal_photoz_err) > 1]) AS varies FROM sel")
def varying(spark, sf_dir):
    names = ["hostgal_photoz", "mwebv", "S", "hostgal_photoz_err"]
    found = P.varying_columns(selected(spark, sf_dir), names)
    return spark.createDataFrame([(n, n in found) for n in names], "name string, varies boolean")


@query("p12_perturbed_photoz", f"WITH {SEL_SQL} SELECT object_id, round(hostgal_photoz + 5 * (SELECT stddev_samp(hostgal_photoz) FROM sel), 6) AS shifted FROM sel")
def perturbed(spark, sf_dir):
    sel = selected(spark, sf_dir)
    std = sel.agg(F.stddev_samp("hostgal_photoz")).first()[0]
    return rounded(sel.select("object_id", (F.col("hostgal_photoz") + 5 * F.lit(std)).alias("shifted")))


@query("p13_downsample_class", f"WITH {SEL_SQL} SELECT object_id, true_target FROM sel WHERE true_target <> 90 UNION ALL SELECT object_id, true_target FROM (SELECT object_id, true_target FROM sel WHERE true_target = 90 ORDER BY md5('42:' || object_id), object_id LIMIT 2000)")
def downsample(spark, sf_dir):
    return P.downsample_class(selected(spark, sf_dir), 90, 2000).select("object_id", "true_target")


@query("j1_semi_join", f"WITH {META_SQL}, {OBS_SQL} SELECT object_id, passband, count(*) AS n FROM obs WHERE object_id IN (SELECT object_id FROM meta WHERE true_target = 64) GROUP BY ALL")
def semi_join(spark, sf_dir):
    return P.of_objects(observations(spark, sf_dir), P.held_out(metadata(spark, sf_dir), 64)).groupBy("object_id", "passband").agg(F.count("*").alias("n"))


@query("j2_observed_objects", f"WITH {META_SQL}, {OBS_SQL} SELECT object_id, true_target FROM meta WHERE object_id IN (SELECT object_id FROM obs)")
def observed(spark, sf_dir):
    return P.with_observations(metadata(spark, sf_dir), observations(spark, sf_dir)).select("object_id", "true_target")


@query("j5_inner_lookup", f"WITH {META_SQL}, {OBS_SQL} SELECT true_target, passband, count(*) AS n, round(avg(flux), 6) AS mean_flux FROM obs JOIN meta USING (object_id) GROUP BY ALL")
def inner_lookup(spark, sf_dir):
    return rounded(observations(spark, sf_dir).join(metadata(spark, sf_dir), "object_id").groupBy("true_target", "passband").agg(F.count("*").alias("n"), F.avg("flux").alias("mean_flux")))


@query("j7_anti_join", f"WITH {META_SQL}, {OBS_SQL} SELECT object_id FROM meta WHERE object_id NOT IN (SELECT object_id FROM obs)")
def anti_join(spark, sf_dir):
    return metadata(spark, sf_dir).join(observations(spark, sf_dir).select("object_id"), "object_id", "left_anti").select("object_id")


@query("j8_three_key_join", f"WITH {OBS_SQL} SELECT object_id, passband, count(*) AS n FROM obs a JOIN (SELECT object_id, mjd, passband FROM obs WHERE flux > 50) b USING (object_id, mjd, passband) GROUP BY ALL")
def three_key_join(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.join(obs.where("flux > 50").select("object_id", "mjd", "passband"), ["object_id", "mjd", "passband"]).groupBy("object_id", "passband").agg(F.count("*").alias("n"))


@query("f1_selection_probability", f"WITH {SEL_SQL} SELECT object_id, round(p_spec, 6) AS p_spec, round(1.0::DOUBLE / p_spec, 6) AS weight FROM sel")
def probability(spark, sf_dir):
    return rounded(selected(spark, sf_dir).select("object_id", "p_spec", (1.0 / F.col("p_spec")).alias("weight")))


@query("f2_inverse_weight", f"WITH {POP_SQL} SELECT object_id, round(CASE WHEN mwebv > 0 THEN 1.0::DOUBLE / mwebv END, 6) AS weight FROM pop")
def inverse_weights(spark, sf_dir):
    """A probability of 0 has no weight."""
    return rounded(population(spark, sf_dir).select("object_id", inverse_weight(F.col("mwebv")).alias("weight")))


@query("f4_clipped_log", f"WITH {SEL_SQL} SELECT object_id, round(ln(greatest(least(CASE WHEN mwebv < 0.01 THEN 0.0::DOUBLE WHEN mwebv > 0.09 THEN 1.0::DOUBLE ELSE p_spec END, 1.0::DOUBLE - 0.0000001::DOUBLE), 0.0000001::DOUBLE)), 6) AS log_p FROM sel")
def logs(spark, sf_dir):
    p = F.when(F.col("mwebv") < 0.01, 0.0).when(F.col("mwebv") > 0.09, 1.0).otherwise(F.col("p_spec"))
    return rounded(selected(spark, sf_dir).select("object_id", clipped_log(p).alias("log_p")))


@query("b8_seeded_selection", f"WITH {sel_sql(7)} SELECT object_id, true_target, S, round({uniform_sql(chr(39) + '7:' + chr(39) + ' || object_id')}, 9) AS u FROM sel")
def seeded_selection(spark, sf_dir):
    rows = P.select(P.true_population(population(spark, sf_dir)), SelectionConfig(seed=7))
    return rounded(rows.select("object_id", "true_target", "S", hash_uniform(7, F.col("object_id")).alias("u")), 9)


@query("a2_class_balance", f"WITH {POP_SQL} SELECT true_target, count(*) AS n FROM pop GROUP BY ALL")
def class_balance(spark, sf_dir):
    return P.class_balance(population(spark, sf_dir))


@query("a3_selection_summary", f"WITH {SEL_SQL} SELECT true_target, count(*) AS n_true, sum(S)::BIGINT AS n_biased, round(sum(S) / count(*), 6) AS retention FROM sel GROUP BY ROLLUP (true_target)")
def selection_summary(spark, sf_dir):
    return P.selection_summary(selected(spark, sf_dir))


@query("a22_class_proportions", f"WITH {SEL_SQL}, c AS (SELECT true_target, count(*) AS n_true, sum(S)::BIGINT AS n_biased FROM sel GROUP BY ALL), t AS (SELECT sum(n_true) AS t, sum(n_biased) AS b FROM c) SELECT true_target, n_true, n_biased, round(n_biased / n_true, 6) AS retention, round(n_true / t, 6) AS share_true, round(n_biased / b, 6) AS share_biased, round(n_biased / b - n_true / t, 6) + 0.0 AS shift FROM c, t")
def proportions(spark, sf_dir):
    return rounded(P.proportions(selected(spark, sf_dir)))


@query("a33_selection_curve", f"WITH {SEL_SQL}, c AS (SELECT least(floor(hostgal_photoz / 0.05::DOUBLE), 29)::INT AS bin, count(*) AS n, sum(S) AS kept FROM sel WHERE hostgal_photoz BETWEEN 0 AND 1.5 GROUP BY 1) SELECT s.bin::INT AS bin, coalesce(n, 0) AS n, round(coalesce(kept / n, 0), 6) AS retained FROM (SELECT unnest(range(30)) AS bin) s LEFT JOIN c ON c.bin = s.bin")
def selection_curve(spark, sf_dir):
    return rounded(P.selection_curve(selected(spark, sf_dir)))


@query("a34_top_cadences", f"WITH {SEL_SQL}, t AS (SELECT libid_cadence, count(*) AS total FROM sel GROUP BY 1 ORDER BY total DESC, libid_cadence LIMIT 10) SELECT libid_cadence, total, true_target, count(*) AS n, round(count(*) / total, 6) AS share FROM sel JOIN t USING (libid_cadence) GROUP BY libid_cadence, total, true_target")
def top_cadences(spark, sf_dir):
    return rounded(P.top_cadences(selected(spark, sf_dir)))


def _sweep_sql() -> str:
    def one(name: str, floor: float, bright: float, middle: float, width: float) -> str:
        p = f"{floor}::DOUBLE + ({bright}::DOUBLE - {floor}::DOUBLE) / (1 + exp((hostgal_photoz - {middle}::DOUBLE) / {width}::DOUBLE))"
        own = {c: f"avg({p}) FILTER (true_target = {c})" for c in (64, 90, 95)}
        each = ", ".join(f"round({x}, 6) AS retention_{c}" for c, x in own.items())
        return f"SELECT '{name}' AS scenario, round(avg({p}), 6) AS retention, {each}, round({own[64]} / {own[90]}, 6) AS ratio_64_90, round({own[95]} / {own[90]}, 6) AS ratio_95_90 FROM sel"

    return " UNION ALL ".join(one(*x) for x in P.SCENARIOS)


@query("a35_retention_sweep", f"WITH {SEL_SQL} {_sweep_sql()}")
def retention_sweep(spark, sf_dir):
    return rounded(P.retention_sweep(selected(spark, sf_dir)))


@query("u1_union", f"WITH {POP_SQL} SELECT 'TRUE' AS part, count(*) AS n FROM pop WHERE true_target IN (64, 90, 95) UNION ALL SELECT 'HELD_OUT', count(*) FROM pop WHERE true_target = 15")
def union(spark, sf_dir):
    pop = population(spark, sf_dir)
    rows = P.true_population(pop).withColumn("part", F.lit("TRUE")).unionByName(P.held_out(pop, 15).withColumn("part", F.lit("HELD_OUT")))
    return rows.groupBy("part").agg(F.count("*").alias("n"))


@query("u2_id_sets", f"WITH {META_SQL}, {OBS_SQL}, o AS (SELECT DISTINCT object_id FROM obs), m AS (SELECT object_id FROM meta WHERE true_target = 64) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM o INTERSECT SELECT * FROM m) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM o UNION SELECT * FROM m) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM m)")
def id_sets(spark, sf_dir):
    o, m = observations(spark, sf_dir).select("object_id"), metadata(spark, sf_dir).where("true_target = 64").select("object_id")
    parts = {"both": o.intersect(m), "either": o.union(m).distinct(), "first_only": o.subtract(m)}
    out = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts.items()]
    return out[0].union(out[1]).union(out[2])


QUERIES, ORACLE = query.queries, query.oracle
