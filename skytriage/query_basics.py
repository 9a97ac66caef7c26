"""Queries on scans, projections, joins, scalar functions, windows and generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .config import FORBIDDEN
from .functions.scalars import STATUS_NAMES, color, color_error, normalized, object_utility, snr, status_code
from .operators import asof, quantiles, shift, synthetic
from .operators import discrimination as D
from .operators import population as P
from .plans.views import META_SQL, OBS_SQL, POP_SQL, SCORED_SQL, SEL_SQL, metadata, observations, population, scored, selected, table, uniform_sql
from .query_features import PREFIX_SQL, SUPPORT_SQL, T0_SQL, WIDE_SQL, r6, wide
from .registry import Registry, rounded
from .sources import sinks

query = Registry()


@query("s3_projected_scan", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem WHERE l_discount >= 0.05")
def projected_scan(spark, sf_dir):
    """Four columns are read and the filter reaches the scan."""
    return rounded(table(spark, sf_dir, "lineitem").where(F.col("l_discount") >= 0.05).select("l_orderkey", "l_linenumber", "l_extendedprice"), 2)


@query("s4_scan_with_key_filter", f"WITH {OBS_SQL} SELECT passband, count(*) AS n, round(sum(flux), 4) AS total_flux FROM obs WHERE object_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL")
def key_filter(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("object_id"))
    return rounded(P.of_objects(observations(spark, sf_dir), ids).groupBy("passband").agg(F.count("*").alias("n"), F.sum("flux").alias("total_flux")), 4)


@query("s5_aliased_column", f"WITH {OBS_SQL} SELECT detected_bool, count(*) AS n FROM obs GROUP BY ALL")
def aliased(spark, sf_dir):
    from .sources.readers import ALIASES

    df = observations(spark, sf_dir).withColumnRenamed("detected_bool", "detected")
    return df.withColumnsRenamed({c: ALIASES[c] for c in df.columns if c in ALIASES}).groupBy("detected_bool").agg(F.count("*").alias("n"))


@query("s9_row_fingerprints", "SELECT c_custkey, sha256(c_custkey || ':' || c_name || ':' || c_mktsegment) AS fingerprint FROM customer")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), 256).alias("fingerprint"))


def _digest_sql(table: str, columns: list[str]) -> str:
    cells = " || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in sorted(columns))
    lanes = " || ".join(f"lpad(lower(to_hex((sum(('0x' || substr(h, {1 + 16 * k}, 16))::UBIGINT::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')" for k in range(4))
    return f"SELECT '{table}' AS name, count(*) AS n, {lanes} AS digest FROM (SELECT sha256({cells}) AS h FROM {table})"


_DIGESTED = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "customer": ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]}


@query("s9_content_digest", " UNION ALL ".join(_digest_sql(t, c) for t, c in _DIGESTED.items()))
def content_digests(spark, sf_dir):
    """What the tables hold, whatever their files."""
    each = [sinks.content_digest(table(spark, sf_dir, t).select(c)).select(F.lit(t).alias("name"), "n", "digest") for t, c in _DIGESTED.items()]
    return each[0].unionByName(each[1])


@query("s13_union_of_partitions", f"WITH {OBS_SQL} SELECT object_id % 3 AS part, count(*) AS n, count(DISTINCT object_id) AS n_objects FROM obs WHERE object_id IN (SELECT object_id FROM obs WHERE passband = 0 AND flux > 40) GROUP BY 1")
def union_of_partitions(spark, sf_dir):
    obs = observations(spark, sf_dir)
    parts = [obs.where(F.col("object_id") % 3 == k) for k in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wanted = obs.where("passband = 0 and flux > 40").select("object_id").distinct()
    return P.of_objects(rows, wanted).groupBy((F.col("object_id") % 3).alias("part")).agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("n_objects"))


@query("v2_test_metadata_rules", f"WITH {META_SQL} SELECT count(*) AS n, count(*) FILTER (hostgal_photoz < 0) AS n_negative, count(DISTINCT object_id) AS n_ids FROM meta")
def test_metadata(spark, sf_dir):
    from .operators.validate import metadata_rules

    return metadata(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(metadata_rules()["hostgal_photoz negative"][1]).alias("n_negative"), F.count_distinct("object_id").alias("n_ids"))


@query("v5_validate_all_rows", f"WITH {POP_SQL} SELECT true_target, count(*) AS n, count(*) FILTER (hostgal_photoz >= 0 AND hostgal_photoz < 'inf'::DOUBLE AND hostgal_photoz_err >= 0) AS n_sound FROM pop GROUP BY ALL")
def all_rows(spark, sf_dir):
    z = F.col("hostgal_photoz")
    return population(spark, sf_dir).groupBy("true_target").agg(F.count("*").alias("n"), F.count_if((z >= 0) & (z < float("inf")) & (F.col("hostgal_photoz_err") >= 0)).alias("n_sound"))


@query("p3_strip_forbidden", f"WITH {POP_SQL} SELECT object_id, {r6('hostgal_photoz', 'mwebv')} FROM pop")
def strip(spark, sf_dir):
    rows = population(spark, sf_dir).select("object_id", "hostgal_photoz", "mwebv", "true_target").withColumns({c: F.lit(1.0) for c in FORBIDDEN if c != "true_target"})
    return rounded(asof.strip_forbidden(rows))


@query("p5_global_cutoff", f"WITH {OBS_SQL}, c AS (SELECT quantile_cont(mjd, 0.25) AS cut FROM obs) SELECT passband, count(*) AS n FROM obs, c WHERE mjd <= cut GROUP BY ALL")
def global_cutoff(spark, sf_dir):
    obs = observations(spark, sf_dir)
    cut = quantiles.percentiles(obs, "mjd", [0.25])[()][0]
    return asof.truncate_at_mjd(obs, cut).groupBy("passband").agg(F.count("*").alias("n"))


@query("p6_object_cutoffs", f"WITH {T0_SQL} SELECT object_id, count(*) AS n FROM obs JOIN t0s USING (object_id) WHERE t0 IS NOT NULL AND mjd <= t0 + 3.5::DOUBLE GROUP BY 1")
def object_cutoffs(spark, sf_dir):
    """Every object with a detection has a cutoff; those without one drop out."""
    obs = observations(spark, sf_dir)
    cut = asof.first_detection(obs).where("t0 is not null").select("object_id", (F.col("t0") + 3.5).alias("cutoff"))
    return asof.truncate_at_mjd(obs, cut).groupBy("object_id").agg(F.count("*").alias("n"))


_NAMES_SQL = "CASE alert_snr_0_status " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(STATUS_NAMES)) + " ELSE 'other' END"


@query("p11_status_codes", f"WITH {WIDE_SQL} SELECT {_NAMES_SQL} AS name, alert_snr_0_status AS code, count(*) AS n FROM wide GROUP BY ALL")
def status_codes(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in STATUS_NAMES))
    rows = wide(spark, sf_dir).withColumn("name", F.coalesce(F.get(names, F.col("alert_snr_0_status")), F.lit("other")))
    return rows.groupBy("name", status_code(F.col("name")).alias("code")).agg(F.count("*").alias("n"))


@query("j3_cutoff_lookup", f"WITH {T0_SQL} SELECT o.object_id, o.passband, count(*) AS n_before FROM obs o JOIN t0s t USING (object_id) WHERE o.mjd < t.t0 GROUP BY ALL")
def cutoff_lookup(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.join(asof.first_detection(obs), "object_id").where("mjd < t0").groupBy("object_id", "passband").agg(F.count("*").alias("n_before"))


@query("j4_left_outer_features", f"WITH {META_SQL}, {SUPPORT_SQL} SELECT true_target, count(*) AS n, count(n_obs_total) AS n_observed, coalesce(sum(n_det_total), 0)::BIGINT AS n_det FROM meta m LEFT JOIN (SELECT * FROM support WHERE epoch = 7) s ON s.object_id = m.object_id GROUP BY ALL")
def left_outer(spark, sf_dir):
    rows = wide(spark, sf_dir, metadata(spark, sf_dir), "true_target").where("epoch = 7")
    return rows.groupBy("true_target").agg(F.count("*").alias("n"), F.count_if(F.col("n_obs_total") > 0).alias("n_observed"), F.sum("n_det_total").alias("n_det"))


@query("a4_object_counts", f"WITH {PREFIX_SQL} SELECT object_id, epoch, count(*) AS n_obs, count(*) FILTER (det) AS n_det, count(DISTINCT passband) FILTER (det) AS n_bands, round(max(mjd) FILTER (det) - min(mjd) FILTER (det), 6) AS span FROM prefix GROUP BY object_id, epoch")
def object_counts(spark, sf_dir):
    det = F.col("det")
    rows = asof.epoch_sequences(observations(spark, sf_dir))
    return rounded(rows.groupBy("object_id", "epoch").agg(F.count("*").alias("n_obs"), F.count_if(det).alias("n_det"), F.count_distinct(F.when(det, F.col("passband"))).alias("n_bands"), (F.max(F.when(det, F.col("mjd"))) - F.min(F.when(det, F.col("mjd")))).alias("span")))


@query("f3_color_function", f"WITH {OBS_SQL}, b AS (SELECT object_id, avg(flux) FILTER (passband = 1) AS f1, avg(flux) FILTER (passband = 2) AS f2, avg(flux_err) FILTER (passband = 1) AS e1, avg(flux_err) FILTER (passband = 2) AS e2 FROM obs GROUP BY 1) SELECT object_id, CASE WHEN f1 > 0 AND f2 > 0 THEN round(-2.5::DOUBLE * log10(f1 / f2), 6) + 0.0 END AS color, CASE WHEN f1 > 0 AND f2 > 0 THEN round(2.5::DOUBLE / ln(10.0::DOUBLE) * sqrt((e1 / f1) * (e1 / f1) + (e2 / f2) * (e2 / f2)), 6) END AS color_err FROM b")
def colors(spark, sf_dir):
    mean = lambda c, b: F.avg(F.when(F.col("passband") == b, F.col(c)))
    rows = observations(spark, sf_dir).groupBy("object_id").agg(mean("flux", 1).alias("f1"), mean("flux", 2).alias("f2"), mean("flux_err", 1).alias("e1"), mean("flux_err", 2).alias("e2"))
    f1, e1, f2, e2 = (F.col(c) for c in ("f1", "e1", "f2", "e2"))
    return rounded(rows.select("object_id", color(f1, f2).alias("color"), color_error(f1, e1, f2, e2).alias("color_err")))


@query("f5_normalized_probabilities", f"WITH {SEL_SQL} SELECT object_id, round(CASE WHEN t > 0 THEN a / t ELSE 0.0::DOUBLE END, 6) AS p_64, round(CASE WHEN t > 0 THEN b / t ELSE 0.0::DOUBLE END, 6) AS p_90, round(CASE WHEN t > 0 THEN c / t ELSE 0.0::DOUBLE END, 6) AS p_95 FROM (SELECT *, a + b + c AS t FROM (SELECT object_id, CASE WHEN mwebv < 0.02 THEN 0.0::DOUBLE ELSE p_spec END AS a, CASE WHEN mwebv < 0.02 THEN 0.0::DOUBLE ELSE mwebv END AS b, CASE WHEN mwebv < 0.02 THEN 0.0::DOUBLE ELSE hostgal_photoz END AS c FROM sel))")
def shares(spark, sf_dir):
    some = F.col("mwebv") >= 0.02
    parts = [F.when(some, F.col(c)).otherwise(0.0) for c in ("p_spec", "mwebv", "hostgal_photoz")]
    return rounded(selected(spark, sf_dir).select("object_id", *(x.alias(n) for x, n in zip(normalized(*parts), ("p_64", "p_90", "p_95"), strict=True))))


@query("f7_object_utility", f"WITH {SCORED_SQL} SELECT object_id, epoch, CASE WHEN p_64 >= 0.4 AND y = 64 THEN 2.0::DOUBLE WHEN p_64 >= 0.4 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS utility FROM scored")
def utilities(spark, sf_dir):
    return scored(spark, sf_dir).select("object_id", "epoch", object_utility(F.col("p_64") >= 0.4, F.col("y") == 64).alias("utility"))


@query("f9_photoz_feature", f"WITH {WIDE_SQL} SELECT object_id, {r6('hostgal_photoz', 'hostgal_photoz_err')}, hostgal_photoz_status FROM wide WHERE epoch = 0")
def photoz_feature(spark, sf_dir):
    return rounded(wide(spark, sf_dir).where("epoch = 0").select("object_id", "hostgal_photoz", "hostgal_photoz_err", "hostgal_photoz_status"))


@query("f10_rounding_and_bins", f"WITH {POP_SQL} SELECT floor(hostgal_photoz * 10)::BIGINT AS bin, count(*) AS n, round(avg(abs(hostgal_photoz - 0.5::DOUBLE)), 6) AS gap FROM pop GROUP BY 1")
def rounding(spark, sf_dir):
    z = F.col("hostgal_photoz")
    return rounded(population(spark, sf_dir).groupBy(F.floor(z * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.abs(z - 0.5)).alias("gap")))


@query("f11_upper_cast", f"WITH {SEL_SQL} SELECT upper('s' || S) AS label, count(*) AS n FROM sel GROUP BY ALL")
def upper_cast(spark, sf_dir):
    return selected(spark, sf_dir).groupBy(F.upper(F.concat(F.lit("s"), F.col("S").cast("string"))).alias("label")).agg(F.count("*").alias("n"))


@query("w2_snr_growth", f"WITH {SUPPORT_SQL} SELECT object_id, epoch, snr_growth_rate_status AS status, {r6('snr_growth_rate')} FROM support WHERE epoch > 0")
def snr_growth(spark, sf_dir):
    from .operators.features import support

    rows = support(asof.epoch_sequences(observations(spark, sf_dir))).where("epoch > 0")
    return rounded(rows.select("object_id", "epoch", F.col("snr_growth_rate_status").alias("status"), "snr_growth_rate"))


@query("w7_cumulative_distribution", f"WITH {SEL_SQL} SELECT round(mwebv, 6) AS mwebv, n, sum(n) OVER (ORDER BY mwebv)::BIGINT AS cum_n, sum(k) OVER (ORDER BY mwebv)::BIGINT AS cum_k FROM (SELECT mwebv, count(*) AS n, sum(S)::BIGINT AS k FROM sel GROUP BY 1)")
def cumulative(spark, sf_dir):
    rows = shift.cumulative(selected(spark, sf_dir), "mwebv", {"n": F.lit(1), "k": F.col("S")})
    return rounded(rows.select("mwebv", "n", "cum_n", "cum_k"))


@query("w8_order_in_object", f"WITH {OBS_SQL} SELECT object_id, {r6('mjd')}, row_number() OVER (PARTITION BY object_id ORDER BY mjd)::INT AS place FROM obs")
def order(spark, sf_dir):
    return rounded(observations(spark, sf_dir).select("object_id", "mjd", F.row_number().over(Window.partitionBy("object_id").orderBy("mjd")).alias("place")))


_HITS = {"one_class": "y = 64", "none": "y = 64 AND epoch < 0", "all": "epoch = 2"}
_B10 = " UNION ALL ".join(f"SELECT '{k}' AS rows, coalesce(round(sum(fp * (ctp - tp / 2.0::DOUBLE)) / CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp)::DOUBLE * sum(fp) END, 6), 0.5::DOUBLE) AS auc FROM (SELECT *, sum(tp) OVER (ORDER BY p_64 DESC) AS ctp FROM (SELECT p_64, count(*) FILTER (y = 64) AS tp, count(*) FILTER (y <> 64) AS fp FROM scored WHERE {c} GROUP BY 1))" for k, c in _HITS.items())


@query("b10_auc_or_half", f"WITH {SCORED_SQL} {_B10}")
def auc_or_half(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("hit", (F.col("y") == 64).cast("long"))
    return rounded(spark.createDataFrame([(k, D.auc_or_half(rows.where(c), "p_64")) for k, c in _HITS.items()], "rows string, auc double"))


def _choose_sql(u: str, values: list, shares: list[float]) -> str:
    total, out = 0.0, "CASE"
    for v, p in zip(values[:-1], shares, strict=False):
        total += p
        out += f" WHEN {u} < {total!r}::DOUBLE THEN {v}"
    return f"{out} ELSE {values[-1]} END"


def _sampled_sql(n: int, epoch: float, cls: int) -> str:
    """Rows (object_id, n_det, n_passbands, det_span_days), the reference's cases by epoch and class."""
    u, v, w = (uniform_sql(f"'42{x}:' || object_id") for x in "cbs")
    ids = f"(SELECT unnest(range({n})) AS object_id)"
    if epoch == 0:
        return f"SELECT object_id, 1 AS n_det, 1 AS n_passbands, 0.0::DOUBLE AS det_span_days FROM {ids}"
    if cls == 64:
        shares = [0.500, 0.144, 0.289, 0.019, 0.039, 0.009]
        drawn = f"SELECT object_id, {_choose_sql('u', [1, 2, 2, 3, 4, 5], shares)} AS n_det, {_choose_sql('u', [1, 1, 2, 2, 3, 3], shares)} AS n_passbands, least(-0.35::DOUBLE * ln(1 - w), 1.8::DOUBLE) AS span FROM x"
    else:
        drawn = f"SELECT object_id, {_choose_sql('u', [1, 2, 3, 5], [0.27, 0.25, 0.38, 0.10])} AS n_det, least({_choose_sql('u', [1, 2, 3, 5], [0.27, 0.25, 0.38, 0.10])}, 1 + floor(3 * v))::INT AS n_passbands, 0.01::DOUBLE + (1.9::DOUBLE - 0.01::DOUBLE) * w AS span FROM x"
    return f"SELECT object_id, n_det, n_passbands, CASE WHEN n_det > 1 THEN span ELSE 0.0::DOUBLE END AS det_span_days FROM (WITH x AS (SELECT object_id, {u} AS u, {v} AS v, {w} AS w FROM {ids}) {drawn})"


_CELLS = [(e, c) for e in (0.0, 2.0) for c in (64, 90, 95)]
_G1 = " UNION ALL ".join(f"SELECT {e}::DOUBLE AS epoch, {c} AS true_target, n_det, n_passbands, count(*) AS n, round(avg(det_span_days), 6) AS mean_span, round(max(det_span_days), 6) AS max_span FROM ({_sampled_sql(5000, e, c)}) GROUP BY n_det, n_passbands" for e, c in _CELLS)


@query("g1_sparsity_sampler", _G1)
def sampler(spark, sf_dir):
    out = None
    for e, c in _CELLS:
        rows = synthetic.sparsity(spark.range(5000).withColumnRenamed("id", "object_id"), e, c).groupBy("n_det", "n_passbands").agg(F.count("*").alias("n"), F.avg("det_span_days").alias("mean_span"), F.max("det_span_days").alias("max_span"))
        rows = rows.select(F.lit(e).alias("epoch"), F.lit(c).alias("true_target"), "*")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


_RATES, _FLUXES = {1: 20.0, 2: 35.0, 3: 50.0}, {1: 60.0, 2: 80.0, 3: 100.0}


def _curves_sql(n: int) -> str:
    bands = ", ".join("{'u': " + uniform_sql(f"'42p{b}:' || object_id") + f", 'b': {b}}}" for b in _RATES)
    of = lambda values: "CASE passband " + " ".join(f"WHEN {b} THEN {v}::DOUBLE" for b, v in values.items()) + " END"
    noise = f"sqrt(-2.0::DOUBLE * ln(greatest({uniform_sql(chr(39) + '42a:' + chr(39) + ' || object_id || ' + chr(39) + ':' + chr(39) + ' || k')}, 1.0::DOUBLE / 8589934592.0::DOUBLE))) * cos(2 * pi() * {uniform_sql(chr(39) + '42b:' + chr(39) + ' || object_id || ' + chr(39) + ':' + chr(39) + ' || k')})"
    return f"""WITH o AS ({_sampled_sql(n, 2.0, 64)}),
t AS (SELECT *, list_sort([{bands}]) AS bands, list_concat([0.0::DOUBLE], list_sort(list_transform(range(1, n_det), lambda k: {uniform_sql(chr(39) + '42t:' + chr(39) + ' || object_id || ' + chr(39) + ':' + chr(39) + ' || k')} * det_span_days))) AS times FROM o),
e AS (SELECT *, unnest(range(n_det)) AS k FROM t),
p AS (SELECT object_id, k, times[k + 1] AS dt, bands[1 + CASE WHEN k < n_passbands THEN k ELSE floor({uniform_sql(chr(39) + '42q:' + chr(39) + ' || object_id || ' + chr(39) + ':' + chr(39) + ' || k')} * n_passbands)::INT END].b AS passband FROM e),
c AS (SELECT *, {of(_FLUXES)} + {of(_RATES)} * dt + 5.0::DOUBLE * ({noise}) AS flux FROM p)
SELECT object_id, round(58000.0::DOUBLE + dt, 6) AS mjd, passband, round(flux, 6) + 0.0 AS flux, 5.0::DOUBLE AS flux_err, (flux / 5.0::DOUBLE >= 5)::INT AS detected_bool, round(flux / 5.0::DOUBLE, 6) + 0.0 AS snr FROM c"""


@query("g2_synthetic_light_curves", _curves_sql(2000))
def curves(spark, sf_dir):
    """Curves of sampled sparsity, the target class at two days."""
    objects = synthetic.sparsity(spark.range(2000).withColumnRenamed("id", "object_id"), 2.0)
    return rounded(synthetic.light_curves(objects, _RATES, _FLUXES).withColumn("snr", snr(F.col("flux"), F.col("flux_err"))))


@query("m2_aligned_probabilities")
def aligned(spark, sf_dir):
    """Probabilities of models that never saw one class: that class has 0."""
    from .config import BoostingConfig
    from .operators import boosting
    from .query_triage import _training

    rows, names = _training(spark, sf_dir)
    return boosting.predictions(rows.where("S = 0 or y <> 95"), names, BoostingConfig())


QUERIES, ORACLE = query.queries, query.oracle
