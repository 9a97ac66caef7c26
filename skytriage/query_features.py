"""Queries on prefixes and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import COLOR_PAIRS, EPOCHS, PASSBANDS
from .functions.scalars import snr
from .operators import asof, features
from .plans.views import META_SQL, OBS_SQL, metadata, observations, photometry, table
from .registry import Registry, rounded
from .sources.colocated import Colocated, of_objects
from .sources.shared import shared_folder
from .streaming import alerts

query = Registry()

T0_SQL = OBS_SQL + """,
t0s AS (SELECT object_id, min(CASE WHEN detected_bool = 1 THEN mjd END) AS t0 FROM obs GROUP BY object_id)"""
PREFIX_SQL = T0_SQL + """,
prefix AS (SELECT o.*, t.t0, e.epoch, o.detected_bool = 1 AS det FROM obs o JOIN t0s t USING (object_id), (SELECT unnest([0.0::DOUBLE, 2.0::DOUBLE, 7.0::DOUBLE]) AS epoch) e
  WHERE t.t0 IS NOT NULL AND o.mjd <= t.t0 + e.epoch)"""
RISE_SQL = PREFIX_SQL + """,
d AS (SELECT object_id, epoch, passband, count(*) AS n_obs, count(CASE WHEN det THEN 1 END) AS n_det, min(CASE WHEN det THEN mjd - t0 END) AS x0, max(CASE WHEN det THEN mjd - t0 END) AS x1,
    arg_min(flux, mjd) FILTER (det) AS f0, arg_max(flux, mjd) FILTER (det) AS f1, sum(flux_err * flux_err) FILTER (det) AS see,
    sum(1.0::DOUBLE / (flux_err * flux_err)) FILTER (det) AS sw, sum((mjd - t0) / (flux_err * flux_err)) FILTER (det) AS swx, sum(flux / (flux_err * flux_err)) FILTER (det) AS swf,
    sum((mjd - t0) * (mjd - t0) / (flux_err * flux_err)) FILTER (det) AS swxx, sum((mjd - t0) * flux / (flux_err * flux_err)) FILTER (det) AS swxf
  FROM prefix GROUP BY ALL),
rise AS (SELECT object_id, epoch, passband, n_obs, n_det, status,
    CASE WHEN status = 0 THEN CASE WHEN n_det = 2 THEN (f1 - f0) / (x1 - x0) ELSE (sw * swxf - swx * swf) / (sw * swxx - swx * swx) END END AS slope,
    CASE WHEN status = 0 THEN CASE WHEN n_det = 2 THEN sqrt(see) / (x1 - x0) ELSE sqrt(sw / (sw * swxx - swx * swx)) END END AS slope_err,
    CASE WHEN status = 0 THEN x1 - x0 END AS dt_days
  FROM (SELECT *, CASE WHEN n_det < 2 THEN 1 WHEN x1 - x0 <= 0 THEN 2 WHEN n_det > 2 AND sw * swxx - swx * swx <= 0 THEN 2 ELSE 0 END AS status FROM d))"""
COLOR_SQL = PREFIX_SQL + """,
near AS (SELECT a.object_id, a.epoch, a.passband AS b1, b.passband AS b2, abs(a.mjd - b.mjd) AS dt, a.flux AS fa, a.flux_err AS ea, b.flux AS fb, b.flux_err AS eb,
    row_number() OVER (PARTITION BY a.object_id, a.epoch, a.passband ORDER BY abs(a.mjd - b.mjd), a.mjd, b.mjd) AS k
  FROM prefix a JOIN prefix b ON a.object_id = b.object_id AND a.epoch = b.epoch AND b.passband = a.passband + 1 AND a.det AND b.det),
hue AS (SELECT object_id, epoch, b1, b2, CASE WHEN dt > 0.5 THEN 4 WHEN fa <= 0 OR fb <= 0 THEN 3 ELSE 0 END AS status, dt AS min_dt_days,
    CASE WHEN dt <= 0.5 AND fa > 0 AND fb > 0 THEN -2.5::DOUBLE * log10(fa / fb) END AS color,
    CASE WHEN dt <= 0.5 AND fa > 0 AND fb > 0 THEN 2.5::DOUBLE / ln(10.0::DOUBLE) * sqrt((ea / fa) * (ea / fa) + (eb / fb) * (eb / fb)) END AS color_err
  FROM near WHERE k = 1)"""
SUPPORT_SQL = PREFIX_SQL + """,
s0 AS (SELECT object_id, epoch, count(*) AS n_obs_total, count(*) FILTER (det) AS n_det_total, count(DISTINCT passband) FILTER (det) AS n_det_passbands,
    coalesce(max(mjd) FILTER (det) - min(mjd) FILTER (det), 0.0::DOUBLE) AS det_time_span_days, arg_min(flux / flux_err, mjd) FILTER (det) AS snr0, arg_max(flux / flux_err, mjd) FILTER (det) AS snr1
  FROM prefix GROUP BY ALL),
support AS (SELECT object_id, epoch, n_obs_total, n_det_total, n_det_passbands, det_time_span_days, snr0 AS alert_snr_0, 1.0::DOUBLE AS alert_snr_0_err, 0 AS alert_snr_0_status,
    CASE WHEN n_det_total >= 2 AND det_time_span_days > 0 THEN (snr1 - snr0) / det_time_span_days END AS snr_growth_rate,
    CASE WHEN n_det_total >= 2 AND det_time_span_days > 0 THEN sqrt(2.0::DOUBLE) / det_time_span_days END AS snr_growth_rate_err,
    CASE WHEN n_det_total < 2 THEN 1 WHEN det_time_span_days <= 0 THEN 2 ELSE 0 END AS snr_growth_rate_status FROM s0)"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _sequences(spark, sf_dir):
    return asof.epoch_sequences(observations(spark, sf_dir), EPOCHS)


@query("s2_scan_observations", f"WITH {OBS_SQL} SELECT object_id, {r6('mjd', 'flux', 'flux_err')}, passband, detected_bool FROM obs")
def scan_observations(spark, sf_dir):
    return rounded(observations(spark, sf_dir))


@query("p4_detections", f"WITH {OBS_SQL} SELECT object_id, passband, count(*) AS n_obs, count(*) FILTER (flux / flux_err >= 5 OR detected_bool = 1) AS n_det FROM obs GROUP BY ALL")
def detections(spark, sf_dir):
    return asof.with_detection(observations(spark, sf_dir)).groupBy("object_id", "passband").agg(F.count("*").alias("n_obs"), F.count_if("det").alias("n_det"))


#: Observations whose flag and signal-to-noise do not agree, some without a sound error.
_ODD = """odd AS (SELECT object_id, mjd, passband, flux, CASE WHEN flux < 12 THEN 0.0::DOUBLE ELSE flux_err END AS flux_err, CASE WHEN flux >= 8 AND flux < 14 THEN 1 ELSE 0 END AS detected_bool FROM obs)"""


def _odd(spark, sf_dir):
    flux = F.col("flux")
    return observations(spark, sf_dir).withColumns({"detected_bool": ((flux >= 8) & (flux < 14)).cast("int"), "flux_err": F.when(flux < 12, 0.0).otherwise(F.col("flux_err"))})


@query("p4_flag_or_noise", f"WITH {OBS_SQL}, {_ODD} SELECT passband, count(*) AS n_obs, count(*) FILTER (detected_bool = 1) AS n_flag, count(*) FILTER (flux_err > 0 AND flux / CASE WHEN flux_err > 0 THEN flux_err END >= 5) AS n_snr, count(*) FILTER (detected_bool = 1 OR (flux_err > 0 AND flux / CASE WHEN flux_err > 0 THEN flux_err END >= 5)) AS n_det FROM odd GROUP BY ALL")
def flag_or_noise(spark, sf_dir):
    """Either the flag or five sigma makes a detection; an error of 0 has no sigma."""
    rows = asof.with_detection(_odd(spark, sf_dir))
    strong = snr(F.col("flux"), F.col("flux_err")) >= 5
    return rows.groupBy("passband").agg(F.count("*").alias("n_obs"), F.count_if(F.col("detected_bool") == 1).alias("n_flag"), F.count_if(strong).alias("n_snr"), F.count_if("det").alias("n_det"))


@query("a5_unsound_errors", f"WITH {OBS_SQL}, {_ODD}, dt AS (SELECT *, detected_bool = 1 OR (flux_err > 0 AND flux / CASE WHEN flux_err > 0 THEN flux_err END >= 5) AS det FROM odd), t AS (SELECT object_id, min(mjd) FILTER (det) AS t0 FROM dt GROUP BY 1), g AS (SELECT object_id, passband, count(*) FILTER (det) AS n, count(*) FILTER (det AND flux_err <= 0) AS bad, max(mjd) FILTER (det) - min(mjd) FILTER (det) AS dt FROM dt JOIN t USING (object_id) WHERE mjd <= t0 + 7 GROUP BY ALL) SELECT status, count(*) AS n FROM (SELECT CASE WHEN n < 2 OR (n > 2 AND bad > 0) THEN 1 WHEN dt <= 0 THEN 2 ELSE 0 END AS status FROM g) GROUP BY 1")
def unsound_errors(spark, sf_dir):
    """Fits of three detections and more that have an unsound error are unconstrained."""
    rows = features.rise_rates(asof.epoch_sequences(_odd(spark, sf_dir), (7.0,)))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("a1_first_detection", f"WITH {T0_SQL} SELECT object_id, {r6('t0')} FROM t0s")
def first_detection(spark, sf_dir):
    return rounded(asof.first_detection(observations(spark, sf_dir)))


@query("o1_truncate_at_mjd", f"WITH {OBS_SQL}, c AS (SELECT min(mjd) + 10.0::DOUBLE AS cut FROM obs) SELECT object_id, {r6('mjd', 'flux')}, passband FROM obs, c WHERE mjd <= cut")
def truncate_at_mjd(spark, sf_dir):
    obs = observations(spark, sf_dir)
    cut = obs.agg(F.min("mjd")).first()[0]
    return rounded(asof.truncate_at_mjd(obs, cut + 10.0).select("object_id", "mjd", "flux", "passband"))


@query("o1_truncate_by_object", f"WITH {OBS_SQL} SELECT object_id, {r6('mjd', 'flux')}, passband FROM obs JOIN (SELECT object_id, max(mjd) - 5.0::DOUBLE AS cutoff FROM obs GROUP BY 1) USING (object_id) WHERE mjd <= cutoff")
def truncate_by_object(spark, sf_dir):
    obs = observations(spark, sf_dir)
    cutoffs = obs.groupBy("object_id").agg((F.max("mjd") - 5.0).alias("cutoff"))
    return rounded(asof.truncate_at_mjd(obs, cutoffs).select("object_id", "mjd", "flux", "passband"))


@query("o2_truncate_at_epoch", f"WITH {T0_SQL} SELECT object_id, {r6('mjd', 'flux')}, passband FROM obs JOIN t0s USING (object_id) WHERE mjd <= t0 + 2.0::DOUBLE")
def truncate_at_epoch(spark, sf_dir):
    return rounded(asof.truncate_at_epoch(observations(spark, sf_dir), 2.0).select("object_id", "mjd", "flux", "passband"))


@query("o3_epoch_sequences", f"WITH {PREFIX_SQL} SELECT object_id, epoch, count(*) AS n_rows, {r6('max_x')} FROM (SELECT *, max(mjd - t0) OVER (PARTITION BY object_id, epoch) AS max_x FROM prefix) GROUP BY object_id, epoch, max_x")
def epoch_sequences(spark, sf_dir):
    return rounded(_sequences(spark, sf_dir).groupBy("object_id", "epoch").agg(F.count("*").alias("n_rows"), F.max(F.col("mjd") - F.col("t0")).alias("max_x")))


@query("v7_leakage_violations", f"WITH {T0_SQL} SELECT object_id, {r6('last_mjd', 't0')} FROM (SELECT object_id, max(mjd) AS last_mjd FROM obs GROUP BY 1) JOIN t0s USING (object_id) WHERE last_mjd > t0 + 20.0::DOUBLE + 0.000001::DOUBLE")
def leakage(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return rounded(asof.leakage_violations(obs, asof.first_detection(obs), 20.0).select("object_id", "last_mjd", "t0"))


@query("a5_rise_rates", f"WITH {RISE_SQL} SELECT object_id, epoch, passband, n_obs, n_det, status, {r6('slope', 'slope_err', 'dt_days')} FROM rise")
def rise_rates(spark, sf_dir):
    return rounded(features.rise_rates(_sequences(spark, sf_dir)))


@query(
    "a5_rise_diagnostics",
    f"""WITH {RISE_SQL},
fit AS (SELECT p.*, mjd - t0 AS x, 1.0::DOUBLE / (flux_err * flux_err) AS w, (sw * swxf - swx * swf) / (sw * swxx - swx * swx) AS b, (swxx * swf - swx * swxf) / (sw * swxx - swx * swx) AS a
  FROM prefix p JOIN d USING (object_id, epoch, passband) WHERE p.det AND d.n_det > 2 AND sw * swxx - swx * swx > 0),
q AS (SELECT object_id, epoch, passband, count(*) AS n, sum(w * (flux - a - b * x) * (flux - a - b * x)) AS chi2, sum(x) AS sx, sum(x * x) AS sxx, sum(mjd) AS st, sum(mjd * mjd) AS stt FROM fit GROUP BY ALL)
SELECT object_id, epoch, passband, n, round(chi2 / (n - 2), 6) AS chi2_red, round(log10((n + stt + sqrt((n - stt) * (n - stt) + 4 * st * st)) / 2 / sqrt(n * sxx - sx * sx)), 6) AS log10_condition FROM q""",
)
def rise_diagnostics(spark, sf_dir):
    return rounded(features.rise_diagnostics(_sequences(spark, sf_dir)))


@query("j6_nearest_pair_colors", f"WITH {COLOR_SQL} SELECT object_id, epoch, b1, b2, status, {r6('min_dt_days', 'color', 'color_err')} FROM hue")
def colors(spark, sf_dir):
    return rounded(features.colors(_sequences(spark, sf_dir)))


@query("o3_streamed_prefixes", f"WITH {PREFIX_SQL} SELECT object_id, epoch, {r6('t0')}, count(*) AS n_obs, count(*) FILTER (det) AS n_det, round(max(mjd), 6) AS last_mjd FROM prefix WHERE t0 + 7 < (SELECT max(mjd) FROM obs) - 1 GROUP BY object_id, epoch, t0")
def streamed_prefixes(spark, sf_dir):
    """The events as a stream of files: objects whose last epoch the watermark, a day behind, has passed."""
    folder = shared_folder(spark, "streamed-prefixes")
    schema = table(spark, sf_dir, "events").schema
    rows = asof.with_detection(photometry(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")))
    rows = rows.withColumn("ts", F.timestamp_millis(((F.col("mjd") - 40587.0) * 86400000).cast("long")))
    alerts.prefix_counts(rows.select("object_id", "ts", "mjd", "det")).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows", "parquet", "append").awaitTermination()
    return rounded(spark.read.schema(alerts.OUTPUT).parquet(f"{folder}/rows"))


def _sliced(spark, sf_dir):
    """Prefixes in slices of ten rows, so that most objects are cut."""
    return asof.epoch_sequences(observations(spark, sf_dir), slice_rows=10)


@query("j6_colors_in_slices", f"WITH {COLOR_SQL} SELECT object_id, epoch, b1, b2, status, {r6('min_dt_days', 'color', 'color_err')} FROM hue")
def colors_in_slices(spark, sf_dir):
    return rounded(features.colors(_sliced(spark, sf_dir)))


@query("o3_sequences_in_slices", f"WITH {PREFIX_SQL} SELECT object_id, epoch, count(*) AS n_rows, count(*) FILTER (det) AS n_det, {r6('max_x')} FROM (SELECT *, max(mjd - t0) OVER (PARTITION BY object_id, epoch) AS max_x FROM prefix) GROUP BY object_id, epoch, max_x")
def sequences_in_slices(spark, sf_dir):
    return rounded(_sliced(spark, sf_dir).groupBy("object_id", "epoch").agg(F.count("*").alias("n_rows"), F.count_if("det").alias("n_det"), F.max(F.col("mjd") - F.col("t0")).alias("max_x")))


def colocated_rise_rates(spark, sf_dir, buckets: int = 16):
    """Rise rates of study objects from bucketed tables: after the tables are written nothing moves."""
    folder = shared_folder(spark, "colocated")
    tables = [Colocated.write(observations(spark, sf_dir), f"{folder}/observations", "object_id", ("mjd",), buckets), Colocated.write(metadata(spark, sf_dir).where("true_target <> 15"), f"{folder}/objects", "object_id", (), buckets)]
    out = features.rise_rates(asof.epoch_sequences(of_objects(*tables)))
    for t in tables:
        t.close()
    return out


@query("s13_colocated_rise_rates", f"WITH {META_SQL}, {RISE_SQL} SELECT object_id, epoch, passband, n_obs, n_det, status, {r6('slope', 'slope_err', 'dt_days')} FROM rise WHERE object_id IN (SELECT object_id FROM meta WHERE true_target <> 15)")
def colocated(spark, sf_dir):
    return rounded(colocated_rise_rates(spark, sf_dir))


@query("w1_alert_support", f"WITH {SUPPORT_SQL} SELECT object_id, epoch, n_obs_total, n_det_total, n_det_passbands, alert_snr_0_status, snr_growth_rate_status, {r6('det_time_span_days', 'alert_snr_0', 'alert_snr_0_err', 'snr_growth_rate', 'snr_growth_rate_err')} FROM support")
def support(spark, sf_dir):
    return rounded(features.support(_sequences(spark, sf_dir)))


def _wide_sql() -> str:
    rise = ",\n  ".join(f"max(slope) FILTER (passband = {b}) AS rise_rate_pb{b}, max(slope_err) FILTER (passband = {b}) AS rise_rate_pb{b}_err, max(status) FILTER (passband = {b}) AS rise_rate_pb{b}_status" for b in PASSBANDS)
    hue = ",\n  ".join(f"max(color) FILTER (b1 = {a}) AS color_pb{a}_pb{b}, max(color_err) FILTER (b1 = {a}) AS color_pb{a}_pb{b}_err, max(status) FILTER (b1 = {a}) AS color_pb{a}_pb{b}_status" for a, b in COLOR_PAIRS)
    tail = lambda s: s[len(PREFIX_SQL) :]  # noqa: E731  what a CTE list adds to the prefixes
    columns = [c for b in PASSBANDS for c in (f"rise_rate_pb{b}", f"rise_rate_pb{b}_err")] + [c for a, b in COLOR_PAIRS for c in (f"color_pb{a}_pb{b}", f"color_pb{a}_pb{b}_err")]
    states = [f"coalesce(rise_rate_pb{b}_status, 1) AS rise_rate_pb{b}_status" for b in PASSBANDS] + [f"coalesce(color_pb{a}_pb{b}_status, 4) AS color_pb{a}_pb{b}_status" for a, b in COLOR_PAIRS]
    names = [f"rise_rate_pb{b}" for b in PASSBANDS] + [f"color_pb{a}_pb{b}" for a, b in COLOR_PAIRS] + ["alert_snr_0", "snr_growth_rate", "hostgal_photoz"]
    well = " + ".join(f"({n}_status = 0)::INT" for n in names)
    return f"""{META_SQL}, {RISE_SQL}{tail(COLOR_SQL)}{tail(SUPPORT_SQL)},
rw AS (SELECT object_id, epoch, {rise} FROM rise GROUP BY ALL),
cw AS (SELECT object_id, epoch, {hue} FROM hue GROUP BY ALL),
w0 AS (SELECT m.object_id, e.epoch, {', '.join(columns)}, {', '.join(states)},
  alert_snr_0, alert_snr_0_err, coalesce(alert_snr_0_status, 5) AS alert_snr_0_status, snr_growth_rate, snr_growth_rate_err, coalesce(snr_growth_rate_status, 1) AS snr_growth_rate_status,
  hostgal_photoz, hostgal_photoz_err, 0 AS hostgal_photoz_status, coalesce(n_obs_total, 0) AS n_obs_total, coalesce(n_det_total, 0) AS n_det_total, coalesce(n_det_passbands, 0) AS n_det_passbands, coalesce(det_time_span_days, 0.0::DOUBLE) AS det_time_span_days
  FROM meta m CROSS JOIN (SELECT unnest([0.0::DOUBLE, 2.0::DOUBLE, 7.0::DOUBLE]) AS epoch) e LEFT JOIN support s ON s.object_id = m.object_id AND s.epoch = e.epoch
  LEFT JOIN rw ON rw.object_id = m.object_id AND rw.epoch = e.epoch LEFT JOIN cw ON cw.object_id = m.object_id AND cw.epoch = e.epoch),
wide AS (SELECT *, {well} AS well_constrained_features, 14 - ({well}) AS unconstrained_features FROM w0)"""


WIDE_SQL = _wide_sql()
_DOUBLES = [f"{f}{x}" for f in features.FEATURES for x in ("", "_err")]


def wide(spark, sf_dir, meta=None, *carried):
    """Representations of all objects or those of meta, with columns carried over from it."""
    return features.representation(metadata(spark, sf_dir) if meta is None else meta, _sequences(spark, sf_dir), EPOCHS, carried=carried)


REPRESENTATION_SQL = f"WITH {WIDE_SQL} SELECT object_id, epoch, {r6(*_DOUBLES, 'det_time_span_days')}, {', '.join(f'{f}_status' for f in features.FEATURES)}, n_obs_total, n_det_total, n_det_passbands, well_constrained_features, unconstrained_features FROM wide"


@query("o4_representation", REPRESENTATION_SQL)
def representation(spark, sf_dir):
    return rounded(wide(spark, sf_dir))


@query("o4_representation_in_slices", REPRESENTATION_SQL)
def representation_in_slices(spark, sf_dir):
    return rounded(features.representation(metadata(spark, sf_dir), _sliced(spark, sf_dir), EPOCHS))


@query("a6_constrained_counts", f"WITH {WIDE_SQL} SELECT epoch, well_constrained_features, count(*) AS n FROM wide GROUP BY ALL")
def constrained_counts(spark, sf_dir):
    return wide(spark, sf_dir).groupBy("epoch", "well_constrained_features").agg(F.count("*").alias("n"))


_STATUS_UNION = " UNION ALL ".join(f"SELECT object_id, epoch, '{f}' AS feature, {f}_status AS status FROM wide" for f in features.FEATURES)


@query("a25_constrainability", f"WITH {WIDE_SQL}, l AS ({_STATUS_UNION}) SELECT true_target, epoch, feature, count(*) AS n, round(100.0::DOUBLE * avg((status = 0)::INT), 6) AS pct FROM l JOIN meta USING (object_id) GROUP BY ALL")
def constrainability(spark, sf_dir):
    return rounded(features.constrainability(wide(spark, sf_dir), metadata(spark, sf_dir)))


_SHARES = {"pct_0": "n_det_total = 0", "pct_1": "n_det_total = 1", "pct_2": "n_det_total = 2", "pct_3_4": "n_det_total BETWEEN 3 AND 4", "pct_5_up": "n_det_total >= 5", "pct_bands_1": "n_det_passbands = 1", "pct_bands_2": "n_det_passbands = 2", "pct_bands_3_up": "n_det_passbands >= 3"}


@query(
    "a26_sparsity",
    f"""WITH {META_SQL}, {SUPPORT_SQL} SELECT true_target, epoch, count(*) AS n, round(avg(n_det_total), 6) AS mean, round(stddev_pop(n_det_total), 6) + 0.0 AS std, round(quantile_cont(n_det_total::DOUBLE, 0.5), 6) AS median,
  min(n_det_total) AS min, max(n_det_total) AS max, {', '.join(f'round(100.0::DOUBLE * avg(({c})::INT), 6) AS {k}' for k, c in _SHARES.items())},
  round(quantile_cont(n_det_total::DOUBLE, 0.25), 6) AS q25, round(quantile_cont(n_det_total::DOUBLE, 0.75), 6) AS q75 FROM support JOIN meta USING (object_id) GROUP BY true_target, epoch""",
)
def sparsity(spark, sf_dir):
    return rounded(features.sparsity(_sequences(spark, sf_dir), metadata(spark, sf_dir)))


QUERIES, ORACLE = query.queries, query.oracle
