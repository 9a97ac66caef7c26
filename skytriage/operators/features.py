"""Low-parameter features of prefixes, each with value, error and status. Inputs come from asof.epoch_sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COLOR_PAIRS, PASSBANDS, FeatureConfig
from ..functions.scalars import FEW_POINTS, NO_BASELINE, NO_DETECTION, NO_PAIR, NON_POSITIVE, WELL, color, color_error, snr
from .moments import moments

KEYS = ("object_id", "epoch")
FEATURES = (*(f"rise_rate_pb{b}" for b in PASSBANDS), *(f"color_pb{a}_pb{b}" for a, b in COLOR_PAIRS), "alert_snr_0", "snr_growth_rate", "hostgal_photoz")


def rise_rates(prefixes: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """Weighted least-squares slope of flux per object, epoch and passband, one grouped pass.

    Time is taken from t0, which leaves the slope as it is and avoids cancellation. Two detections give the plain slope
    with the errors' root of squares; a flux error that is not positive leaves a fit unconstrained by too few points."""
    det = F.col("det")
    x, f, e = F.col("mjd") - F.col("t0"), F.col("flux"), F.col("flux_err")
    w = F.when(det & (e > 0), 1.0 / (e * e))
    d = lambda c: F.when(det, c)
    at = F.struct("mjd", "flux")
    sums = prefixes.groupBy(*KEYS, "passband").agg(
        F.count("*").alias("n_obs"), F.count(d(x)).alias("n_det"), F.count_if(det & (F.col("flux_err") <= 0)).alias("n_bad"),
        F.min(d(x)).alias("x_min"), F.max(d(x)).alias("x_max"), F.min(d(at)).alias("first"), F.max(d(at)).alias("last"), F.sum(d(e * e)).alias("see"),
        F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * f).alias("swf"), F.sum(w * x * x).alias("swxx"), F.sum(w * x * f).alias("swxf"),
    )
    delta = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    dt = F.col("x_max") - F.col("x_min")
    two = F.col("n_det") == 2
    status = (
        F.when((F.col("n_det") < config.min_points_for_slope) | ((F.col("n_det") > 2) & (F.col("n_bad") > 0)), FEW_POINTS)
        .when(dt <= 0, NO_BASELINE).when(~two & (F.col("delta") <= 0), NO_BASELINE).otherwise(WELL)
    )
    rows = sums.withColumns({"delta": delta, "dt_days": dt}).withColumn("status", status)
    good = F.col("status") == WELL
    slope = F.when(two, (F.col("last.flux") - F.col("first.flux")) / F.col("dt_days")).otherwise((F.col("sw") * F.col("swxf") - F.col("swx") * F.col("swf")) / F.col("delta"))
    err = F.when(two, F.sqrt("see") / F.col("dt_days")).otherwise(F.sqrt(F.col("sw") / F.col("delta")))
    return rows.select(*KEYS, "passband", "n_obs", "n_det", "status", F.when(good, slope).alias("slope"), F.when(good, err).alias("slope_err"), F.when(good, F.col("dt_days")).alias("dt_days"))


def rise_diagnostics(prefixes: DataFrame) -> DataFrame:
    """Reduced chi-square and condition number of fits with three detections or more, from one grouped pass.

    Centred moments give both: what the fit leaves of the flux's square, and the singular values of (1, time). They merge, so
    a passband of very many rows may lie in many tasks, and times need not be taken from t0."""
    rows = prefixes.where("det and flux_err > 0").withColumn("_w", 1.0 / (F.col("flux_err") * F.col("flux_err")))
    m = moments(rows, [*KEYS, "passband"], "mjd", "flux", "_w").where("n > 2 and cxx > 0")
    n, square = F.col("n").cast("double"), F.col("txx") + F.col("n") * F.col("tx") * F.col("tx")
    total = F.col("n") * F.col("tx")
    top = (n + square + F.sqrt((n - square) * (n - square) + 4.0 * total * total)) / 2.0
    chi2 = F.greatest(F.col("cyy") - F.col("cxy") * F.col("cxy") / F.col("cxx"), F.lit(0.0))
    return m.select(*KEYS, "passband", "n", (chi2 / (n - 2)).alias("chi2_red"), F.log10(top / F.sqrt(n * F.col("txx"))).alias("log10_condition"))


def colors(prefixes: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """Colour of each adjacent passband pair from its nearest two detections, at most max_color_dt_days apart.

    Ties go to the earlier first and then the earlier second detection. The nearest two are neighbours in time, so each
    first detection meets the last second one before it and the next one after it: two windows over one exchange, linear
    in an object's detections. Prefixes with a column `slice` (see asof.epoch_sequences) are worked on in slices of time,
    each by itself, and what the slices before and after hold is joined in: a row for each slice."""
    pairs = F.array(*(F.struct(F.lit(a).alias("b1"), F.lit(b).alias("b2")) for a, b in COLOR_PAIRS))
    det = prefixes.where("det").select(*KEYS, "passband", "mjd", "flux", "flux_err", *(["slice"] if "slice" in prefixes.columns else []))
    both = det.withColumn("pair", F.explode(pairs)).where((F.col("passband") == F.col("pair.b1")) | (F.col("passband") == F.col("pair.b2")))
    sliced = "slice" in both.columns
    own = Window.partitionBy(*KEYS, "pair", *(["slice"] if sliced else []))
    second = F.col("passband") == F.col("pair.b2")
    so_far = lambda order: own.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # noqa: E731  rows of one time included
    backward, forward = F.when(second, F.struct("mjd", (-F.col("flux")).alias("f"), (-F.col("flux_err")).alias("e"))), F.when(second, F.struct("mjd", "flux", "flux_err"))
    last, after = F.max(backward).over(so_far(F.asc("mjd"))), F.min(forward).over(so_far(F.desc("mjd")))
    if sliced:
        line = Window.partitionBy(*KEYS, "pair").orderBy("slice")  # a row for each slice
        ends = both.groupBy(*KEYS, "pair", "slice").agg(F.max(backward).alias("_b"), F.min(forward).alias("_f"))
        carried = ends.select(*KEYS, "pair", "slice", F.max("_b").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_f").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
        both = both.withColumns({"last": last, "after": after}).join(carried, [*KEYS, "pair", "slice"])
        last, after = F.coalesce("last", "_before"), F.coalesce("after", "_behind")
    met = both.withColumns({"last": last, "after": after}).where(F.col("passband") == F.col("pair.b1"))
    before = F.when(F.col("last").isNotNull(), F.struct(F.col("last.mjd").alias("mjd"), (-F.col("last.f")).alias("flux"), (-F.col("last.e")).alias("flux_err")))
    one = F.struct("mjd", "flux", "flux_err")
    to = lambda x: F.when(x.isNotNull(), F.struct(F.abs(F.col("mjd") - x["mjd"]).alias("dt"), one.alias("a"), x.alias("b")))
    near = met.groupBy(*KEYS, "pair").agg(F.min(F.least(to(before), to(F.col("after")))).alias("m")).where("m is not null")
    f1, e1, f2, e2 = (F.col(f"m.{x}") for x in ("a.flux", "a.flux_err", "b.flux", "b.flux_err"))
    status = F.when(F.col("m.dt") > config.max_color_dt_days, NO_PAIR).when((f1 <= 0) | (f2 <= 0), NON_POSITIVE).otherwise(WELL)
    good = F.col("status") == WELL
    return near.withColumn("status", status).select(*KEYS, F.col("pair.b1").alias("b1"), F.col("pair.b2").alias("b2"), "status", F.col("m.dt").alias("min_dt_days"), F.when(good, color(f1, f2)).alias("color"), F.when(good, color_error(f1, e1, f2, e2)).alias("color_err"))


def support(prefixes: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """Counts, detected span, first signal-to-noise and its growth of each object and epoch."""
    det = F.col("det")
    own = F.when(det, F.struct("mjd", "passband", "flux", "flux_err"))
    rows = prefixes.groupBy(*KEYS).agg(
        F.count("*").alias("n_obs_total"), F.count_if("det").alias("n_det_total"), F.count_distinct(F.when(det, F.col("passband"))).alias("n_det_passbands"),
        F.min(own).alias("first"), F.max(own).alias("last"),
    )
    span = F.coalesce(F.col("last.mjd") - F.col("first.mjd"), F.lit(0.0))
    snr0, snr1 = snr(F.col("first.flux"), F.col("first.flux_err")), snr(F.col("last.flux"), F.col("last.flux_err"))
    growth = F.when(F.col("n_det_total") < config.min_points_for_snr_rate, FEW_POINTS).when(span <= 0, NO_BASELINE).otherwise(WELL)
    some = F.col("n_det_total") >= 1
    rows = rows.withColumns({"det_time_span_days": span, "snr_growth_rate_status": growth})
    grows = F.col("snr_growth_rate_status") == WELL
    return rows.select(
        *KEYS, "n_obs_total", "n_det_total", "n_det_passbands", "det_time_span_days",
        F.when(some, snr0).alias("alert_snr_0"), F.when(some, F.lit(1.0)).alias("alert_snr_0_err"), F.when(some, WELL).otherwise(NO_DETECTION).alias("alert_snr_0_status"),
        F.when(grows, (snr1 - snr0) / F.col("det_time_span_days")).alias("snr_growth_rate"), F.when(grows, F.lit(math.sqrt(2.0)) / F.col("det_time_span_days")).alias("snr_growth_rate_err"), "snr_growth_rate_status",
    )


def representation(meta: DataFrame, prefixes: DataFrame, epochs: tuple[float, ...], config: FeatureConfig = FeatureConfig(), carried: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """One wide row per object of meta and epoch: <feature>, <feature>_err, <feature>_status and support counts.

    Objects without rows have every photometric feature unconstrained. Columns of meta named in carried follow the keys: a join
    with meta later costs a shuffle or, as Catalyst's sizes leave out that epochs are exploded, a broadcast of all objects."""
    rise = rise_rates(prefixes, config).groupBy(*KEYS).agg(*(F.max(F.when(F.col("passband") == b, F.struct("slope", "slope_err", "status"))).alias(f"r{b}") for b in PASSBANDS))
    hue = colors(prefixes, config).groupBy(*KEYS).agg(*(F.max(F.when(F.col("b1") == a, F.struct("color", "color_err", "status"))).alias(f"c{a}") for a, _ in COLOR_PAIRS))
    rows = meta.select("object_id", *carried, "hostgal_photoz", "hostgal_photoz_err").withColumn("epoch", F.explode(F.array(*(F.lit(float(e)) for e in epochs))))
    rows = rows.join(support(prefixes, config), list(KEYS), "left").join(rise, list(KEYS), "left").join(hue, list(KEYS), "left")
    out = [*KEYS, *carried]
    for b in PASSBANDS:
        out += [F.col(f"r{b}.slope").alias(f"rise_rate_pb{b}"), F.col(f"r{b}.slope_err").alias(f"rise_rate_pb{b}_err"), F.coalesce(f"r{b}.status", F.lit(FEW_POINTS)).alias(f"rise_rate_pb{b}_status")]
    for a, b in COLOR_PAIRS:
        out += [F.col(f"c{a}.color").alias(f"color_pb{a}_pb{b}"), F.col(f"c{a}.color_err").alias(f"color_pb{a}_pb{b}_err"), F.coalesce(f"c{a}.status", F.lit(NO_PAIR)).alias(f"color_pb{a}_pb{b}_status")]
    out += ["alert_snr_0", "alert_snr_0_err", F.coalesce("alert_snr_0_status", F.lit(NO_DETECTION)).alias("alert_snr_0_status")]
    out += ["snr_growth_rate", "snr_growth_rate_err", F.coalesce("snr_growth_rate_status", F.lit(FEW_POINTS)).alias("snr_growth_rate_status")]
    z, sound = F.col("hostgal_photoz"), F.col("hostgal_photoz").isNotNull() & ~F.isnan("hostgal_photoz") & (F.abs("hostgal_photoz") < float("inf"))
    out += [F.when(sound, z).alias("hostgal_photoz"), F.when(sound, F.coalesce(F.nanvl("hostgal_photoz_err", F.lit(0.0)), F.lit(0.0))).alias("hostgal_photoz_err"), F.when(sound, WELL).otherwise(FEW_POINTS).alias("hostgal_photoz_status")]
    out += [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_obs_total", "n_det_total", "n_det_passbands")] + [F.coalesce("det_time_span_days", F.lit(0.0)).alias("det_time_span_days")]
    wide = rows.select(*out)
    well = sum((F.col(f"{f}_status") == WELL).cast("int") for f in FEATURES)
    return wide.withColumn("well_constrained_features", well).withColumn("unconstrained_features", F.lit(len(FEATURES)) - F.col("well_constrained_features"))


def long_status(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., feature, status) of a representation."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_status").alias("status")) for f in FEATURES))
    return wide.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.feature", "x.status")


def constrainability(wide: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of well-constrained values by class, epoch and feature; the denominator is all objects of classes."""
    rows = long_status(wide.join(classes.select("object_id", "true_target").hint("merge"), "object_id"), ["true_target", "epoch"])  # not all objects by broadcast
    return rows.groupBy("true_target", "epoch", "feature").agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("status") == WELL).cast("double"))).alias("pct"))


def sparsity(prefixes: DataFrame, classes: DataFrame) -> DataFrame:
    """Distribution of detections and passbands by class and epoch over objects that have rows."""
    each = support(prefixes).join(classes.select("object_id", "true_target"), "object_id")
    n, b = F.col("n_det_total"), F.col("n_det_passbands")
    q = F.percentile("n_det_total", F.array(F.lit(0.25), F.lit(0.75)))
    share = lambda cond: 100.0 * F.avg(cond.cast("double"))
    return each.groupBy("true_target", "epoch").agg(
        F.count("*").alias("n"), F.avg(n.cast("double")).alias("mean"), F.stddev_pop(n.cast("double")).alias("std"), F.median(n).cast("double").alias("median"), F.min(n).alias("min"), F.max(n).alias("max"), q.alias("q"),
        share(n == 0).alias("pct_0"), share(n == 1).alias("pct_1"), share(n == 2).alias("pct_2"), share(n.between(3, 4)).alias("pct_3_4"), share(n >= 5).alias("pct_5_up"),
        share(b == 1).alias("pct_bands_1"), share(b == 2).alias("pct_bands_2"), share(b >= 3).alias("pct_bands_3_up"),
    ).withColumns({"q25": F.col("q")[0], "q75": F.col("q")[1]}).drop("q")
