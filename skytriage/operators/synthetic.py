"""Generators of synthetic light curves, hashed like all randomness here."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TARGET_CLASS
from ..functions.scalars import hash_uniform

#: Fixed values: (detections, passbands, share) of the target class at two days, detections and shares of other classes.
TARGET_CASES = ((1, 1, 0.500), (2, 1, 0.144), (2, 2, 0.289), (3, 2, 0.019), (4, 3, 0.039), (5, 3, 0.009))
OTHER_CASES = ((1, 0.27), (2, 0.25), (3, 0.38), (5, 0.10))
#: Scale and bound of the target's span in days, bounds of the others'.
SPAN_SCALE, SPAN_MOST, OTHER_SPAN = 0.35, 1.8, (0.01, 1.9)


def gaussian(seed: str, *keys):
    """Standard normal by the Box-Muller rule on two hash uniforms."""
    u = F.greatest(hash_uniform(f"{seed}a", *keys), F.lit(2.0**-33))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * hash_uniform(f"{seed}b", *keys))


def _choose(u: Column, values: list, shares: list[float]) -> Column:
    out, total = None, 0.0
    for v, p in zip(values[:-1], shares, strict=False):
        total += p
        out = F.when(u < total, v) if out is None else out.when(u < total, v)
    return out.otherwise(values[-1])


def sparsity(objects: DataFrame, epoch: float, cls: int = TARGET_CLASS, seed: int = 42) -> DataFrame:
    """objects with n_det, n_passbands and det_span_days as they are met at an epoch.

    At the alert there is one detection. At two days the target class has its joint cases and an exponential span up to
    SPAN_MOST, another class its own detections, one to three passbands and a uniform span; one detection spans nothing."""
    none = {"n_det": F.lit(1), "n_passbands": F.lit(1), "det_span_days": F.lit(0.0)}
    if epoch == 0.0:
        return objects.withColumns(none)
    own = F.col("object_id")
    u, v, w = (hash_uniform(f"{seed}{x}", own) for x in "cbs")
    if cls == TARGET_CLASS:
        shares = [c[2] for c in TARGET_CASES]
        rows = objects.withColumns({"n_det": _choose(u, [c[0] for c in TARGET_CASES], shares), "n_passbands": _choose(u, [c[1] for c in TARGET_CASES], shares)})
        span = F.least(-SPAN_SCALE * F.log1p(-w), F.lit(SPAN_MOST))
    else:
        rows = objects.withColumn("n_det", _choose(u, [c[0] for c in OTHER_CASES], [c[1] for c in OTHER_CASES]))
        rows = rows.withColumn("n_passbands", F.least("n_det", 1 + F.floor(3 * v)).cast("int"))
        span = OTHER_SPAN[0] + (OTHER_SPAN[1] - OTHER_SPAN[0]) * w
    return rows.withColumn("det_span_days", F.when(F.col("n_det") > 1, span).otherwise(0.0))


def light_curves(objects: DataFrame, rates: dict[int, float], fluxes: dict[int, float], noise: float = 5.0, t0: float = 58000.0, seed: int = 42) -> DataFrame:
    """Curves of objects with n_det, n_passbands and det_span_days: flux of a passband rises by its rate from its value at
    t0, with Gaussian noise. The first point is at t0, the others at uniform times in the span; each of the object's
    passbands comes once before any comes again. A point is detected at five sigma."""
    own = F.col("object_id")
    bands = F.array_sort(F.array(*(F.struct(hash_uniform(f"{seed}p{b}", own).alias("u"), F.lit(b).alias("b")) for b in rates)))
    later = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_det") - 1, F.lit(1))), lambda k: hash_uniform(f"{seed}t", own, k) * F.col("det_span_days"))
    times = F.when(F.col("n_det") > 1, F.concat(F.array(F.lit(0.0)), F.array_sort(later))).otherwise(F.array(F.lit(0.0)))
    rows = objects.withColumn("_bands", bands).select("*", F.posexplode(times).alias("k", "dt"))
    place = F.when(F.col("k") < F.col("n_passbands"), F.col("k")).otherwise(F.floor(hash_uniform(f"{seed}q", own, F.col("k")) * F.col("n_passbands")))
    rows = rows.withColumn("passband", F.get("_bands", place.cast("int"))["b"])
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for b, v in values.items() for x in (b, float(v)))), F.col("passband"))
    rows = rows.withColumn("flux", of(fluxes) + of(rates) * F.col("dt") + noise * gaussian(str(seed), own, F.col("k")))
    return rows.select("object_id", (t0 + F.col("dt")).alias("mjd"), "passband", "flux", F.lit(float(noise)).alias("flux_err"), (F.col("flux") / F.lit(float(noise)) >= 5).cast("int").alias("detected_bool"))


def curve_metadata(objects: DataFrame) -> DataFrame:
    """The metadata that goes with synthetic curves."""
    return objects.select("object_id", F.lit(0.15).alias("hostgal_photoz"), F.lit(0.01).alias("hostgal_photoz_err"), F.lit(TARGET_CLASS).alias("true_target"))
