"""Distance of an object from a reference sample, over the features that it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles

#: The features that are identifiable at each epoch; other epochs have the first entry.
SUBSPACES = {
    0.0: ("hostgal_photoz",),
    2.0: ("hostgal_photoz", "alert_snr_0", "snr_growth_rate", "color_pb2_pb3", "color_pb3_pb4"),
    7.0: ("hostgal_photoz", "alert_snr_0", "snr_growth_rate", "color_pb0_pb1", "color_pb1_pb2", "color_pb2_pb3", "color_pb3_pb4", "color_pb4_pb5", "rise_rate_pb1", "rise_rate_pb2", "rise_rate_pb3"),
}
FLOOR = 1e-6


def fit(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of each feature over its values, (0, 1) without any, deviations at least FLOOR."""
    x = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    s = df.agg(*(F.avg(x(f)).alias(f"m_{f}") for f in features), *(F.stddev_samp(x(f)).alias(f"s_{f}") for f in features)).first()
    return {f: (0.0, 1.0) if s[f"m_{f}"] is None else (s[f"m_{f}"], max(s[f"s_{f}"] or FLOOR, FLOOR)) for f in features}


def score(df: DataFrame, fitted: dict[str, tuple[float, float]] | None, name: str = "novelty") -> DataFrame:
    """Root mean square of the standardized available features, 0 if there is none."""
    if fitted is None:
        raise RuntimeError("novelty is scored before it is fitted")
    total, have = F.lit(0.0), F.lit(0)
    for f, (m, s) in fitted.items():
        z = (F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) - F.lit(m)) / F.lit(s)
        total, have = total + F.coalesce(z * z, F.lit(0.0)), have + z.isNotNull().cast("int")
    return df.withColumn(name, F.coalesce(F.sqrt(F.try_divide(total, have)), F.lit(0.0)))


def epoch_scores(train: DataFrame, evaluated: DataFrame, epoch: float) -> DataFrame:
    """Novelty of evaluated rows at an epoch, fitted to train at that epoch, over features that both have."""
    names = [f for f in SUBSPACES.get(float(epoch), SUBSPACES[0.0]) if f in train.columns and f in evaluated.columns]
    at = F.col("epoch") == float(epoch)
    return score(evaluated.where(at), fit(train.where(at), names))


def scale(df: DataFrame, name: str = "novelty") -> float:
    """Population deviation of scores, 1 if it is 0 or unknown."""
    return df.agg(F.stddev_pop(name)).first()[0] or 1.0


def exceedance(inside: DataFrame, outside: DataFrame, name: str = "novelty", level: float = 0.95) -> DataFrame:
    """Share of outside scores above the inside scores' percentile."""
    edge = percentiles(inside, name, [level]).get((), [None])[0]
    above = F.col(name) > F.lit(edge).cast("double")
    return outside.agg(F.lit(edge).cast("double").alias("threshold"), F.count("*").alias("n"), (100.0 * F.avg(above.cast("double"))).alias("pct_above"))
