"""Inverse selection weights, covariate balance and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SelectionConfig
from ..functions.scalars import selection_probability
from .quantiles import percentiles


def weight_diagnostics(df: DataFrame, w: str = "w") -> DataFrame:
    c = F.col(w)
    middle, high = percentiles(df, w, [0.5, 0.95]).get((), [None, None])
    s = df.agg(F.count(w).alias("n"), F.min(w).alias("w_min"), F.lit(middle).cast("double").alias("w_median"), F.lit(high).cast("double").alias("w_p95"), F.max(w).alias("w_max"), F.avg(w).alias("w_mean"), F.stddev_pop(w).alias("w_std"), F.sum(w).alias("s1"), F.sum(c * c).alias("s2"))
    out = s.withColumn("cv", F.try_divide("w_std", "w_mean")).withColumn("ess", F.try_divide(F.col("s1") * F.col("s1"), "s2"))
    return out.withColumn("ess_fraction", F.try_divide("ess", F.col("n"))).drop("s1", "s2")


def balance(df: DataFrame, features: list[str], selected: str = "S", w: str = "w") -> DataFrame:
    """Standardized mean differences of the selected rows from all, unweighted and weighted; constant features drop out."""
    own = F.col(selected) == 1
    cols = []
    for f in features:
        cols += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.avg(F.when(own, F.col(f))).alias(f"u_{f}"), F.sum(F.when(own, F.col(w) * F.col(f))).alias(f"wx_{f}")]
    s = df.agg(*cols, F.sum(F.when(own, F.col(w))).alias("w_sum"))
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("std"), (F.col(f"u_{f}") - F.col(f"m_{f}")).alias("u"), (F.col(f"wx_{f}") / F.col("w_sum") - F.col(f"m_{f}")).alias("v")) for f in features))
    rows = s.select(F.explode(cells).alias("x")).select("x.*").where("std > 0")
    rows = rows.select("feature", (F.col("u") / F.col("std")).alias("smd_unweighted"), (F.col("v") / F.col("std")).alias("smd_weighted"))
    return rows.withColumn("reduction", F.abs("smd_unweighted") - F.abs("smd_weighted"))


def positivity(df: DataFrame, cutoff: float = 1.5, config: SelectionConfig = SelectionConfig()) -> DataFrame:  # noqa: B008
    """How much of the population lies where hardly anything is selected."""
    z = F.when(F.col("hostgal_photoz") > cutoff, F.col("hostgal_photoz"))
    s = df.agg(F.count("*").alias("n"), F.count(z).alias("n_affected"), F.min(z).alias("lo"), F.max(z).alias("hi"))
    return s.select("n", "n_affected", F.coalesce(100.0 * F.try_divide("n_affected", "n"), F.lit(0.0)).alias("pct_affected"), F.coalesce("lo", F.lit(cutoff)).alias("z_min"), F.coalesce("hi", F.lit(cutoff)).alias("z_max"), F.lit(config.p_floor).alias("p_low"), selection_probability(F.lit(cutoff), config).alias("p_high"))
