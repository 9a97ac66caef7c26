"""Ranking quality of scores against a binary truth (column hit, 0 or 1), with ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shift import cumulative


def auc(df: DataFrame, score: str, hit: str = "hit", by: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC and average precision, tie-averaged and step-wise; both null where a class is missing.

    Counts of distinct scores are summed from the top."""
    rows = cumulative(df, score, {"tp": F.col(hit), "fp": 1 - F.col(hit)}, by, descending=True)
    each = rows.groupBy(*by).agg(
        F.max("cum_tp").alias("n_pos"), F.max("cum_fp").alias("n_neg"),
        F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0)).alias("wins"), F.sum(F.col("tp") * F.try_divide("cum_tp", F.col("cum_tp") + F.col("cum_fp"))).alias("ap"),
    )
    some = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return each.select(*by, "n_pos", "n_neg", F.when(some, F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"), F.when(some, F.col("ap") / F.col("n_pos")).alias("avg_precision"))


def auc_or_half(df: DataFrame, score: str, hit: str = "hit") -> float:
    """AUC, 0.5 where a class is missing."""
    found = auc(df, score, hit).first()
    return 0.5 if found is None or found.roc_auc is None else found.roc_auc


def completeness(df: DataFrame, n_det: str = "n_det_total", n_bands: str = "n_det_passbands") -> DataFrame:
    """df once for each subset (all, several detections, several passbands, both) that a row is in."""
    d, b = F.col(n_det) > 1, F.col(n_bands) > 1
    names = F.array_compact(F.array(F.lit("all"), F.when(d, F.lit("n_det>1")), F.when(b, F.lit("n_pb>1")), F.when(d & b, F.lit("both"))))
    return df.withColumn("subset", F.explode(names))
