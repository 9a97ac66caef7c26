"""First detections and leakage-free prefixes: rows of an object up to a day, or up to so many days past its first detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPOCHS, FORBIDDEN, FeatureConfig
from ..functions.scalars import is_detected


class LeakageError(ValueError):
    """Rows beyond an object's cutoff."""


def strip_forbidden(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in FORBIDDEN if c in df.columns))


def with_detection(obs: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """obs with a boolean `det`; an absent flag column counts as 0."""
    flag = F.col("detected_bool") if "detected_bool" in obs.columns else F.lit(0)
    return obs.withColumn("det", is_detected(F.col("flux"), F.col("flux_err"), flag, config))


def first_detection(obs: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """Rows (object_id, t0) of all objects; t0 is null for those never detected."""
    return with_detection(obs, config).groupBy("object_id").agg(F.min(F.when(F.col("det"), F.col("mjd"))).alias("t0"))


def truncate_at_mjd(obs: DataFrame, cutoff: float | DataFrame) -> DataFrame:
    """Rows with mjd <= cutoff, one for all or a table (object_id, cutoff); objects without a cutoff drop out."""
    obs = strip_forbidden(obs)
    if not isinstance(cutoff, DataFrame):
        return obs.where(F.col("mjd") <= cutoff)
    if "object_id" not in obs.columns:
        raise ValueError("cutoffs by object need a column object_id")
    return obs.join(cutoff.select("object_id", "cutoff"), "object_id").where(F.col("mjd") <= F.col("cutoff")).drop("cutoff")


def truncate_at_epoch(obs: DataFrame, epoch: float, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    cutoffs = first_detection(obs, config).where("t0 is not null").select("object_id", (F.col("t0") + F.lit(float(epoch))).alias("cutoff"))
    return truncate_at_mjd(obs, cutoffs)


def epoch_sequences(obs: DataFrame, epochs: tuple[float, ...] = EPOCHS, config: FeatureConfig = FeatureConfig(), slice_rows: int | None = None) -> DataFrame:  # noqa: B008
    """Each object's prefixes at all epochs in one pass, with columns t0 and epoch.

    t0 is a window minimum, so the rows are shuffled once by object; every later grouping by (object_id, ...) within
    that order needs no join back. With `slice_rows`, objects of more rows than that are not gathered: their count, span and
    t0 come from sums by task and are joined in (at most a row for each slice_rows rows of the table), and a column `slice`
    cuts their time into equal parts of about so many rows. Objects of fewer rows have slice 0."""
    from pyspark.sql import Window

    rows = with_detection(strip_forbidden(obs), config)
    seen = F.min(F.when(F.col("det"), F.col("mjd")))
    few = rows
    if slice_rows is not None:
        hot = rows.groupBy("object_id").agg(F.count("mjd").alias("_n"), F.min("mjd").alias("_low"), F.max("mjd").alias("_high"), seen.alias("t0")).where(F.col("_n") > slice_rows)
        few = rows.join(F.broadcast(hot.select("object_id")), "object_id", "left_anti")
        many = rows.join(F.broadcast(hot), "object_id").where("t0 is not null")
        parts = F.ceil(F.col("_n") / slice_rows)
        place = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("mjd") - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts)).otherwise(0)
        many = many.withColumn("slice", F.least(place, parts - 1).cast("long")).drop("_n", "_low", "_high")
    few = few.withColumn("t0", seen.over(Window.partitionBy("object_id"))).where("t0 is not null")
    rows = few if slice_rows is None else few.withColumn("slice", F.lit(0).cast("long")).unionByName(many)
    return rows.withColumn("epoch", F.explode(F.array(*(F.lit(float(e)) for e in epochs)))).where(F.col("mjd") <= F.col("t0") + F.col("epoch"))


def leakage_violations(prefix: DataFrame, t0: DataFrame, epoch: float, slack: float = 1e-6) -> DataFrame:
    """Objects of a prefix whose last row lies beyond t0 + epoch."""
    last = prefix.groupBy("object_id").agg(F.max("mjd").alias("last_mjd"))
    return last.join(t0.select("object_id", "t0"), "object_id").where(F.col("last_mjd") > F.col("t0") + epoch + slack)


def assert_leakage_safety(prefix: DataFrame, t0: DataFrame, epoch: float) -> None:
    if (bad := leakage_violations(prefix, t0, epoch).first()) is not None:
        raise LeakageError(f"LEAKAGE VIOLATION: object {bad.object_id} has a row at {bad.last_mjd}, beyond {bad.t0} + {epoch} days")
