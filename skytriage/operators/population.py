"""Populations, seeded selection and what it retains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASS_IDS, SelectionConfig
from ..functions.scalars import hash_uniform, logistic, selection_probability


def true_population(meta: DataFrame, classes: tuple[int, ...] = CLASS_IDS) -> DataFrame:
    return meta.where(F.col("true_target").isin(*classes))


def held_out(meta: DataFrame, cls: int, n: int | None = None) -> DataFrame:
    """Objects of one class, the first n by id if asked for."""
    rows = meta.where(F.col("true_target") == cls)
    return rows if n is None else rows.orderBy("object_id").limit(n)


def select(pop: DataFrame, config: SelectionConfig = SelectionConfig()) -> DataFrame:  # noqa: B008
    """pop with p_spec and the draw S: a hash of (seed, object_id), so the subset depends on nothing else."""
    pop = pop.withColumn("p_spec", selection_probability(F.col("hostgal_photoz"), config))
    return pop.withColumn("S", (hash_uniform(config.seed, F.col("object_id")) < F.col("p_spec")).cast("int"))


def membership(pop: DataFrame, ids: DataFrame, name: str = "S") -> DataFrame:
    return pop.join(ids.select("object_id").distinct().withColumn(name, F.lit(1)), "object_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_observations(meta: DataFrame, obs: DataFrame) -> DataFrame:
    return meta.join(obs.select("object_id").distinct(), "object_id", "left_semi")


def of_objects(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """Semi join; Catalyst broadcasts the ids only where their measured size allows."""
    return obs.join(ids.select("object_id"), "object_id", "left_semi")


def class_balance(df: DataFrame, column: str = "true_target") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def selection_summary(df: DataFrame) -> DataFrame:
    """Counts of TRUE and BIASED and their ratio by class, and over all in the row with class null."""
    out = df.rollup("true_target").agg(F.count("*").alias("n_true"), F.sum("S").alias("n_biased"))
    return out.withColumn("retention", F.round(F.col("n_biased") / F.col("n_true"), 6))


def proportions(df: DataFrame) -> DataFrame:
    """Class shares before and after selection and their shift."""
    c = df.groupBy("true_target").agg(F.count("*").alias("n_true"), F.sum("S").alias("n_biased"))
    total = c.agg(F.sum("n_true").alias("t"), F.sum("n_biased").alias("b"))
    rows = c.crossJoin(total)  # one row
    return rows.select("true_target", "n_true", "n_biased", (F.col("n_biased") / F.col("n_true")).alias("retention"), (F.col("n_true") / F.col("t")).alias("share_true"), F.try_divide("n_biased", "b").alias("share_biased"), (F.try_divide("n_biased", "b") - F.col("n_true") / F.col("t")).alias("shift"))


def selection_curve(df: DataFrame, bins: int = 30, top: float = 1.5) -> DataFrame:
    """Retained share in equal redshift bins; bins without objects have 0."""
    width = top / bins
    b = F.least(F.floor(F.col("hostgal_photoz") / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col("hostgal_photoz").between(0, top)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("S").alias("kept"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("kept", "n"), F.lit(0.0)).alias("retained"))  # counts: at most `bins` rows


#: Scenarios of the retention sweep (p_floor, p_bright, z_50, w_z), the default and each parameter moved by itself.
SCENARIOS = (
    ("Baseline", 0.10, 0.80, 0.50, 0.15),
    ("p_floor=0.00", 0.00, 0.80, 0.50, 0.15), ("p_floor=0.05", 0.05, 0.80, 0.50, 0.15), ("p_floor=0.20", 0.20, 0.80, 0.50, 0.15),
    ("p_bright=0.60", 0.10, 0.60, 0.50, 0.15), ("p_bright=0.95", 0.10, 0.95, 0.50, 0.15),
    ("z_50=0.30", 0.10, 0.80, 0.30, 0.15), ("z_50=0.40", 0.10, 0.80, 0.40, 0.15), ("z_50=0.60", 0.10, 0.80, 0.60, 0.15), ("z_50=0.80", 0.10, 0.80, 0.80, 0.15),
    ("w_z=0.05", 0.10, 0.80, 0.50, 0.05), ("w_z=0.10", 0.10, 0.80, 0.50, 0.10), ("w_z=0.25", 0.10, 0.80, 0.50, 0.25),
)


def retention_sweep(pop: DataFrame, scenarios: tuple = SCENARIOS) -> DataFrame:
    """Expected retention of each scenario over all, by class, and of the rare classes against the common one, all in one scan.

    A floor of 0 is allowed here, though no selection may have it."""
    z = F.col("hostgal_photoz")
    chance = {k: logistic(z, *x) for k, (_, *x) in enumerate(scenarios)}
    part = lambda k, c: F.avg(F.when(F.col("true_target") == c, chance[k])).alias(f"r{c}_{k}")
    s = pop.agg(*(F.avg(x).alias(f"all_{k}") for k, x in chance.items()), *(part(k, c) for k in chance for c in CLASS_IDS))
    cells = F.array(*(F.struct(F.lit(name).alias("scenario"), F.col(f"all_{k}").alias("retention"), *(F.col(f"r{c}_{k}").alias(f"retention_{c}") for c in CLASS_IDS)) for k, (name, *_) in enumerate(scenarios)))
    rows = s.select(F.explode(cells).alias("x")).select("x.*")
    return rows.select("*", *(F.try_divide(f"retention_{c}", "retention_90").alias(f"ratio_{c}_90") for c in (64, 95)))


def top_cadences(df: DataFrame, n: int = 10) -> DataFrame:
    """The n commonest cadences and the share of each class in them."""
    top = df.groupBy("libid_cadence").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "libid_cadence").limit(n)
    return df.join(F.broadcast(top), "libid_cadence").groupBy("libid_cadence", "total", "true_target").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.col("total"))  # top: n rows


def downsample_class(df: DataFrame, cls: int, n: int, seed: int = 42) -> DataFrame:
    """Exactly n objects of one class (all, if fewer), chosen by hash order; other classes stay whole."""
    own = df.where(F.col("true_target") == cls).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("object_id").cast("string"))), "object_id").limit(n)
    return df.where(F.col("true_target") != cls).unionByName(own)


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value besides null: a minimum and a maximum each, no distinct."""
    found = df.agg(*(F.max(c).alias(f"hi_{c}") for c in columns), *(F.min(c).alias(f"lo_{c}") for c in columns)).first()
    return [c for c in columns if found[f"hi_{c}"] is not None and found[f"hi_{c}"] != found[f"lo_{c}"]]


def hash_rank(df: DataFrame, u: Column, by: tuple[str, ...], name: str = "rank", rows: int = 200_000) -> DataFrame:
    """Rank from 1 by a hash uniform and object_id inside each group: counts of slices of the uniform first, then a window
    inside each slice of about `rows` rows, so that no group is one task."""
    slices = max(1, -(-df.count() // rows))
    df = df.withColumn("_u", u).withColumn("_slice", F.least(F.floor(F.col("_u") * slices), F.lit(slices - 1)))
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_slice").agg(F.count("*").alias("_n")).select(*by, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))  # a row for each slice and group
    same = [df[c].eqNullSafe(F.col(f"_r_{c}")) for c in (*by, "_slice")]
    joined = df.join(F.broadcast(base.withColumnsRenamed({c: f"_r_{c}" for c in (*by, "_slice")})), same)
    order = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_u", "object_id"))
    return joined.withColumn(name, F.col("_base") + order).drop("_u", "_slice", "_base", *(f"_r_{c}" for c in (*by, "_slice")))
