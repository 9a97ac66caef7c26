"""Views that carry the driver's tables over to the study's data model, as pure column expressions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform, normalized, selection_probability
from ..sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photometry(table(spark, sf_dir, "events"))


def photometry(e: DataFrame) -> DataFrame:
    """events as photometry: a user is an object, an event type a passband."""
    band = F.when(F.lit(False), -1)
    for k, name in enumerate(("click", "error", "purchase", "signup", "view")):
        band = band.when(F.col("event_type") == name, k)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    err = 1.0 + F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int") / 10.0
    rows = e.select(
        F.col("user_id").alias("object_id"), (micros.cast("double") / F.lit(86400000000.0) + F.lit(40587.0)).alias("mjd"),
        band.otherwise(-1).cast("int").alias("passband"), F.col("value").alias("flux"), err.alias("flux_err"),
    )
    return rows.withColumn("detected_bool", (F.col("flux") / F.col("flux_err") >= 5).cast("int"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(table(spark, sf_dir, "customer"))


def objects(c: DataFrame) -> DataFrame:
    """customers as objects."""
    cls = F.when(F.col("c_mktsegment") == "BUILDING", 64).when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), 90).when(F.col("c_mktsegment") == "FURNITURE", 95).otherwise(15)
    return c.select(F.col("c_custkey").alias("object_id"), ((F.col("c_acctbal") + 1000) / 5500.0).alias("hostgal_photoz"), F.lit(0.05).alias("hostgal_photoz_err"), cls.alias("true_target"), F.col("c_nationkey").alias("libid_cadence"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a larger population for the selection study."""
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    cls = F.when(p == "1", 64).when(p.isin("2", "3"), 90).when(p == "4", 95).otherwise(15)
    z = F.col("o_totalprice") / 250000.0
    return o.select(
        F.col("o_orderkey").alias("object_id"), z.alias("hostgal_photoz"), F.lit(0.05).alias("hostgal_photoz_err"), cls.alias("true_target"),
        (F.lit(36.0) + 5.0 * z).alias("distmod"), (F.pmod(F.col("o_custkey"), F.lit(50)) / 500.0).alias("mwebv"), F.pmod(F.col("o_custkey"), F.lit(97)).alias("libid_cadence"),
    )


def selected(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """The study classes of the population with their chance of selection and the seeded draw S."""
    pop = spread(population(spark, sf_dir).where(F.col("true_target").isin(64, 90, 95)))  # a digest for each draw
    pop = pop.withColumn("p_spec", selection_probability(F.col("hostgal_photoz")))
    return pop.withColumn("S", (hash_uniform(seed, F.col("object_id")) < F.col("p_spec")).cast("int"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed-form stand-in for a classifier: probabilities and novelty of each selected object at epochs 0, 2 and 7.

    Later epochs favour the true class more; all randomness is hashed."""
    rows = selected(spark, sf_dir).select("object_id", "hostgal_photoz", "distmod", "mwebv", F.col("true_target").alias("y"), "S", F.explode(F.array(F.lit(0), F.lit(2), F.lit(7))).alias("epoch"))
    raw = [F.lit(0.02) + hash_uniform(f"p{c}", F.col("object_id"), F.col("epoch")) + F.when(F.col("y") == c, 0.25 + 0.05 * F.col("epoch")).otherwise(0.0) for c in (64, 90, 95)]
    rows = rows.withColumns({f"r{c}": x for c, x in zip((64, 90, 95), raw, strict=True)})
    p = normalized(F.col("r64"), F.col("r90"), F.col("r95"))
    rows = rows.withColumns({f"p_{c}": x for c, x in zip((64, 90, 95), p, strict=True)})
    return rows.withColumn("novelty", 2.0 * hash_uniform("nov", F.col("object_id"), F.col("epoch"))).drop("r64", "r90", "r95")


OBS_SQL = """obs AS (SELECT *, CASE WHEN flux / flux_err >= 5 THEN 1 ELSE 0 END AS detected_bool FROM (
  SELECT user_id AS object_id, epoch_us(ts)::DOUBLE / 86400000000.0::DOUBLE + 40587.0::DOUBLE AS mjd,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS passband,
    value AS flux, 1.0::DOUBLE + regexp_extract(props, '"k": *(\\d+)', 1)::INT / 10.0::DOUBLE AS flux_err FROM events))"""
META_SQL = """meta AS (SELECT c_custkey AS object_id, (c_acctbal + 1000) / 5500.0::DOUBLE AS hostgal_photoz, 0.05::DOUBLE AS hostgal_photoz_err,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 64 WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 90 WHEN c_mktsegment = 'FURNITURE' THEN 95 ELSE 15 END AS true_target,
  c_nationkey AS libid_cadence FROM customer)"""
POP_SQL = """pop AS (SELECT o_orderkey AS object_id, o_totalprice / 250000.0::DOUBLE AS hostgal_photoz, 0.05::DOUBLE AS hostgal_photoz_err,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 64 WHEN '2' THEN 90 WHEN '3' THEN 90 WHEN '4' THEN 95 ELSE 15 END AS true_target,
  36.0::DOUBLE + 5.0::DOUBLE * (o_totalprice / 250000.0::DOUBLE) AS distmod, (o_custkey % 50) / 500.0::DOUBLE AS mwebv, o_custkey % 97 AS libid_cadence FROM orders)"""


def uniform_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sel_sql(seed: int = 42) -> str:
    return POP_SQL + f""",
sel AS (SELECT *, CASE WHEN {uniform_sql(f"'{seed}:' || object_id")} < p_spec THEN 1 ELSE 0 END AS S FROM (
  SELECT *, 0.1::DOUBLE + (0.8::DOUBLE - 0.1::DOUBLE) / (1.0::DOUBLE + exp((hostgal_photoz - 0.5::DOUBLE) / 0.15::DOUBLE)) AS p_spec FROM pop WHERE true_target IN (64, 90, 95)))"""


SEL_SQL = sel_sql()


def _raw(c: int) -> str:
    text = f"'p{c}:' || object_id || ':' || epoch"
    return f"0.02::DOUBLE + {uniform_sql(text)} + CASE WHEN y = {c} THEN 0.25::DOUBLE + 0.05::DOUBLE * epoch ELSE 0.0::DOUBLE END AS r{c}"


_NOVELTY = uniform_sql("'nov:' || object_id || ':' || epoch")
SCORED_SQL = (
    SEL_SQL
    + f""",
scored AS (SELECT object_id, hostgal_photoz, distmod, mwebv, y, S, epoch, r64 / (r64 + r90 + r95) AS p_64, r90 / (r64 + r90 + r95) AS p_90, r95 / (r64 + r90 + r95) AS p_95, 2.0::DOUBLE * {_NOVELTY} AS novelty FROM (
  SELECT *, {_raw(64)}, {_raw(90)}, {_raw(95)} FROM (SELECT object_id, hostgal_photoz, distmod, mwebv, true_target AS y, S, unnest([0, 2, 7]) AS epoch FROM sel)))"""
)
