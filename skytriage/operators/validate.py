"""Validation: every rule of a table in one grouped pass, all failures raised together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import CLASS_IDS, FORBIDDEN


class SchemaError(ValueError):
    """Rules that a table breaks, with the number of rows that break them."""

    def __init__(self, failures: dict[str, int]):
        self.failures = failures
        super().__init__("; ".join(f"{k}: {n}" for k, n in failures.items()))


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def metadata_rules() -> dict[str, tuple[str, Column]]:
    """name -> (column it needs, condition of a bad row)."""
    n = F.col
    return {
        "object_id null": ("object_id", n("object_id").isNull()),
        "hostgal_photoz not finite": ("hostgal_photoz", ~_finite(n("hostgal_photoz"))),
        "hostgal_photoz negative": ("hostgal_photoz", n("hostgal_photoz") < 0),
        "hostgal_photoz_err negative": ("hostgal_photoz_err", n("hostgal_photoz_err").isNull() | (n("hostgal_photoz_err") < 0)),
        "true_target null": ("true_target", n("true_target").isNull()),
    }


def population_rules(classes: tuple[int, ...] = CLASS_IDS) -> dict[str, tuple[str, Column]]:
    return metadata_rules() | {"true_target outside the study": ("true_target", ~F.col("true_target").isin(*classes))}


def observation_rules() -> dict[str, tuple[str, Column]]:
    n = F.col
    return {
        "object_id null": ("object_id", n("object_id").isNull()),
        "mjd not finite": ("mjd", ~_finite(n("mjd"))),
        "passband not 0 to 5": ("passband", n("passband").isNull() | ~n("passband").between(0, 5)),
        "flux not finite": ("flux", ~_finite(n("flux"))),
        "flux_err not finite": ("flux_err", ~_finite(n("flux_err"))),
        "flux_err negative": ("flux_err", n("flux_err") < 0),
        "detected_bool not 0 or 1": ("detected_bool", n("detected_bool").isNull() | ~n("detected_bool").isin(0, 1)),
    }


def failures(df: DataFrame, rules: dict[str, tuple[str, Column]], unique: str | None = None) -> DataFrame:
    """Rows (rule, n) of all rules whose column is there; n counts bad rows, or rows beyond the first of an id.

    Uniqueness is a grouped count (partial sums before the shuffle), not a distinct over all columns."""
    present = {k: cond for k, (c, cond) in rules.items() if c in df.columns}
    sums = df.agg(*(F.count_if(F.coalesce(cond, F.lit(False))).alias(k) for k, cond in present.items()))
    cells = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in present))
    out = sums.select(F.explode(cells).alias("x")).select("x.rule", "x.n")
    if unique and unique in df.columns:
        again = df.groupBy(unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
        out = out.union(again.select(F.lit(f"{unique} repeated").alias("rule"), "n"))
    return out


def _validate(df: DataFrame, rules: dict[str, tuple[str, Column]], unique: str | None = None) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    bad = {f"{c} missing": 1 for c in dict.fromkeys(c for c, _ in rules.values()) if c not in kinds}
    for c in dict.fromkeys(c for c, _ in rules.values()):
        if c in kinds and not isinstance(kinds[c], NumericType):
            df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS double)"))
    bad |= {r.rule: r.n for r in failures(df, rules, unique).where("n > 0").collect()}
    if bad:
        raise SchemaError(bad)
    return df


def validate_metadata(df: DataFrame) -> DataFrame:
    return _validate(df, metadata_rules(), "object_id")


validate_test_metadata = validate_metadata


def validate_true_population(df: DataFrame) -> DataFrame:
    return _validate(df, population_rules(), "object_id")


def validate_observations(df: DataFrame, strip: bool = True) -> DataFrame:
    if strip:
        df = df.drop(*(c for c in FORBIDDEN if c in df.columns))
    return _validate(df, observation_rules())


def check_finite_photoz(df: DataFrame) -> DataFrame:
    return _validate(df, {k: v for k, v in metadata_rules().items() if k == "hostgal_photoz not finite"})


def check_boundary(df: DataFrame, label: str = "BIASED") -> DataFrame:
    """Training rows come from the biased population only: its label, a population column in any case of letters, S = 1."""
    if label.upper() != "BIASED":
        raise ValueError(f"population {label} must not be trained on")
    bad = F.lit(False)
    if "population" in df.columns:
        bad = bad | F.coalesce(F.upper(F.col("population").cast("string")) != "BIASED", F.lit(True))
    if "S" in df.columns:
        bad = bad | F.coalesce(F.col("S") != 1, F.lit(True))
    if not df.where(bad).limit(1).isEmpty():
        raise ValueError("rows outside the biased population must not be trained on")
    return df


def check_classes(df: DataFrame, column: str, allowed: tuple[int, ...] = CLASS_IDS) -> DataFrame:
    found = {r[0] for r in df.select(column).distinct().limit(100).collect()}
    if found - set(allowed):
        raise ValueError(f"classes {sorted(map(str, found - set(allowed)))} are not the study's")
    return df


def overlap(a: DataFrame, b: DataFrame, key: str = "object_id") -> DataFrame:
    """One row (n_a, n_b, n_both) of distinct keys; disjoint populations have n_both = 0."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
