"""Distances between two samples, exact and without a window over a single partition.

Values are counted first, so that ties are one row, and written once. Cumulative counts come from two levels: totals of
ranges between approximate quantiles, and a window inside each range. There are as many ranges as the values need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Distinct values in a range at about, fewest and most ranges.
RANGE_VALUES, FEWEST, MOST = 100_000, 8, 1024


def range_of(x: Column, cuts: list[float], low: int = 0) -> Column:
    """Number of cuts at or below x, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x >= F.lit(cuts[mid]), range_of(x, cuts[mid + 1 :], low + mid + 1)).otherwise(range_of(x, cuts[:mid], low))


def quantile_cuts(df: DataFrame, x: str, n: int) -> list[float]:
    """Cuts of x into ranges for n rows, near the quantiles; the exact counts come later, so they need not be exact."""
    ranges = max(FEWEST, min(MOST, -(-n // RANGE_VALUES)))
    marks = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    return sorted({float(v) for v in df.agg(F.percentile_approx(F.col(x).cast("double"), marks, max(1000, 10 * ranges))).first()[0] or ()})


def _grouped(df: DataFrame, x: str, sums: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    """A row per distinct value of x (and of `by`) with the sums of its rows and its range. Nulls and NaN are left out."""
    df = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    each = kept(df.groupBy(*by, x).agg(*(F.sum(c).alias(k) for k, c in sums.items())), "grouped-values")
    return each.withColumn("_range", range_of(F.col(x).cast("double"), quantile_cuts(each, x, each.count())))


def cumulative(df: DataFrame, x: str, sums: dict[str, Column], by: tuple[str, ...] = (), descending: bool = False, totals: bool = False) -> DataFrame:
    """A row per distinct value of x (and of `by`) with the sums of its rows, of all rows up to it as cum_<name> and, if
    asked for, of all rows as all_<name>. Nulls and NaN are left out."""
    each = _grouped(df, x, sums, by)
    part = each.groupBy(*by, "_range").agg(*(F.sum(k).alias(f"_t_{k}") for k in sums))  # a row for each range and group
    whole = Window.partitionBy(*by)
    before = whole.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    base = part.select(*by, "_range", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums), *(F.sum(f"_t_{k}").over(whole).alias(f"all_{k}") for k in sums))
    w = Window.partitionBy(*by, "_range").orderBy(F.desc(x) if descending else F.asc(x)).rowsBetween(Window.unboundedPreceding, 0)
    out = each.join(F.broadcast(base), [*by, "_range"])  # at most MOST rows for each group
    cum = [(F.col(f"_base_{k}") + F.sum(k).over(w)).alias(f"cum_{k}") for k in sums]
    return out.select(*by, x, "_range", *sums, *cum, *(f"all_{k}" for k in sums if totals))


def _both(df: DataFrame, x: str, flag: str, by: tuple[str, ...]) -> DataFrame:
    """Distribution functions of the whole sample (t) and of its flagged part (b) at each value."""
    one = F.when(F.col(flag) == 1, 1).otherwise(0)
    rows = cumulative(df, x, {"t": F.lit(1), "b": one}, by, totals=True).withColumnsRenamed({"all_t": "n_t", "all_b": "n_b"})
    return rows.withColumns({"f_t": F.col("cum_t") / F.col("n_t"), "f_b": F.try_divide("cum_b", "n_b")})


def ks(df: DataFrame, x: str, flag: str = "S", by: tuple[str, ...] = ()) -> DataFrame:
    """Kolmogorov-Smirnov statistic of all rows against the flagged ones."""
    return _both(df, x, flag, by).groupBy(*by).agg(F.max("n_t").alias("n_true"), F.max("n_b").alias("n_biased"), F.max(F.abs(F.col("f_t") - F.col("f_b"))).alias("ks"))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided p-value of a statistic d of samples of n and m: the alternating series of exponentials."""
    en = F.sqrt(n * m / (n + m))
    t = (en + 0.12 + 0.11 / en) * d
    tail = sum(F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * t * t) for k in range(1, terms + 1))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def wasserstein(df: DataFrame, x: str, flag: str = "S", by: tuple[str, ...] = ()) -> DataFrame:
    """Area between the two distribution functions, by group. The step to the next value is a window inside a range, whose
    last value takes the next range's first from a table of a row for each range (and group)."""
    rows = _both(df, x, flag, by)
    ahead = rows.groupBy(*by, "_range").agg(F.min(x).alias("_first"))
    ahead = ahead.select(*by, "_range", F.lead("_first").over(Window.partitionBy(*by).orderBy("_range")).alias("_ahead"))
    rows = rows.join(F.broadcast(ahead), [*by, "_range"])
    after = F.coalesce(F.lead(x).over(Window.partitionBy(*by, "_range").orderBy(x)), F.col("_ahead"))
    return rows.withColumn("step", after - F.col(x)).groupBy(*by).agg(F.sum(F.abs(F.col("f_t") - F.col("f_b")) * F.coalesce("step", F.lit(0.0))).alias("wasserstein"))


def js_divergence(df: DataFrame, x: str, flag: str = "S", bins: int = 100) -> DataFrame:
    """Jensen-Shannon divergence in bits over equal bins of the joint range, the last one closed; 0 if all values are one."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        return df.sparkSession.createDataFrame([(0.0,)], "js double")
    b = F.least(F.floor((F.col(x) - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1))
    c = df.where(F.col(x).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("t"), F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).alias("b"))
    total = c.agg(F.sum("t").alias("nt"), F.sum("b").alias("nb"))
    p, q = F.col("t") / F.col("nt"), F.col("b") / F.col("nb")
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return c.crossJoin(F.broadcast(total)).agg((F.sum(part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2.0).alias("js"))


def cohens_d(df: DataFrame, x: str, flag: str = "S", by: tuple[str, ...] = ()) -> DataFrame:
    """(mean of the flagged - mean of all) over the pooled standard deviation, by group; 0 if that is 0."""
    own = F.when(F.col(flag) == 1, F.col(x))
    s = df.groupBy(*by).agg(F.count(x).alias("n1"), F.count(own).alias("n2"), F.var_samp(x).alias("v1"), F.var_samp(own).alias("v2"), F.avg(x).alias("m1"), F.avg(own).alias("m2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return s.select(*by, "m1", "m2", F.when(pooled > 0, (F.col("m2") - F.col("m1")) / pooled).otherwise(0.0).alias("cohens_d")).withColumnsRenamed({"m1": "mean_true", "m2": "mean_biased"})


def long_features(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names))).alias("f")).select(*keep, "f.feature", "f.x")


def ranked_ks(df: DataFrame, names: list[str], flag: str = "S") -> DataFrame:
    """KS statistic of several features, strongest first, from one scan."""
    each = ks(long_features(df, names, [flag]), "x", flag, by=("feature",))
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ks"), "feature")))  # a row for each feature
