"""Calibration of class probabilities in columns p_<class>, true class in y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASS_IDS
from ..functions.scalars import tenth_bin
from .quantiles import percentiles, percentiles_of
from .shift import range_of


def long_probabilities(df: DataFrame, keep: list[str] | None = None, classes: tuple[int, ...] = CLASS_IDS, binned: bool = False) -> DataFrame:
    """Rows (keep..., class_id, p, hit), hit 1 where the class is the true one; with its bin, if asked for, and then only
    those that are in one."""
    cells = F.array(*(F.struct(F.lit(c).alias("class_id"), F.col(f"p_{c}").alias("p"), (F.col("y") == c).cast("double").alias("hit")) for c in classes))
    rows = df.select(*(keep or []), F.explode(cells).alias("x")).select(*(keep or []), "x.class_id", "x.p", "x.hit")
    return rows.withColumn("bin", tenth_bin(F.col("p"))).where("bin is not null") if binned else rows


def brier(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over objects of the squared distance of probabilities and truth."""
    gap = sum((F.col(f"p_{c}") - (F.col("y") == c).cast("double")) * (F.col(f"p_{c}") - (F.col("y") == c).cast("double")) for c in CLASS_IDS)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(gap).alias("brier"))


def bins(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by..., class_id, bin, n, mean_pred, mean_obs): ten equal bins of each class's probability."""
    s = long_probabilities(df, list(by), binned=True).groupBy(*by, "class_id", "bin")
    return s.agg(F.count("*").cast("double").alias("n"), F.avg("p").alias("mean_pred"), F.avg("hit").alias("mean_obs"))


def decomposed(b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Reliability, resolution, uncertainty and the binned score of bins, summed over classes."""
    own = Window.partitionBy(*by, "class_id")  # ten rows
    total, hit = F.sum("n").over(own), F.sum(F.col("n") * F.col("mean_obs")).over(own)
    b = b.withColumns({"total": total, "base": hit / total})
    gap, lift = F.col("mean_pred") - F.col("mean_obs"), F.col("mean_obs") - F.col("base")
    w = F.col("n") / F.col("total")
    each = b.groupBy(*by, "class_id").agg(F.sum(w * gap * gap).alias("rel"), F.sum(w * lift * lift).alias("res"), F.max(F.col("base") * (1 - F.col("base"))).alias("unc"), F.sum(w * F.abs(gap)).alias("ece"))
    out = each.groupBy(*by).agg(F.sum("rel").alias("reliability"), F.sum("res").alias("resolution"), F.sum("unc").alias("uncertainty"), F.avg("ece").alias("mean_ece"))
    return out.withColumn("binned_brier", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def murphy(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return decomposed(bins(df, by), by)


def classwise_ece(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    b = bins(df, by)
    total = F.sum("n").over(Window.partitionBy(*by, "class_id"))
    return b.withColumn("w", F.col("n") / total).groupBy(*by, "class_id").agg(F.sum(F.col("w") * F.abs(F.col("mean_pred") - F.col("mean_obs"))).alias("ece"))


def bin_counts(df: DataFrame) -> DataFrame:
    """Counts of all ten bins of each class, empty ones included."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(c, b) for c in CLASS_IDS for b in range(10)], "class_id int, bin int")
    return spine.join(bins(df), ["class_id", "bin"], "left").select("class_id", "bin", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))


def edge_bin(x: Column, edges: Column) -> Column:
    """Bin of x between sorted distinct edges, the last one closed; null outside and where fewer than two edges are."""
    below = F.size(F.filter(edges, lambda e: e <= x))
    return F.when((F.size(edges) >= 2) & (x >= F.get(edges, F.lit(0))) & (x <= F.get(edges, F.size(edges) - 1)), F.least(below, F.size(edges) - 1) - 1)


def adaptive_bins(df: DataFrame, least: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Reliability in at most ten bins of at least about `least` objects, between distinct exact percentiles, by group.

    Percentiles of all groups and classes come from the same two or three scans."""

    def marks(n: int) -> list[float]:
        target = 1 if n < least else max(1, min(10, n // least))
        return [i / target for i in range(target + 1)]

    rows, keys = long_probabilities(df, list(by)), [*by, "class_id"]
    kinds = dict(rows.dtypes)
    found = percentiles(rows, "p", marks, tuple(keys))
    edges = df.sparkSession.createDataFrame([(*k, sorted(set(v))) for k, v in found.items()], ", ".join([*(f"{k} {kinds[k]}" for k in keys), "edges array<double>"]))
    rows = rows.join(F.broadcast(edges), keys).withColumn("bin", edge_bin(F.col("p"), F.col("edges"))).where("bin is not null")  # a row for each class and group
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg("hit").alias("mean_obs"))


def populations(df: DataFrame, flag: str = "S") -> DataFrame:
    """df with a column population: each row once as all's and once as that of the selected or the others."""
    return df.withColumn("population", F.explode(F.array(F.lit("all"), F.when(F.col(flag) == 1, "selected").otherwise("others"))))


def audit_cells(df: DataFrame, kinds: dict[str, tuple[str, int]], by: tuple[str, ...], few: int = 30) -> DataFrame:
    """Rows (by..., kind, stratum, n, brier, reliability, resolution, uncertainty, mean_ece, binned_brier, exploratory) of each
    group as a whole (kind "all", stratum 0) and of its strata: kinds maps a name to a column and the number of parts that its
    exact percentiles in the group cut it into.

    Percentiles of all columns and groups are found together; then one grouped pass with a grouping set for each kind."""
    columns = list(dict.fromkeys(c for c, _ in kinds.values()))
    spark, types = df.sparkSession, dict(df.dtypes)
    shares = sorted({i / n for _, n in kinds.values() for i in range(n + 1)})
    found = percentiles_of(df, columns, shares, by)
    rows = []
    for g in {tuple(k[1:]) for k in found}:
        edges = {name: sorted({v for q, v in zip(shares, found.get((c, *g), []), strict=False) if q in {i / n for i in range(n + 1)}}) for name, (c, n) in kinds.items()}
        rows.append((*g, *(edges[name] for name in kinds)))
    table = spark.createDataFrame(rows, ", ".join([*(f"{b} {types[b]}" for b in by), *(f"_e{i} array<double>" for i in range(len(kinds)))]))
    same = [df[b].eqNullSafe(F.col(f"_g_{b}")) for b in by]
    df = df.join(F.broadcast(table.withColumnsRenamed({b: f"_g_{b}" for b in by})), same, "left")  # a row for each group
    marks = [f"_k{i}" for i in range(len(kinds))]
    df = df.withColumns({m: edge_bin(F.col(c), F.col(f"_e{i}")) for i, (m, (c, _)) in enumerate(zip(marks, kinds.values(), strict=True))})
    long = long_probabilities(df, [*by, *marks]).withColumn("bin", tenth_bin(F.col("p")))
    gap, own = F.col("p") - F.col("hit"), [*by, "class_id", "bin"]
    s = long.groupingSets([own, *([*own, m] for m in marks)], *own, *marks).agg(F.count("*").cast("double").alias("n"), F.avg("p").alias("mean_pred"), F.avg("hit").alias("mean_obs"), F.sum(gap * gap).alias("gap"), *(F.grouping(m).alias(f"_out{m}") for m in marks))
    kind, stratum = F.lit("all"), F.lit(0)
    for name, m in zip(kinds, marks, strict=True):
        kind, stratum = F.when(F.col(f"_out{m}") == 0, name).otherwise(kind), F.when(F.col(f"_out{m}") == 0, F.col(m)).otherwise(stratum)
    s = s.select(*by, kind.alias("kind"), stratum.alias("stratum"), "class_id", "bin", "n", "mean_pred", "mean_obs", "gap").where("stratum is not null")
    return _scores(s, (*by, "kind", "stratum")).withColumn("exploratory", F.col("n") < few)


def strata(df: DataFrame, x: str, parts: int, name: str) -> DataFrame:
    """df with column `name`: its place between exact percentiles of x that cut it into `parts`."""
    edges = sorted(set(percentiles(df, x, [i / parts for i in range(parts + 1)]).get((), [])))
    if len(edges) < 2:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, F.when(F.col(x).between(edges[0], edges[-1]), range_of(F.col(x), edges[1:-1])))


def summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier score beside the decomposition and ECE, from one pass: the squared gaps are summed with the bins."""
    long = long_probabilities(df, list(by)).withColumn("bin", tenth_bin(F.col("p")))
    gap = F.col("p") - F.col("hit")
    s = long.groupBy(*by, "class_id", "bin").agg(F.count("*").cast("double").alias("n"), F.avg("p").alias("mean_pred"), F.avg("hit").alias("mean_obs"), F.sum(gap * gap).alias("gap"))
    return _scores(s, by)


def _scores(s: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same from cells (by..., class_id, bin, n, mean_pred, mean_obs, gap)."""
    n = F.sum(F.when(F.col("class_id") == CLASS_IDS[0], F.col("n")))
    score = s.groupBy(*by).agg(n.cast("long").alias("n"), (F.sum("gap") / n).alias("brier"))
    parts = decomposed(s.where("bin is not null").drop("gap"), by)
    return score.join(parts, list(by), "left") if by else score.crossJoin(parts)  # few rows; one row


def stratified(df: DataFrame, stratum: str, few: int = 30) -> DataFrame:
    """Brier, decomposition and ECE of each stratum; strata of fewer than `few` objects are marked exploratory."""
    return summary(df.where(F.col(stratum).isNotNull()), (stratum,)).withColumn("exploratory", F.col("n") < few)


def deltas(raw: DataFrame, new: DataFrame) -> DataFrame:
    """Absolute and per cent improvement of the score and its reliability from raw to new probabilities."""
    of = lambda df, x: summary(df).select(F.col("brier").alias(f"brier_{x}"), F.col("reliability").alias(f"rel_{x}"), F.col("mean_ece").alias(f"ece_{x}"))
    out = of(raw, "raw").crossJoin(of(new, "new"))  # one row each
    for k in ("brier", "rel", "ece"):
        out = out.withColumn(f"{k}_gain", F.col(f"{k}_raw") - F.col(f"{k}_new")).withColumn(f"{k}_gain_pct", 100.0 * F.try_divide(F.col(f"{k}_raw") - F.col(f"{k}_new"), F.col(f"{k}_raw")))
    return out
