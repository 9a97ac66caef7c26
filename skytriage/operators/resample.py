"""Bootstraps by hashed Poisson weights: each replicate counts each object so many times.

A weight depends on (seed, replicate, object) alone. Sums by replicate are folded where the rows lie: a task draws the
weights of a batch as a matrix, objects by replicates, and keeps the weighted sums of each cell, so that rows are not
copied and a task sends a row for each replicate and cell. What needs whole samples (medians, distances) takes a bounded
subsample of each replicate instead. The total weight varies between replicates, so means are taken over weights."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DecisionConfig
from ..functions.scalars import MIX_ALL, MIX_ONE, MIX_STEP, MIX_TWO, draw_keys, mixed, poisson, poisson_steps
from ..sources.shared import kept, spread
from . import shift as shift_
from .calibration import decomposed, long_probabilities
from .decision import regret_of_sums
from .shift import quantile_cuts, range_of

#: Draws that a task makes at a time.
DRAWS = 1 << 21
#: Objects in a subsample of the shift's bootstrap, and its replicates that distances are taken of.
SUBSAMPLE, DISTANCES = 5000, 100


def replicates(df: DataFrame, n: int, seed: int = 42, key: str = "object_id", rate: float = 1.0) -> DataFrame:
    """df once for each replicate, with its weight; rows of weight 0 are left out."""
    one, two = draw_keys(seed)
    k = F.col(key).cast("long")
    df = mixed(df.withColumn("_a", k.bitwiseAND(F.lit(MIX_ALL)).bitwiseXOR(F.lit(one))), "_a")
    df = mixed(df.withColumn("_b", F.shiftright(k, 32).bitwiseAND(F.lit(MIX_ALL)).bitwiseXOR(F.col("_a")).bitwiseXOR(F.lit(two))), "_b")
    df = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    df = mixed(df.withColumn("_h", (F.col("_a") + F.col("replicate") * F.lit(MIX_STEP)).bitwiseAND(F.lit(MIX_ALL))), "_h")
    df = mixed(df.withColumn("_h", F.col("_h").bitwiseXOR(F.col("_b"))), "_h")
    return df.withColumn("weight", poisson(F.col("_h") / F.lit(4294967296.0), rate)).drop("_a", "_b", "_h").where("weight > 0")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint32(16)) * np.uint32(MIX_ONE)
    x = (x ^ x >> np.uint32(15)) * np.uint32(MIX_TWO)
    return x ^ x >> np.uint32(15)


def weights(keys: np.ndarray, n: int, seed: int, rate: float = 1.0) -> np.ndarray:
    """The weights of replicates(), as a matrix of replicates by objects."""
    one, two = draw_keys(seed)
    k = keys.astype(np.int64).view(np.uint64)
    a = _mix((k & np.uint64(MIX_ALL)).astype(np.uint32) ^ np.uint32(one))
    b = _mix((k >> np.uint64(32)).astype(np.uint32) ^ a ^ np.uint32(two))
    step = np.arange(n, dtype=np.uint32) * np.uint32(MIX_STEP)
    h = _mix(_mix(a + step[:, None]) ^ b)
    out = np.zeros(h.shape, np.uint8)
    for c in poisson_steps(rate):
        least = math.ceil(c * 2**32)
        if least <= MIX_ALL:
            out += h >= np.uint32(least)
    return out


def drawn(df: DataFrame, n: int, x: str, seed: int = 42, key: str = "object_id", rate: float = 1.0) -> DataFrame:
    """Rows (replicate, x, weight) of the draws that are not 0: what replicates() gives, a column of it, for low rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(keys), max(1, DRAWS // n)):
                w = weights(keys[at : at + max(1, DRAWS // n)], n, seed, rate)
                replicate, row = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(replicate.astype(np.int32)), pa.array(values[at + row]), pa.array(w[replicate, row].astype(np.int64))], ["replicate", x, "weight"])

    rows = df.where(F.col(key).isNotNull() & F.col(x).isNotNull()).select(F.col(key).cast("long"), F.col(x).cast("double"))
    return spread(rows).mapInArrow(run, f"replicate int, {x} double, weight long")


def folded(df: DataFrame, n: int, cells: list[str], values: list[str], seed: int = 42, key: str = "object_id", rate: float = 1.0) -> DataFrame:
    """Rows (replicate, cells..., weight, values...): sums of weights, and of weighted values, nulls being 0.

    Cells are few (classes, bins); a task holds `n` numbers for each cell and value."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            matrix = np.stack([np.ones(batch.num_rows), *(pc.fill_null(batch.column(1 + len(cells) + i), 0.0).to_numpy(zero_copy_only=False) for i in range(len(values)))], 1)
            names = list(zip(*(batch.column(1 + i).to_pylist() for i in range(len(cells))), strict=True)) if cells else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            which = np.array([number.setdefault(x, len(number)) for x in names])
            order = np.argsort(which, kind="stable")
            for at in range(0, len(order), max(1, DRAWS // n)):
                own = order[at : at + max(1, DRAWS // n)]
                w, cell = weights(keys[own], n, seed, rate).astype(np.float64), which[own]
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                for x, y in zip(first, [*first[1:], len(cell)], strict=True):
                    part = (w[:, x:y] @ matrix[own[x:y]]).T
                    name = names[own[x]]
                    held[name] = held[name] + part if name in held else part
        for name, sums in held.items():
            columns = [pa.array([v] * n, t) for v, t in zip(name, types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *columns, *map(pa.array, sums)], ["replicate", *cells, "weight", *values])

    picked = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), *cells, *(F.col(v).cast("double").alias(v) for v in values))
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [to_arrow_schema(picked.schema).field(c).type for c in cells]
    schema = ", ".join(["replicate int", *(f"{c} {kinds[c]}" for c in cells), "weight double", *(f"{v} double" for v in values)])
    return spread(picked).mapInArrow(run, schema).groupBy("replicate", *cells).agg(*(F.sum(c).alias(c) for c in ("weight", *values)))


def weight_counts(df: DataFrame, n: int, seed: int = 42, key: str = "object_id") -> DataFrame:
    """Rows (replicate, weight, n): objects of each weight that is not 0. Counted where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, 256), np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at in range(0, len(keys), max(1, DRAWS // n)):
                w = weights(keys[at : at + max(1, DRAWS // n)], n, seed)
                for v in range(1, int(w.max(initial=0)) + 1):
                    total[:, v] += (w == v).sum(axis=1)
        replicate, weight = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(replicate.astype(np.int32)), pa.array(weight.astype(np.int32)), pa.array(total[replicate, weight])], ["replicate", "weight", "n"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long"))
    return spread(rows).mapInArrow(run, "replicate int, weight int, n long").groupBy("replicate", "weight").agg(F.sum("n").alias("n"))


def interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic over replicates, which are few."""
    a = (1 - level) / 2
    return df.where(F.col(value).isNotNull()).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.array(F.lit(a), F.lit(1 - a))).alias("_q")).select("n", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def mean(df: DataFrame, value: str, n: int, seed: int = 42) -> DataFrame:
    return folded(df, n, [], [value], seed).select("replicate", (F.col(value) / F.col("weight")).alias(value))


def calibration(df: DataFrame, n: int, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Decomposition of each replicate (and group)."""
    long = long_probabilities(df, ["object_id", *by], binned=True)
    s = folded(long, n, [*by, "class_id", "bin"], ["p", "hit"], seed).where("weight > 0")
    b = s.select("replicate", *by, "class_id", "bin", F.col("weight").alias("n"), (F.col("p") / F.col("weight")).alias("mean_pred"), (F.col("hit") / F.col("weight")).alias("mean_obs"))
    return decomposed(b, ("replicate", *by))


def paired(df: DataFrame, arm: str, raw, new, gap: str, n: int, seed: int = 42) -> DataFrame:
    """What the new arm's rows gain on the raw one's in Brier score (the mean of `gap`), reliability and ECE, under the
    same weights."""
    both = df.where(F.col(arm).isin(raw, new))
    score = folded(both, n, [arm], [gap], seed).select("replicate", arm, (F.col(gap) / F.col("weight")).alias("brier"))
    rows = score.join(calibration(both, n, seed, (arm,)), ["replicate", arm])
    of = lambda c, v: F.max(F.when(F.col(arm) == v, F.col(c)))
    return rows.groupBy("replicate").agg(*((of(c, raw) - of(c, new)).alias(f"{k}_gain") for k, c in (("brier", "brier"), ("reliability", "reliability"), ("ece", "mean_ece"))))


def shift(df: DataFrame, x: str, flag: str, n: int, seed: int = 42) -> DataFrame:
    """Of each replicate: difference of means and medians of the flagged rows and all, and Cohen's d; of the first
    DISTANCES also Wasserstein distance, divergence in 100 bins and Kolmogorov-Smirnov statistic.

    All rows and the flagged ones are drawn apart from each other, SUBSAMPLE objects of each at most (in the mean)."""
    df = df.where(F.col(x).isNotNull()).select("object_id", F.col(x).cast("double").alias("x"), F.col(flag).cast("int").alias("flag"))
    n1, n2 = df.agg(F.count("*"), F.count_if(F.col("flag") == 1)).first()
    part = lambda rows, seed, size, k: drawn(rows, n, "x", seed, rate=min(1.0, SUBSAMPLE / max(size, 1))).withColumn("part", F.lit(k))
    rows = part(df, seed, n1, 0).unionByName(part(df.where("flag = 1"), seed + 1, n2, 1))
    names = ("mean_shift", "median_shift", "cohens_d", "wasserstein", "js", "ks")

    def run(table: pa.Table) -> pa.Table:
        replicate, flag = table.column("replicate")[0].as_py(), table.column("part").to_numpy()
        values = np.repeat(table.column("x").to_numpy(), table.column("weight").to_numpy())
        flag = np.repeat(flag, table.column("weight").to_numpy())
        found = _distances(np.sort(values[flag == 0]), np.sort(values[flag == 1]), replicate < DISTANCES)
        return pa.table({"replicate": pa.array([replicate], pa.int32()), **{k: pa.array([v], pa.float64()) for k, v in zip(names, found, strict=True)}})

    # a replicate's draws are some 2 * SUBSAMPLE values, whatever the table
    return rows.groupBy("replicate").applyInArrow(run, "replicate int, " + ", ".join(f"{c} double" for c in names))


def _distances(a: np.ndarray, b: np.ndarray, whole: bool) -> list:
    """Shift of mean and median and Cohen's d from sorted a to sorted b and, if asked for, distance, divergence and KS."""
    if not len(a) or not len(b):
        return [None] * 6
    n, m = len(a), len(b)
    shift = float(b.mean() - a.mean())
    pooled = math.sqrt((((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (n + m - 2)) if n + m > 2 else 0.0
    out = [shift, float(np.median(b) - np.median(a)), shift / pooled if pooled > 0 else 0.0]
    if not whole:
        return [*out, None, None, None]
    x = np.unique(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(a, x, side="right") / n - np.searchsorted(b, x, side="right") / m)
    low, wide = x[0], x[-1] - x[0]
    bins = [np.bincount(np.minimum(np.floor((v - low) / wide * 100), 99).astype(int) if wide else np.zeros(len(v), int), minlength=100) / len(v) for v in (a, b)]
    middle = (bins[0] + bins[1]) / 2
    js = sum(float((p[p > 0] * np.log2(p[p > 0] / middle[p > 0])).sum()) for p in bins) / 2
    return [*out, float((gap[:-1] * np.diff(x)).sum()), js, float(gap.max())]


def ranking(df: DataFrame, score: str, n: int, seed: int = 42, hit: str = "hit") -> DataFrame:
    """AUC and average precision by replicate, tie-averaged and step-wise; replicates of one class have none.

    Rows go to ranges of the score. Folded totals of the ranges above come first, then each range's rows from the top:
    only the rows themselves are shuffled, once, whatever the number of replicates. A score that as many rows share as a
    range may hold is a range of its own, whose totals are all that is needed of it: its rows stay where they lie."""
    rows = df.select(F.col("object_id").cast("long").alias("object_id"), F.col(score).cast("double").alias("x"), F.col(hit).cast("double").alias("hit"))
    rows = kept(rows.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("object_id").isNotNull()), "ranking")
    total = rows.count()
    most = max(shift_.RANGE_VALUES, total // shift_.MOST)
    shared = [r.x for r in rows.groupBy("x").count().where(F.col("count") >= most).select("x").collect()]  # MOST scores at most
    cuts = sorted({*quantile_cuts(rows, "x", total), *shared, *(math.nextafter(x, math.inf) for x in shared)})
    alone = [bisect_right(cuts, x) for x in shared]
    rows = rows.withColumn("_range", range_of(F.col("x"), cuts))
    totals = kept(folded(rows, n, ["_range"], ["hit"], seed), "ranking-totals")  # a row for each range and replicate
    above = Window.partitionBy("replicate").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0.0))
    base = totals.select(F.col("replicate").cast("long").alias("object_id"), before("hit").alias("x"), (before("weight") - before("hit")).alias("hit"), "_range", F.lit(0).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins, ap = np.zeros(n), np.zeros(n)
        tp, fp = np.zeros(n), np.zeros(n)
        held: list = [None, np.zeros(n), np.zeros(n)]  # the last score met, which may go on
        now = None

        def close() -> None:
            nonlocal tp, fp, wins, ap
            if held[0] is not None:
                tp, fp = tp + held[1], fp + held[2]
                wins = wins + held[2] * (tp - held[1] / 2)
                ap = ap + held[1] * np.divide(tp, tp + fp, out=np.zeros(n), where=tp + fp > 0)
            held[0] = None

        for batch in batches:
            ranges, kind, key, x, hits = (batch.column(c).to_numpy() for c in ("_range", "kind", "object_id", "x", "hit"))
            for at in np.flatnonzero((np.diff(ranges, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)) if batch.num_rows else ():
                to = at + int(np.argmax(np.append((ranges[at:] != ranges[at]) | (kind[at:] != kind[at]), True)))
                if ranges[at] != now:
                    close()
                    now, tp, fp = ranges[at], np.zeros(n), np.zeros(n)
                if not kind[at]:
                    tp[key[at:to]], fp[key[at:to]] = x[at:to], hits[at:to]
                    continue
                for a in range(at, to, max(1, DRAWS // n)):
                    b = min(to, a + max(1, DRAWS // n))
                    w = weights(key[a:b], n, seed).astype(np.float64)
                    first = np.flatnonzero(np.diff(x[a:b], prepend=np.nan) != 0)
                    up = w * hits[a:b]
                    down = w - up
                    if len(first) < b - a:  # equal scores count as one
                        up, down = (np.add.reduceat(v, first, axis=1) for v in (up, down))
                    if held[0] == x[a]:
                        up[:, 0] += held[1]
                        down[:, 0] += held[2]
                        held[0] = None
                    close()
                    if len(first) > 1:
                        t, f = (np.cumsum(v[:, :-1], axis=1) + c[:, None] for v, c in ((up, tp), (down, fp)))
                        wins = wins + np.einsum("ij,ij->i", down[:, :-1], t) - np.einsum("ij,ij->i", down[:, :-1], up[:, :-1]) / 2
                        some = np.flatnonzero(up[:, :-1].any(axis=0))
                        t1, all_ = t[:, some], t[:, some] + f[:, some]
                        ap = ap + np.einsum("ij,ij->i", up[:, some], np.divide(t1, all_, out=np.zeros_like(t1), where=all_ > 0))
                        tp, fp = t[:, -1].copy(), f[:, -1].copy()
                    held[:] = [x[b - 1], up[:, -1].copy(), down[:, -1].copy()]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(wins), pa.array(ap)], ["replicate", "wins", "ap"])

    own = F.col("_range").isin(alone)
    lined = rows.select("object_id", "x", "hit", "_range", F.lit(1).alias("kind")).unionByName(base).where(~own)
    lined = lined.repartitionById(len(cuts) + 1, F.col("_range")).sortWithinPartitions("_range", "kind", F.desc("x"))  # a task for each range
    sums = lined.mapInArrow(run, "replicate int, wins double, ap double")
    up, down = F.col("hit"), F.col("weight") - F.col("hit")
    block = totals.withColumns({"tp": before("hit"), "fp": before("weight") - before("hit")}).where(own)
    block = block.select("replicate", (down * (F.col("tp") + up / 2)).alias("wins"), F.coalesce(up * F.try_divide(F.col("tp") + up, F.col("tp") + up + F.col("fp") + down), F.lit(0.0)).alias("ap"))
    sums = sums.unionByName(block).groupBy("replicate").agg(F.sum("wins").alias("wins"), F.sum("ap").alias("ap"))
    whole = totals.groupBy("replicate").agg(F.sum("hit").alias("n_pos"), F.sum(F.col("weight") - F.col("hit")).alias("n_neg"))
    some = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.join(whole, "replicate").select("replicate", F.when(some, F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"), F.when(some, F.col("ap") / F.col("n_pos")).alias("avg_precision"))


def decisions(rows: DataFrame, k: int, n: int, seed: int = 42, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """Regret by replicate with actions held fixed."""
    s = folded(rows, n, ["triggered", "is_target"], ["utility"], seed)
    w, t, g = F.col("weight"), F.col("triggered"), F.col("is_target")
    of = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    sums = s.groupBy("replicate").agg(
        F.sum("utility").alias("u_policy"), of(g).alias("n_targets"), of(~g).alias("n_others"), of(t & g).alias("hits"), of(t & ~g).alias("false_triggers"), (of(g) * F.lit(config.u_fn) + of(~g) * F.lit(config.u_tn)).alias("u_no_trigger"),
    )
    return regret_of_sums(sums, k, config)


def retention(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Retention of each class and the shift of its share, by replicate."""
    s = folded(df, n, ["true_target"], ["S"], seed).where("weight > 0")
    own = Window.partitionBy("replicate")  # a row for each class
    return s.select("replicate", "true_target", (F.col("S") / F.col("weight")).alias("retention"), (F.try_divide("S", F.sum("S").over(own)) - F.col("weight") / F.sum("weight").over(own)).alias("share_shift"))
