"""Capacity-limited triggering: sequential top-K, and the gains and losses of what was triggered.

An arm is a frame of candidates (object_id, epoch, y, score). All rankings are total orders: score, then object_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TARGET_CLASS, DecisionConfig
from ..functions.binomial import clopper_pearson
from ..functions.scalars import fused_score, object_utility


def top_k(df: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k rows of best score that reach the threshold: a bounded heap per task, never a global sort."""
    return df.where(F.col("score") >= threshold).orderBy(F.desc("score"), "object_id").limit(max(k, 0))


def sequential(df: DataFrame, k: int, threshold: float, deadline: float) -> DataFrame:
    """Rows (object_id, trigger_epoch, score) over the epochs up to the deadline; what was triggered before is not eligible.

    Any epoch's k best of those not triggered before are among its (number of epochs) * k best of all, so one pass takes
    these from every epoch, a bounded number, and the rest is a walk over them."""
    spark = df.sparkSession
    rows = df.where((F.col("epoch") <= deadline) & (F.col("score") >= threshold))
    epochs = sorted(r[0] for r in df.where(F.col("epoch") <= deadline).select("epoch").distinct().collect())  # a handful
    most = max(k, 0) * len(epochs)
    best: dict = {e: [] for e in epochs}
    if most:
        w = Window.partitionBy("epoch").orderBy(F.desc("score"), "object_id")
        for r in rows.select("epoch", "object_id", "score").withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).orderBy("epoch", "_place").collect():
            best[r.epoch].append((r.object_id, r.score))
    out, gone = [], set()
    for e in epochs:
        got, met = [], set()
        for i, s in best[e]:
            if i not in gone and len(got) < k:
                got.append((i, float(e), s))
                met.add(i)
        out += got
        gone |= met
    return spark.createDataFrame(out, "object_id long, trigger_epoch double, score double")


def quota_threshold(train: DataFrame, k: int, n_eval: int) -> float:
    """The train score whose rank is k's share of the evaluated objects, half to even, the largest over epochs."""
    quota = {r.epoch: max(1, round(r.n * k / n_eval)) for r in train.groupBy("epoch").agg(F.count("*").alias("n")).collect()}  # a handful
    rank = F.lit(0)
    for e, q in quota.items():
        rank = F.when(F.col("epoch") == e, q).otherwise(rank)
    w = Window.partitionBy("epoch").orderBy(F.desc("score"), "object_id")
    return train.select("epoch", "object_id", "score").withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= max(quota.values())).where(F.col("_place") == rank).agg(F.max("score")).first()[0]


def outcomes(objects: DataFrame, triggered: DataFrame, target: int = TARGET_CLASS, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """A row per object (object_id, y): triggered or not, target or not, its utility."""
    marks = triggered.select("object_id", F.col("trigger_epoch"))
    rows = objects.select("object_id", "y").join(marks, "object_id", "left").withColumns({"triggered": F.col("trigger_epoch").isNotNull(), "is_target": F.col("y") == target})
    return rows.withColumn("utility", object_utility(F.col("triggered"), F.col("is_target"), config))


def oracle_utility(n_targets: Column, k: int, config: DecisionConfig) -> Column:
    """The first min(k, targets) targets are triggered, never another object; targets left over are missed."""
    hit = F.least(n_targets, F.lit(k))
    return hit * F.lit(config.u_tp) + (n_targets - hit) * F.lit(config.u_fn)


def regret(rows: DataFrame, k: int, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """Utility, the oracle's, that of no trigger, regret and its share of the oracle's, and rates, in one pass."""
    t, g = F.col("triggered").cast("double"), F.col("is_target").cast("double")
    s = rows.agg(
        F.sum("utility").alias("u_policy"), F.sum(g).alias("n_targets"), F.sum(1 - g).alias("n_others"), F.sum(t * g).alias("hits"), F.sum(t * (1 - g)).alias("false_triggers"),
        F.sum(g * F.lit(config.u_fn) + (1 - g) * F.lit(config.u_tn)).alias("u_no_trigger"),
    )
    return regret_of_sums(s, k, config)


def regret_of_sums(s: DataFrame, k: int, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """The same from sums (u_policy, n_targets, n_others, hits, false_triggers, u_no_trigger)."""
    s = s.withColumn("u_oracle", oracle_utility(F.col("n_targets"), k, config))
    s = s.withColumn("regret", F.col("u_oracle") - F.col("u_policy"))
    s = s.withColumn("normalized_regret", F.col("regret") / F.greatest(F.lit(1.0), "u_oracle"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = F.col("hits") + F.col("false_triggers")
    return s.withColumns({"mhver": share(F.col("n_targets") - F.col("hits"), F.col("n_targets")), "false_trigger_rate": share(F.col("false_triggers"), F.col("n_others")), "target_rate": share(F.col("hits"), F.col("n_targets")), "purity": share(F.col("hits"), n)})


def trigger_intervals(hits: int, targets: int, false_triggers: int, others: int) -> list[tuple[str, int, int, float, float]]:
    """Exact binomial intervals of the target and the false trigger rate."""
    return [("target_rate", hits, targets, *clopper_pearson(hits, targets)), ("false_trigger_rate", false_triggers, others, *clopper_pearson(false_triggers, others))]


def jackknife(rows: DataFrame, k: int, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """Range of regret, its share and the miss rate when any one target is left out: totals less one row, no second scan."""
    total = regret(rows, k, config).select("u_policy", "n_targets", "hits")
    each = rows.where("is_target").groupBy("triggered", "utility").agg(F.count("*").alias("times")).crossJoin(F.broadcast(total))  # one row
    m = F.col("n_targets") - 1
    u = oracle_utility(m, k, config)
    each = each.withColumn("u", u).withColumn("r", F.col("u") - (F.col("u_policy") - F.col("utility")))
    each = each.withColumns({"nr": F.col("r") / F.greatest(F.lit(1.0), "u"), "miss": F.coalesce(F.try_divide(m - (F.col("hits") - F.col("triggered").cast("int")), m), F.lit(0.0))})
    return each.agg(F.sum("times").alias("n_left_out"), *(f(c).alias(f"{c}_{n}") for c in ("r", "nr", "miss") for f, n in ((F.min, "min"), (F.max, "max")))).withColumnsRenamed({"r_min": "regret_min", "r_max": "regret_max", "nr_min": "normalized_min", "nr_max": "normalized_max", "miss_min": "mhver_min", "miss_max": "mhver_max"})


def policy_grid(df: DataFrame, scale: float, capacities: tuple[int, ...], weights: tuple[float, ...], gains: tuple[float, ...], threshold: float, deadline: float, target: int = TARGET_CLASS, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """Rows (u_tp, k, weight, u_policy, u_oracle, hits) of the sequential policy at every capacity, novelty weight and gain.

    The best of a smaller capacity are among those of the largest, so one pass with a rank limit for each weight and epoch
    (the largest capacity, once for each epoch) serves all of them; a walk over these rows gives each cell, and gains follow
    from its counts. Two jobs: one for the totals and epochs, one for the ranks."""
    rows = df.where(F.col("epoch") <= deadline)
    objects = rows.groupBy("object_id").agg(F.first("y").alias("y"), F.collect_set("epoch").alias("e"))  # a few epochs each
    total = objects.agg(F.count_if(F.col("y") == target).alias("t"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("e"))).alias("e")).first()
    epochs, most = sorted(total.e), max(capacities) * len(total.e)
    each = F.explode(F.array(*(F.lit(float(w)) for w in weights))).alias("weight")
    p = rows.select("object_id", "epoch", (F.col("y") == target).alias("hit"), f"p_{target}", "novelty", each)
    score = F.lit(None).cast("double")
    for w in weights:
        score = F.when(F.col("weight") == float(w), fused_score(F.col(f"p_{target}"), F.col("novelty"), scale, w)).otherwise(score)
    p = p.withColumn("score", score).where(F.col("score") >= threshold)
    line = Window.partitionBy("weight", "epoch").orderBy(F.desc("score"), "object_id")
    best: dict = {}
    for r in p.withColumn("_place", F.row_number().over(line)).where(F.col("_place") <= most).select("weight", "epoch", "_place", "object_id", "hit").collect():
        best.setdefault((r.weight, r.epoch), []).append((r["_place"], r.object_id, r.hit))
    out = []
    for w in weights:
        lists = [sorted(best.get((float(w), e), [])) for e in epochs]
        for k in capacities:
            gone: set = set()
            hits = false = 0
            for own in lists:
                met = [(i, hit) for _, i, hit in own if i not in gone][: max(k, 0)]
                gone.update(i for i, _ in met)
                hits += sum(hit for _, hit in met)
                false += sum(not hit for _, hit in met)
            for u in gains:
                policy = hits * u + false * config.u_fp + (total.t - hits) * config.u_fn + (total.n - total.t - false) * config.u_tn
                oracle = min(total.t, k) * u + (total.t - min(total.t, k)) * config.u_fn
                out.append((float(u), int(k), float(w), float(policy), float(oracle), float(hits)))
    return df.sparkSession.createDataFrame(out, "u_tp double, k int, weight double, u_policy double, u_oracle double, hits double")


@dataclass(frozen=True)
class Arm:
    name: str
    weight: float
    threshold: float | None  # None: the quota's


#: The naive arm follows a quota threshold, the others the configured one; the ablation leaves novelty out.
ARMS = (Arm("naive", 0.0, None), Arm("fused", 0.05, 0.001), Arm("ablation", 0.0, 0.001))


def with_score(df: DataFrame, weight: float, scale: float, target: int = TARGET_CLASS) -> DataFrame:
    return df.withColumn("score", fused_score(F.col(f"p_{target}"), F.col("novelty"), scale, weight))


def run_arm(arm: Arm, evaluated: DataFrame, train: DataFrame, scale: float, k: int, deadline: float, target: int = TARGET_CLASS) -> DataFrame:
    """What the arm triggers. The quota of the naive arm is taken over the evaluated objects of one epoch."""
    cut = arm.threshold
    if cut is None:
        n_eval = evaluated.select("object_id").distinct().count()
        cut = quota_threshold(with_score(train, arm.weight, scale, target), k, n_eval)
    return sequential(with_score(evaluated, arm.weight, scale, target), k, cut, deadline)


def compare_arms(arms: tuple[Arm, ...], evaluated: DataFrame, train: DataFrame, scale: float, k: int, deadline: float, target: int = TARGET_CLASS, config: DecisionConfig = DecisionConfig()) -> DataFrame:  # noqa: B008
    """A row of regret() per arm."""
    objects = evaluated.groupBy("object_id").agg(F.first("y").alias("y"))
    out = None
    for arm in arms:
        row = regret(outcomes(objects, run_arm(arm, evaluated, train, scale, k, deadline, target), target, config), k, config).select(F.lit(arm.name).alias("arm"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def audit_targets(evaluated: DataFrame, triggered: DataFrame, target: int = TARGET_CLASS) -> DataFrame:
    """A row per target and epoch with its scores and the epoch of its trigger, if any."""
    marks = triggered.select("object_id", "trigger_epoch")
    return evaluated.where(F.col("y") == target).join(marks, "object_id", "left").select("object_id", "epoch", f"p_{target}", "novelty", "trigger_epoch")


def changed_triggers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Objects that one arm triggers and the other does not."""
    x, y = a.select("object_id"), b.select("object_id")
    return x.subtract(y).withColumn("arm", F.lit("first")).unionByName(y.subtract(x).withColumn("arm", F.lit("second")))
