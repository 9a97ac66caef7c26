"""Queries on triggering, resampling and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import BoostingConfig, DecisionConfig
from .functions.binomial import clopper_pearson
from .functions.scalars import MIX_ALL, MIX_ONE, MIX_STEP, MIX_TWO, draw_keys, hash_uniform, poisson, poisson_steps
from .operators import asof, boosting
from .operators import calibration as C
from .operators import decision as D
from .operators import models as M
from .operators import novelty as N
from .operators import resample as R
from .operators.recalibration import SelectionAwareRecalibrator
from .plans.views import SCORED_SQL, SEL_SQL, metadata, observations, scored, selected, uniform_sql
from .query_features import PREFIX_SQL, wide
from .query_metrics import _BIN as BIN_SQL
from .registry import Registry, rounded
from .sources.shared import kept

query = Registry()
CONFIG = DecisionConfig()


def _scale(rows) -> float:
    return N.scale(rows.where("epoch = 2 and S = 1"))


def _cohort(spark, sf_dir):
    """Evaluated rows (S = 0), training rows (S = 1) and the novelty scale."""
    rows = kept(scored(spark, sf_dir), "scored")  # read by every epoch, arm and threshold
    return rows.where("S = 0"), rows.where("S = 1"), _scale(rows)


def score_sql(weight: float, target: int = 64) -> str:
    return f"""{SCORED_SQL}, sc AS (SELECT stddev_pop(novelty) AS scale FROM scored WHERE epoch = 2 AND S = 1),
ev AS (SELECT object_id, epoch, y, p_{target} + {weight}::DOUBLE * novelty / scale AS score, S FROM scored, sc)"""


def _quota_sql(k: int) -> str:
    """CTE `tau`: the train score at the quota's rank, largest over epochs; Python's round() is half to even."""
    ranks = f"greatest(1, round_even((SELECT count(*) FROM ev WHERE S = 1 AND epoch = t.epoch) * {k}.0::DOUBLE / (SELECT count(DISTINCT object_id) FROM ev WHERE S = 0), 0))"
    return f"tau AS (SELECT max(score) AS cut FROM (SELECT t.epoch, score, row_number() OVER (PARTITION BY t.epoch ORDER BY score DESC, object_id) AS r, {ranks} AS q FROM ev t WHERE S = 1) WHERE r = q)"


def trig_sql(cut: str, k: int) -> str:
    """CTE `trig` over `ev`: top k of epoch 0, then of epoch 2 without them."""
    return f"""e0 AS (SELECT object_id, 0.0::DOUBLE AS trigger_epoch, score FROM ev WHERE S = 0 AND epoch = 0 AND score >= {cut} ORDER BY score DESC, object_id LIMIT {k}),
e2 AS (SELECT object_id, 2.0::DOUBLE AS trigger_epoch, score FROM ev WHERE S = 0 AND epoch = 2 AND score >= {cut} AND object_id NOT IN (SELECT object_id FROM e0) ORDER BY score DESC, object_id LIMIT {k}),
trig AS (SELECT * FROM e0 UNION ALL SELECT * FROM e2)"""


def outcome_sql(target: int = 64, c: DecisionConfig = CONFIG) -> str:
    return f"""oc AS (SELECT o.object_id, o.y, t.object_id IS NOT NULL AS triggered, o.y = {target} AS is_target,
  CASE WHEN t.object_id IS NOT NULL AND o.y = {target} THEN {c.u_tp}::DOUBLE WHEN t.object_id IS NOT NULL THEN {c.u_fp}::DOUBLE WHEN o.y = {target} THEN {c.u_fn}::DOUBLE ELSE {c.u_tn}::DOUBLE END AS utility
  FROM (SELECT DISTINCT object_id, y FROM ev WHERE S = 0) o LEFT JOIN trig t USING (object_id))"""


def regret_sql(k: int, by: str = "", w: str = "1", c: DecisionConfig = CONFIG) -> str:
    """CTE `rg` over `oc`."""
    pre = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""s0 AS (SELECT {pre}sum({w} * utility)::DOUBLE AS u_policy, sum({w} * is_target::INT)::DOUBLE AS n_targets, sum({w} * (NOT is_target)::INT)::DOUBLE AS n_others, sum({w} * (triggered AND is_target)::INT)::DOUBLE AS hits, sum({w} * (triggered AND NOT is_target)::INT)::DOUBLE AS false_triggers, 0.0::DOUBLE AS u_no_trigger FROM oc{group}),
s1 AS (SELECT *, least(n_targets, {k}) * {c.u_tp}::DOUBLE + (n_targets - least(n_targets, {k})) * {c.u_fn}::DOUBLE AS u_oracle FROM s0),
rg AS (SELECT {pre}u_policy, n_targets, n_others, hits, false_triggers, u_no_trigger, u_oracle, u_oracle - u_policy AS regret, round((u_oracle - u_policy) / greatest(1.0::DOUBLE, u_oracle), 6) + 0.0 AS normalized_regret,
  CASE WHEN n_targets = 0 THEN 0.0::DOUBLE ELSE round((n_targets - hits) / n_targets, 6) END AS mhver, CASE WHEN n_others = 0 THEN 0.0::DOUBLE ELSE round(false_triggers / n_others, 6) END AS false_trigger_rate,
  CASE WHEN n_targets = 0 THEN 0.0::DOUBLE ELSE round(hits / n_targets, 6) END AS target_rate, CASE WHEN hits + false_triggers = 0 THEN 0.0::DOUBLE ELSE round(hits / (hits + false_triggers), 6) END AS purity FROM s1)"""


@query("w3_top_k_threshold", f"WITH {score_sql(0.05)} SELECT object_id, round(score, 6) AS score FROM ev WHERE epoch = 2 AND score >= 0.3 ORDER BY ev.score DESC, object_id LIMIT 25")
def top_k(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(D.top_k(D.with_score(rows.where("epoch = 2"), 0.05, _scale(rows)), 25, 0.3).select("object_id", "score"))


@query("w4_sequential_policy", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 22)} SELECT object_id, trigger_epoch, round(score, 6) AS score FROM trig")
def sequential(spark, sf_dir):
    ev, _, scale = _cohort(spark, sf_dir)
    return rounded(D.sequential(D.with_score(ev, 0.05, scale), 22, 0.001, 2.0))


@query("w5_quota_threshold", f"WITH {score_sql(0.0)}, {_quota_sql(22)} SELECT round(cut, 6) AS cut FROM tau")
def quota(spark, sf_dir):
    ev, train, scale = _cohort(spark, sf_dir)
    n = ev.select("object_id").distinct().count()
    return rounded(spark.createDataFrame([(D.quota_threshold(D.with_score(train, 0.0, scale), 22, n),)], "cut double"))


@query("w6_oracle_choice", f"WITH {SCORED_SQL} SELECT object_id, row_number() OVER (ORDER BY object_id)::INT AS place FROM (SELECT DISTINCT object_id FROM scored WHERE S = 0 AND y = 64) ORDER BY object_id LIMIT 22")
def oracle_choice(spark, sf_dir):
    from pyspark.sql import Window

    ev, _, _ = _cohort(spark, sf_dir)
    first = ev.where("y = 64").select("object_id").distinct().orderBy("object_id").limit(22)
    return first.withColumn("place", F.row_number().over(Window.orderBy("object_id")))  # 22 rows


def _outcomes(spark, sf_dir, k: int = 22):
    ev, _, scale = _cohort(spark, sf_dir)
    trig = D.sequential(D.with_score(ev, 0.05, scale), k, 0.001, 2.0)
    return D.outcomes(ev.groupBy("object_id").agg(F.first("y").alias("y")), trig)


@query("a27_object_utility", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 22)}, {outcome_sql()} SELECT triggered, is_target, utility, count(*) AS n FROM oc GROUP BY ALL")
def object_utility(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("triggered", "is_target", "utility").agg(F.count("*").alias("n"))


_REGRET = "u_policy, n_targets, n_others, hits, false_triggers, u_no_trigger, u_oracle, regret, normalized_regret, mhver, false_trigger_rate, target_rate, purity"


@query("a28_regret", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 22)}, {outcome_sql()}, {regret_sql(22)} SELECT {_REGRET} FROM rg")
def regret(spark, sf_dir):
    return rounded(D.regret(_outcomes(spark, sf_dir), 22))


@query("a29_miss_rate", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 5)}, {outcome_sql()}, {regret_sql(5)} SELECT n_targets, hits, mhver FROM rg")
def miss_rate(spark, sf_dir):
    return rounded(D.regret(_outcomes(spark, sf_dir, 5), 5).select("n_targets", "hits", "mhver"))


@query("a30_rates_by_deadline", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 22)}, o AS (SELECT DISTINCT object_id, y FROM ev WHERE S = 0) SELECT d AS deadline, count(*) FILTER (y = 64) AS n_targets, round(count(*) FILTER (y = 64 AND trigger_epoch <= d) / count(*) FILTER (y = 64), 6) AS target_rate, round(count(*) FILTER (y <> 64 AND trigger_epoch <= d) / count(*) FILTER (y <> 64), 6) AS false_trigger_rate FROM (SELECT unnest([0.0::DOUBLE, 2.0::DOUBLE]) AS d), o LEFT JOIN trig USING (object_id) GROUP BY d")
def rates(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).withColumn("deadline", F.explode(F.array(F.lit(0.0), F.lit(2.0))))
    by = F.coalesce(F.col("trigger_epoch") <= F.col("deadline"), F.lit(False))
    g = F.col("is_target")
    return rounded(rows.groupBy("deadline").agg(F.count_if(g).alias("n_targets"), (F.count_if(g & by) / F.count_if(g)).alias("target_rate"), (F.count_if(~g & by) / F.count_if(~g)).alias("false_trigger_rate")))


@query(
    "b7_jackknife",
    f"""WITH {score_sql(0.05)}, {trig_sql('0.001', 22)}, {outcome_sql()}, {regret_sql(22)}, j AS (SELECT o.triggered, o.utility, g.u_policy, g.hits, g.n_targets - 1 AS m, least(g.n_targets - 1, 22) * 2.0::DOUBLE AS u FROM oc o, rg g WHERE is_target),
l AS (SELECT u - (u_policy - utility) AS r, (u - (u_policy - utility)) / greatest(1.0::DOUBLE, u) AS nr, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m - (hits - triggered::INT)) / m END AS miss FROM j)
SELECT count(*) AS n_left_out, round(min(r), 6) AS regret_min, round(max(r), 6) AS regret_max, round(min(nr), 6) AS normalized_min, round(max(nr), 6) AS normalized_max, round(min(miss), 6) AS mhver_min, round(max(miss), 6) AS mhver_max FROM l""",
)
def jackknife(spark, sf_dir):
    return rounded(D.jackknife(_outcomes(spark, sf_dir), 22))


def _arm_sql(name: str, weight: float, cut: str, k: int, target: int, columns: str) -> str:
    quota = f", {_quota_sql(k)}" if "tau" in cut else ""
    return f"SELECT '{name}' AS arm, {columns} FROM (WITH {score_sql(weight, target)}{quota}, {trig_sql(cut, k)}, {outcome_sql(target)}, {regret_sql(k)} SELECT * FROM rg)"


def _arms_sql(k: int, target: int) -> str:
    return " UNION ALL ".join(_arm_sql(a.name, a.weight, "(SELECT cut FROM tau)" if a.threshold is None else str(a.threshold), k, target, _REGRET) for a in D.ARMS)


def _arms(spark, sf_dir, k: int, target: int):
    ev, train, scale = _cohort(spark, sf_dir)
    return rounded(D.compare_arms(D.ARMS, ev, train, scale, k, 2.0, target))


@query("d1_three_arms", _arms_sql(5, 64))
def three_arms(spark, sf_dir):
    return _arms(spark, sf_dir, 5, 64)


@query("d2_corrected_capacity", _arms_sql(22, 64))
def corrected_capacity(spark, sf_dir):
    return _arms(spark, sf_dir, 22, 64)


@query("d3_other_target", _arms_sql(5, 95))
def other_target(spark, sf_dir):
    return _arms(spark, sf_dir, 5, 95)


_GRID = [(u, k, w) for u in (1.0, 2.0, 5.0) for k in (1, 5, 10) for w in (0.0, 0.05, 0.1)]


def _grid_sql() -> str:
    cells = []
    for u, k, w in _GRID:
        c = DecisionConfig(u_tp=u, capacity=k, novelty_weight=w)
        cells.append(f"SELECT {u}::DOUBLE AS u_tp, {k} AS k, {w}::DOUBLE AS weight, u_policy, u_oracle, hits FROM (WITH {score_sql(w)}, {trig_sql('0.001', k)}, {outcome_sql(64, c)}, {regret_sql(k, c=c)} SELECT * FROM rg)")
    return " UNION ALL ".join(cells)


@query("d4_sensitivity_grid", _grid_sql())
def grid(spark, sf_dir):
    """All 27 cells from one rank-limited pass."""
    ev, _, scale = _cohort(spark, sf_dir)
    return D.policy_grid(ev, scale, (1, 5, 10), (0.0, 0.05, 0.1), (1.0, 2.0, 5.0), 0.001, 2.0)


@query("d5_target_audit", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 22)} SELECT object_id, s.epoch, round(p_64, 6) AS p_64, round(novelty, 6) AS novelty, trigger_epoch FROM scored s LEFT JOIN trig USING (object_id) WHERE s.S = 0 AND y = 64")
def audit(spark, sf_dir):
    ev, _, scale = _cohort(spark, sf_dir)
    return rounded(D.audit_targets(ev, D.sequential(D.with_score(ev, 0.05, scale), 22, 0.001, 2.0)))


def _trig_of(weight: float) -> str:
    return f"SELECT object_id FROM (WITH {score_sql(weight)}, {trig_sql('0.001', 22)} SELECT * FROM trig)"


@query("u3_changed_triggers", f"SELECT object_id, 'first' AS arm FROM ({_trig_of(0.05)} EXCEPT {_trig_of(0.0)}) UNION ALL SELECT object_id, 'second' FROM ({_trig_of(0.0)} EXCEPT {_trig_of(0.05)})")
def changed(spark, sf_dir):
    ev, _, scale = _cohort(spark, sf_dir)
    a, b = (D.sequential(D.with_score(ev, w, scale), 22, 0.001, 2.0) for w in (0.05, 0.0))
    return D.changed_triggers(a, b)


def _poisson_sql(u: str) -> str:
    steps = poisson_steps()
    return "CASE" + "".join(f" WHEN {u} < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(steps)) + f" ELSE {len(steps)} END"


def _mix_sql(rows: str, h: str) -> str:
    """rows with 32 bits of a column mixed in place."""
    one = f"SELECT * REPLACE (((xor({h}, {h} >> 16)) * {MIX_ONE}) & {MIX_ALL} AS {h}) FROM ({rows})"
    two = f"SELECT * REPLACE (((xor({h}, {h} >> 15)) * {MIX_TWO}) & {MIX_ALL} AS {h}) FROM ({one})"
    return f"SELECT * REPLACE (xor({h}, {h} >> 15) AS {h}) FROM ({two})"


def boot_sql(source: str, n: int, seed: int = 42, name: str = "bt", weight: str | None = None, more: str = "") -> str:
    """CTE `bt`: source once for each replicate with its weight. `more` joins what another law's weight needs."""
    one, two = draw_keys(seed)
    a = _mix_sql(f"SELECT s.*, xor(object_id::BIGINT & {MIX_ALL}, {one}) AS _a, (object_id::BIGINT >> 32) & {MIX_ALL} AS _b FROM {source} s", "_a")
    b = _mix_sql(f"SELECT * REPLACE (xor(xor(_b, _a), {two}) AS _b) FROM ({a})", "_b")
    h = _mix_sql(f"SELECT *, (_a + replicate * {MIX_STEP}) & {MIX_ALL} AS _h FROM ({b}), (SELECT unnest(range({n})) AS replicate)", "_h")
    h = _mix_sql(f"SELECT * REPLACE (xor(_h, _b) AS _h) FROM ({h})", "_h")
    return f"{name} AS (SELECT * FROM (SELECT * EXCLUDE (_a, _b, _h), {weight or _poisson_sql('(_h / 4294967296.0::DOUBLE)')} AS weight FROM ({h}){more}) WHERE weight > 0)"


#: Replicates, as the study has them.
REPLICATES = 1000
_ONE = "(SELECT * FROM scored WHERE epoch = 2)"


@query("b1_bootstrap_weights", f"WITH {SCORED_SQL}, {boot_sql(_ONE, REPLICATES)} SELECT replicate::INT AS replicate, weight, count(*) AS n FROM bt GROUP BY ALL")
def bootstrap_weights(spark, sf_dir):
    return R.weight_counts(scored(spark, sf_dir).where("epoch = 2"), REPLICATES)


_BINX = "CASE WHEN p < 0 OR p > 1 THEN NULL " + " ".join(f"WHEN p >= {k}::DOUBLE * 0.1::DOUBLE THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END"


def _murphy_boot_sql(by: str) -> str:
    """CTE `mu` over `bt`: the decomposition of each replicate (and of `by`)."""
    lp = " UNION ALL ".join(f"SELECT {by}, weight, {c} AS class_id, p_{c} AS p, (y = {c})::INT::DOUBLE AS hit FROM bt" for c in (64, 90, 95))
    own = f"PARTITION BY {by}, class_id"
    return f"""lp AS ({lp}), b AS (SELECT {by}, class_id, {_BINX} AS bin, sum(weight)::DOUBLE AS n, sum(weight * p) / sum(weight) AS mp, sum(weight * hit) / sum(weight) AS mo FROM lp GROUP BY ALL),
m0 AS (SELECT *, n / sum(n) OVER ({own}) AS w, sum(n * mo) OVER ({own}) / sum(n) OVER ({own}) AS base FROM b WHERE bin IS NOT NULL),
m1 AS (SELECT {by}, class_id, sum(w * (mp - mo) * (mp - mo)) AS rel, sum(w * (mo - base) * (mo - base)) AS res, max(base * (1 - base)) AS unc, sum(w * abs(mp - mo)) AS ece FROM m0 GROUP BY ALL),
mu AS (SELECT {by}, sum(rel) AS reliability, sum(res) AS resolution, sum(unc) AS uncertainty, avg(ece) AS mean_ece FROM m1 GROUP BY ALL)"""


@query("b1_calibration_bootstrap", f"WITH {SCORED_SQL}, {boot_sql(_ONE, REPLICATES)}, {_murphy_boot_sql('replicate')} SELECT replicate::INT AS replicate, round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(uncertainty, 6) AS uncertainty, round(mean_ece, 6) AS mean_ece, round(reliability - resolution + uncertainty, 6) AS binned_brier FROM mu")
def calibration_bootstrap(spark, sf_dir):
    return rounded(R.calibration(scored(spark, sf_dir).where("epoch = 2"), REPLICATES))


_GAP = "+".join(f"(p_{c} - (y = {c})::INT) * (p_{c} - (y = {c})::INT)" for c in (64, 90, 95))


def _gap(t: str):
    return sum((F.col(f"{t}_{c}") - (F.col("y") == c).cast("double")) * (F.col(f"{t}_{c}") - (F.col("y") == c).cast("double")) for c in (64, 90, 95))


_PAIR = "(SELECT * FROM scored WHERE epoch IN (0, 7))"


@query(
    "b2_paired_bootstrap",
    f"""WITH {SCORED_SQL}, {boot_sql(_PAIR, REPLICATES)}, {_murphy_boot_sql('replicate, epoch')}, br AS (SELECT replicate, epoch, sum(weight * ({_GAP})) / sum(weight) AS brier FROM bt GROUP BY ALL),
j AS (SELECT * FROM br JOIN mu USING (replicate, epoch))
SELECT r.replicate::INT AS replicate, round(r.brier - n.brier, 6) + 0.0 AS brier_gain, round(r.reliability - n.reliability, 6) + 0.0 AS reliability_gain, round(r.mean_ece - n.mean_ece, 6) + 0.0 AS ece_gain FROM j r JOIN j n USING (replicate) WHERE r.epoch = 0 AND n.epoch = 7""",
)
def paired(spark, sf_dir):
    return rounded(R.paired(scored(spark, sf_dir).withColumn("gap", _gap("p")), "epoch", 0, 7, "gap", REPLICATES))


def _rate_sql(name: str, where: str) -> str:
    """CTE of a rate of R.SUBSAMPLE objects at most, and its Poisson steps c0, c1, ..."""
    n = len(poisson_steps())
    terms = ", ".join(f"t{k - 1} * (lam / {k}) AS t{k}" for k in range(1, n))
    steps = ", ".join(f"c{k - 1} + t{k} AS c{k}" for k in range(1, n))
    return f"{name} AS (SELECT exp(-lam) AS t0, {terms}, t0 AS c0, {steps} FROM (SELECT least(1.0::DOUBLE, {R.SUBSAMPLE}.0::DOUBLE / greatest(count(*), 1)) AS lam FROM sel WHERE {where}))"


_RATED = "CASE" + "".join(f" WHEN _h / 4294967296.0::DOUBLE < c{k} THEN {k}" for k in range(len(poisson_steps()))) + f" ELSE {len(poisson_steps())} END"
_X = "(SELECT object_id, hostgal_photoz AS x FROM sel WHERE {})"
_TERM = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0.0::DOUBLE END"


@query(
    "b3_shift_bootstrap",
    f"""WITH {SEL_SQL}, {_rate_sql('la', 'true')}, {_rate_sql('lb', 'S = 1')}, {boot_sql(_X.format('true'), REPLICATES, 42, 'd1', _RATED, ', la')}, {boot_sql(_X.format('S = 1'), REPLICATES, 43, 'd2', _RATED, ', lb')},
dr AS (SELECT replicate, x, sum(t) AS t, sum(b) AS b FROM (SELECT replicate, x, weight AS t, 0 AS b FROM d1 UNION ALL SELECT replicate, x, 0, weight FROM d2) GROUP BY ALL),
s AS (SELECT replicate, sum(t) AS n1, sum(b) AS n2, sum(t * x) AS a1, sum(b * x) AS a2, sum(t * x * x) AS b1, sum(b * x * x) AS b2 FROM dr GROUP BY 1),
q1 AS (SELECT replicate, quantile_cont(x, 0.5) AS q1 FROM (SELECT replicate, x, unnest(range(t::BIGINT)) FROM dr) GROUP BY 1), q2 AS (SELECT replicate, quantile_cont(x, 0.5) AS q2 FROM (SELECT replicate, x, unnest(range(b::BIGINT)) FROM dr) GROUP BY 1),
g AS (SELECT *, abs(sum(t) OVER u / sum(t) OVER o - sum(b) OVER u / sum(b) OVER o) AS gap, lead(x) OVER u - x AS step, min(x) OVER o AS lo, max(x) OVER o AS hi FROM dr WHERE replicate < {R.DISTANCES} WINDOW u AS (PARTITION BY replicate ORDER BY x), o AS (PARTITION BY replicate)),
di AS (SELECT replicate, sum(gap * coalesce(step, 0)) AS wasserstein, max(gap) AS ks FROM g GROUP BY 1),
ce AS (SELECT replicate, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 100), 99) ELSE 0 END AS bin, sum(t) AS t, sum(b) AS b FROM g GROUP BY ALL),
pq AS (SELECT replicate, t / sum(t) OVER (PARTITION BY replicate) AS p, b / sum(b) OVER (PARTITION BY replicate) AS q FROM ce),
js AS (SELECT replicate, sum({_TERM.format('p')} + {_TERM.format('q')}) / 2 AS js FROM pq GROUP BY 1)
SELECT replicate::INT AS replicate, round(a2 / n2 - a1 / n1, 6) + 0.0 AS mean_shift, round(q2 - q1, 6) + 0.0 AS median_shift, round((a2 / n2 - a1 / n1) / sqrt((b1 - a1 * a1 / n1 + b2 - a2 * a2 / n2) / (n1 + n2 - 2)), 6) + 0.0 AS cohens_d, round(wasserstein, 6) AS wasserstein, round(js, 6) AS js, round(ks, 6) AS ks
FROM s JOIN q1 USING (replicate) JOIN q2 USING (replicate) LEFT JOIN di USING (replicate) LEFT JOIN js USING (replicate)""",
)
def shift_bootstrap(spark, sf_dir):
    return rounded(R.shift(selected(spark, sf_dir), "hostgal_photoz", "S", REPLICATES))


@query(
    "b4_auc_bootstrap",
    f"""WITH {SCORED_SQL}, {boot_sql(_ONE, REPLICATES)}, g AS (SELECT replicate, p_64 AS x, sum(weight * (y = 64)::INT) AS tp, sum(weight * (y <> 64)::INT) AS fp FROM bt GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER (PARTITION BY replicate ORDER BY x DESC) AS ctp, sum(fp) OVER (PARTITION BY replicate ORDER BY x DESC) AS cfp FROM g)
SELECT replicate::INT AS replicate, round(sum(fp * (ctp - tp / 2.0::DOUBLE)) / (sum(tp)::DOUBLE * sum(fp)), 6) AS roc_auc, round(sum(tp * (ctp / (ctp + cfp))) / sum(tp), 6) AS avg_precision FROM c GROUP BY 1""",
)
def auc_bootstrap(spark, sf_dir):
    rows = scored(spark, sf_dir).where("epoch = 2").withColumn("hit", (F.col("y") == 64).cast("long"))
    return rounded(R.ranking(rows, "p_64", REPLICATES))


@query("b5_regret_bootstrap", f"WITH {score_sql(0.05)}, {trig_sql('0.001', 22)}, {outcome_sql().replace('oc AS', 'o1 AS')}, {boot_sql('o1', REPLICATES)}, oc AS (SELECT * FROM bt), {regret_sql(22, 'replicate', 'weight')} SELECT replicate::INT AS replicate, {_REGRET} FROM rg")
def regret_bootstrap(spark, sf_dir):
    return rounded(R.decisions(_outcomes(spark, sf_dir), 22, REPLICATES))


@query("b6_retention_bootstrap", f"WITH {SEL_SQL}, {boot_sql('sel', REPLICATES)}, c AS (SELECT replicate, true_target, sum(weight) AS w, sum(weight * S) AS k FROM bt GROUP BY ALL) SELECT replicate::INT AS replicate, true_target, round(k / w, 6) AS retention, round(k / sum(k) OVER (PARTITION BY replicate) - w / sum(w) OVER (PARTITION BY replicate), 6) + 0.0 AS share_shift FROM c")
def retention_bootstrap(spark, sf_dir):
    return rounded(R.retention(selected(spark, sf_dir), REPLICATES))


@query("b6_retention_interval", f"WITH {SEL_SQL}, {boot_sql('sel', REPLICATES)}, r AS (SELECT replicate, sum(weight * S) / sum(weight) AS v FROM bt WHERE true_target = 90 GROUP BY 1) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r")
def retention_interval(spark, sf_dir):
    rows = R.retention(selected(spark, sf_dir).where("true_target = 90"), REPLICATES)
    return rounded(R.interval(rows, "retention"))


_U = uniform_sql("'x:' || object_id")


@query("f_hash_uniform", f"WITH {SEL_SQL} SELECT object_id, round({_U}, 9) AS u, {_poisson_sql(_U)} AS k FROM sel")
def uniforms(spark, sf_dir):
    u = hash_uniform("x", F.col("object_id"))
    return rounded(selected(spark, sf_dir).select("object_id", u.alias("u"), poisson(u).alias("k")), 9)


def _tail_sql(low: str, high: str, p: str) -> str:
    """Chance of low to high successes in n trials."""
    return f"list_sum(list_transform(range({low}, {high} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"


def _interval_sql(counts: str, name: str) -> str:
    """Exact intervals of rows (name, k, n) of the CTEs `counts` and `c`: halving towards the tails' chance of 0.025."""
    return f"""WITH RECURSIVE {counts},
i AS (SELECT *, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0 AS step FROM c
  UNION ALL SELECT {name}, k, n, CASE WHEN {_tail_sql('k', 'n', '((a + b) / 2)')} < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN {_tail_sql('k', 'n', '((a + b) / 2)')} < 0.025 THEN b ELSE (a + b) / 2 END,
    CASE WHEN {_tail_sql('0', 'k', '((c + d) / 2)')} > 0.025 THEN (c + d) / 2 ELSE c END, CASE WHEN {_tail_sql('0', 'k', '((c + d) / 2)')} > 0.025 THEN d ELSE (c + d) / 2 END, step + 1 FROM i WHERE step < 34)
SELECT {name}, k, n, round(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE a END, 6) AS low, round(CASE WHEN k = n THEN 1.0::DOUBLE ELSE d END, 6) AS high FROM i WHERE step = 34"""


@query("f8_exact_intervals", _interval_sql(f"{SEL_SQL}, c AS (SELECT true_target, sum(S)::BIGINT AS k, count(*) AS n FROM sel GROUP BY 1)", "true_target"))
def exact_intervals(spark, sf_dir):
    """Clopper-Pearson intervals of each class's retention; the SQL halves towards them by sums of the binomial's tails."""
    rows = selected(spark, sf_dir).groupBy("true_target").agg(F.sum("S").alias("k"), F.count("*").alias("n")).collect()  # a row for each class
    return rounded(spark.createDataFrame([(r.true_target, r.k, r.n, *clopper_pearson(r.k, r.n)) for r in rows], "true_target int, k long, n long, low double, high double"))


@query("a30_trigger_intervals", _interval_sql(f"{score_sql(0.05)}, {trig_sql('0.001', 22)}, {outcome_sql()}, {regret_sql(22)}, c AS (SELECT 'target_rate' AS rate, hits::BIGINT AS k, n_targets::BIGINT AS n FROM rg UNION ALL SELECT 'false_trigger_rate', false_triggers::BIGINT, n_others::BIGINT FROM rg)", "rate"))
def trigger_intervals(spark, sf_dir):
    """Exact intervals of the target and the false trigger rate."""
    r = D.regret(_outcomes(spark, sf_dir), 22).first()
    return rounded(spark.createDataFrame(D.trigger_intervals(int(r.hits), int(r.n_targets), int(r.false_triggers), int(r.n_others)), "rate string, k long, n long, low double, high double"))


def _training(spark, sf_dir):
    """Representations at all epochs with class and S, and the names of their features."""
    meta = metadata(spark, sf_dir).where("true_target <> 15 and object_id is not null").withColumnRenamed("true_target", "y")
    rows = wide(spark, sf_dir, meta, "y")
    names = [c for c in rows.columns if c not in ("object_id", "epoch", "y")]
    return rows.withColumn("S", (hash_uniform(42, F.col("object_id")) < 0.5).cast("int")), names


@query("m1_baseline_classifier")
def baseline(spark, sf_dir):
    """The reference's settings, at each of its epochs, on all features."""
    rows, names = _training(spark, sf_dir)
    return boosting.predictions(rows, names, BoostingConfig())


def _recalibration_sql(steps: int = 1600) -> str:
    """The same coefficients by another way: steps of a fixed bound of the Gram matrix (half the features' own), which a
    Cholesky factor of 4 x 4 solves for each class. They come some 0.97 nearer each time."""
    k, f = range(3), range(4)
    gram = ", ".join(f"0.5::DOUBLE * sum(w * x{i} * x{j}) + {1.0 if i == j < 3 else 0.0}::DOUBLE AS b{i}{j}" for i in f for j in f if j <= i)
    factor, last = "", "b"
    for j in f:
        diagonal = f"sqrt(b{j}{j}" + "".join(f" - l{j}{m} * l{j}{m}" for m in range(j)) + f") AS l{j}{j}"
        below = "".join(f", (b{i}{j}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j)) + f") / (SELECT sqrt(b{j}{j}" + "".join(f" - l{j}{m} * l{j}{m}" for m in range(j)) + f") FROM {last}) AS l{i}{j}" for i in f if i > j)
        factor += f"c{j} AS (SELECT *, {diagonal}{below} FROM {last}),\n"
        last = f"c{j}"
    z = ", ".join(f"{' + '.join(f't{c}{j} * x{j}' for j in f)} AS z{c}" for c in k)
    e = ", ".join(f"exp(z{c} - greatest(z0, z1, z2)) AS e{c}" for c in k)
    names = ", ".join(f"t{c}{j}" for c in k for j in f)
    slope = ", ".join(f"sum(w * (e{c} / (e0 + e1 + e2) - y{c}) * x{j}) + {'t%d%d' % (c, j) if j < 3 else '0.0::DOUBLE'} AS g{c}{j}" for c in k for j in f)
    forth = lambda c, j: f"(g{c}{j}" + "".join(f" - l{j}{m} * u{c}{m}" for m in range(j)) + f") / l{j}{j} AS u{c}{j}"
    back = lambda c, j: f"(u{c}{j}" + "".join(f" - l{m}{j} * v{c}{m}" for m in range(j + 1, 4)) + f") / l{j}{j} AS v{c}{j}"
    solve = f"SELECT * FROM a, {last}"
    for j in f:
        solve = f"SELECT *, {', '.join(forth(c, j) for c in k)} FROM ({solve})"
    for j in reversed(f):
        solve = f"SELECT *, {', '.join(back(c, j) for c in k)} FROM ({solve})"
    clip = lambda c: f"ln(greatest(least(p_{c}, 1.0::DOUBLE - 0.0000001::DOUBLE), 0.0000001::DOUBLE))"
    return f"""WITH RECURSIVE {SCORED_SQL},
own AS (SELECT s.*, p_spec, {', '.join(f'{clip(c)} AS x{i}' for i, c in enumerate((64, 90, 95)))}, 1.0::DOUBLE AS x3 FROM scored s JOIN (SELECT object_id, p_spec FROM sel) USING (object_id) WHERE epoch = 2),
r AS (SELECT x0, x1, x2, x3, {', '.join(f'(y = {c})::INT AS y{i}' for i, c in enumerate((64, 90, 95)))}, 1.0::DOUBLE / p_spec AS w FROM own WHERE S = 1),
b AS (SELECT {gram} FROM r),
{factor}it AS (SELECT 0 AS n, {', '.join(f'0.0::DOUBLE AS t{c}{j}' for c in k for j in f)}
UNION ALL SELECT n + 1, {', '.join(f't{c}{j} - v{c}{j}' for c in k for j in f)} FROM (WITH a AS (SELECT n, {names}, {slope} FROM (SELECT *, {e} FROM (SELECT *, {z} FROM r, it WHERE n < {steps})) GROUP BY n, {names}) {solve})),
new AS (SELECT object_id, y, hostgal_photoz, p_64, p_90, p_95, {', '.join(f'CASE WHEN hostgal_photoz > 1.5 THEN p_{c} ELSE e{i} / (e0 + e1 + e2) END AS q_{c}' for i, c in enumerate((64, 90, 95)))}
  FROM (SELECT *, {e} FROM (SELECT *, {z} FROM own, it WHERE n = {steps} AND S = 0)))"""


RECALIBRATION_SQL = _recalibration_sql()


@query("m3_recalibration", f"{RECALIBRATION_SQL} SELECT object_id, y, {', '.join(f'round({c}, 6) AS {c}' for c in ('hostgal_photoz', 'p_64', 'p_90', 'p_95', 'q_64', 'q_90', 'q_95'))} FROM new")
def recalibration(spark, sf_dir):
    return rounded(_recalibrated(spark, sf_dir))


def _recalibrated(spark, sf_dir):
    """Objects that were not selected, with probabilities recalibrated to the selected ones."""
    rows = scored(spark, sf_dir).where("epoch = 2").join(selected(spark, sf_dir).select("object_id", (1.0 / F.col("p_spec")).alias("w")), "object_id")
    model = SelectionAwareRecalibrator().fit(rows.where("S = 1"))
    return model.predict(rows.where("S = 0")).select("object_id", "y", "hostgal_photoz", "p_64", "p_90", "p_95", "q_64", "q_90", "q_95")


def _deltas_sql() -> str:
    gap = lambda p: " + ".join(f"({p}_{c} - (y = {c})::INT) * ({p}_{c} - (y = {c})::INT)" for c in (64, 90, 95))
    one = " UNION ALL ".join(f"SELECT '{tag}' AS tag, {c} AS class_id, {p}_{c} AS p, (y = {c})::INT::DOUBLE AS hit FROM new" for tag, p in (("raw", "p"), ("new", "q")) for c in (64, 90, 95))
    pick = lambda k, v: f"max({v}) FILTER (tag = '{k}')"
    out = []
    for k, v in (("brier", "brier"), ("rel", "rel"), ("ece", "ece")):
        out += [f"round({pick('raw', v)}, 6) AS {k}_raw", f"round({pick('new', v)}, 6) AS {k}_new", f"round({pick('raw', v)} - {pick('new', v)}, 6) AS {k}_gain", f"round(100 * ({pick('raw', v)} - {pick('new', v)}) / {pick('raw', v)}, 6) AS {k}_gain_pct"]
    return f"""{RECALIBRATION_SQL}, lp AS ({one}), bins AS (SELECT tag, class_id, {BIN_SQL} AS bin, count(*)::DOUBLE AS n, avg(p) AS mp, avg(hit) AS mo FROM lp GROUP BY ALL),
m0 AS (SELECT *, n / sum(n) OVER (PARTITION BY tag, class_id) AS part FROM bins), m1 AS (SELECT tag, class_id, sum(part * (mp - mo) * (mp - mo)) AS rel, sum(part * abs(mp - mo)) AS ece FROM m0 GROUP BY ALL),
m2 AS (SELECT tag, sum(rel) AS rel, avg(ece) AS ece FROM m1 GROUP BY 1), m3 AS (SELECT m2.*, brier FROM m2 JOIN (SELECT 'raw' AS tag, avg({gap('p')}) AS brier FROM new UNION ALL SELECT 'new', avg({gap('q')}) FROM new) USING (tag))
SELECT {', '.join(out)} FROM m3"""


@query("m4_recalibrated_scores", _deltas_sql())
def recalibrated_scores(spark, sf_dir):
    rows = kept(_recalibrated(spark, sf_dir), "recalibrated")
    new = rows.select("object_id", "y", *(F.col(f"q_{c}").alias(f"p_{c}") for c in (64, 90, 95)))
    return rounded(C.deltas(rows, new))


def _folds_sql(seed: int, n: int, by: str, source: str) -> str:
    return f"SELECT *, ((row_number() OVER (PARTITION BY {by} ORDER BY {uniform_sql(f"'{seed}:' || object_id")}, object_id) - 1) % {n})::INT AS fold FROM {source}"


@query("b9_stratified_folds", f"WITH {SEL_SQL}, o AS ({_folds_sql(42, 5, 'true_target', '(SELECT object_id, true_target FROM sel WHERE S = 1)')}), a AS (SELECT object_id, true_target, fold AS outer_fold FROM o), i AS ({_folds_sql(43, 3, 'true_target, outer_fold', 'a')}) SELECT object_id, true_target, outer_fold, fold AS inner_fold FROM i")
def stratified_folds(spark, sf_dir):
    """Five outer folds with each class's share to one object, and three inner ones in each of them."""
    rows = selected(spark, sf_dir).where("S = 1").select("object_id", "true_target")
    rows = kept(M.folds(rows, 5, 42, "true_target").withColumnRenamed("fold", "outer_fold"), "folds")
    return M.folds(rows, 3, 43, by=("true_target", "outer_fold")).select("object_id", "true_target", "outer_fold", F.col("fold").alias("inner_fold"))


@query("o5_all_epochs_one_pass", f"WITH {PREFIX_SQL} SELECT object_id, " + ", ".join(f"count(*) FILTER (epoch = {e}) AS n_{e}, count(*) FILTER (epoch = {e} AND det) AS n_det_{e}, round(max(mjd - t0) FILTER (epoch = {e}), 6) AS last_{e}" for e in (0, 2, 7)) + " FROM prefix GROUP BY 1")
def all_epochs(spark, sf_dir):
    """Every object's prefixes at every epoch, side by side, from one scan and one grouping; none reaches beyond its epoch."""
    rows = asof.epoch_sequences(observations(spark, sf_dir))
    cells = []
    for e in (0, 2, 7):
        at = F.col("epoch") == e
        cells += [F.count_if(at).alias(f"n_{e}"), F.count_if(at & F.col("det")).alias(f"n_det_{e}"), F.max(F.when(at, F.col("mjd") - F.col("t0"))).alias(f"last_{e}")]
    return rounded(rows.groupBy("object_id").agg(*cells))


QUERIES, ORACLE = query.queries, query.oracle
