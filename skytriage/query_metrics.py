"""Queries on distribution shift, calibration, weights, novelty and ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scalars import fused_score
from .operators import calibration as C
from .operators import discrimination as D
from .operators import novelty as N
from .operators import population as P
from .operators import quantiles as Q
from .operators import shift as S
from .operators import weights as W
from .plans.views import SCORED_SQL, SEL_SQL, metadata, scored, selected, table
from .query_features import WIDE_SQL, wide
from .registry import Registry, rounded
from .sources.shared import kept

query = Registry()


def _dist(x: str, source: str = "sel") -> str:
    """CTE `dist`: both distribution functions at each distinct value."""
    return f"""dist AS (SELECT x, sum(t) OVER (ORDER BY x) / sum(t) OVER () AS ft, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb, lead(x) OVER (ORDER BY x) - x AS step, sum(t) OVER () AS nt, sum(b) OVER () AS nb
  FROM (SELECT {x} AS x, count(*)::DOUBLE AS t, sum(S)::DOUBLE AS b FROM {source} GROUP BY 1))"""


_TAIL = "list_sum(list_transform(range(1, 41), lambda k: 2.0::DOUBLE * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * t * t)))"


@query("a18_ks_photoz", f"WITH {SEL_SQL}, {_dist('hostgal_photoz')}, k AS (SELECT max(nt) AS n, max(nb) AS m, max(abs(ft - fb)) AS d FROM dist), e AS (SELECT *, sqrt(n * m / (n + m)) AS en FROM k), s AS (SELECT *, (en + 0.12::DOUBLE + 0.11::DOUBLE / en) * d AS t FROM e) SELECT n::BIGINT AS n_true, m::BIGINT AS n_biased, round(d, 6) AS ks, round(CASE WHEN t < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_TAIL})) END, 6) + 0.0 AS p_value FROM s")
def ks_photoz(spark, sf_dir):
    rows = S.ks(selected(spark, sf_dir), "hostgal_photoz")
    return rounded(rows.withColumn("p_value", S.ks_p_value(F.col("ks"), F.col("n_true"), F.col("n_biased"))))


@query("a18_ks_halves", f"WITH {SEL_SQL}, h AS (SELECT mwebv, CASE WHEN hostgal_photoz < 0.5 THEN 1 ELSE 0 END AS S FROM sel), {_dist('mwebv', 'h')}, k AS (SELECT max(nt) AS n, max(nb) AS m, max(abs(ft - fb)) AS d FROM dist), e AS (SELECT *, sqrt(n * m / (n + m)) AS en FROM k), s AS (SELECT *, (en + 0.12::DOUBLE + 0.11::DOUBLE / en) * d AS t FROM e) SELECT round(d, 6) AS ks, round(CASE WHEN t < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_TAIL})) END, 6) + 0.0 AS p_value FROM s")
def ks_halves(spark, sf_dir):
    """Two samples that hardly differ, so that the p-value is neither 0 nor 1 by its bounds."""
    rows = selected(spark, sf_dir).withColumn("S", (F.col("hostgal_photoz") < 0.5).cast("int"))
    return rounded(S.ks(rows, "mwebv").select("ks", S.ks_p_value(F.col("ks"), F.col("n_true"), F.col("n_biased")).alias("p_value")))


@query("a18_ks_ties", f"WITH {SEL_SQL}, {_dist('mwebv')} SELECT max(nt)::BIGINT AS n_true, max(nb)::BIGINT AS n_biased, round(max(abs(ft - fb)), 6) AS ks FROM dist")
def ks_ties(spark, sf_dir):
    return rounded(S.ks(selected(spark, sf_dir), "mwebv"))


@query("a19_wasserstein", f"WITH {SEL_SQL}, {_dist('hostgal_photoz')} SELECT round(sum(abs(ft - fb) * coalesce(step, 0)), 6) AS wasserstein FROM dist")
def wasserstein(spark, sf_dir):
    return rounded(S.wasserstein(selected(spark, sf_dir), "hostgal_photoz"))


@query(
    "a20_js_divergence",
    f"""WITH {SEL_SQL}, r AS (SELECT min(hostgal_photoz) AS lo, max(hostgal_photoz) AS hi FROM sel),
c AS (SELECT least(floor((hostgal_photoz - lo) / (hi - lo) * 100), 99) AS bin, count(*) AS t, sum(S) AS b FROM sel, r GROUP BY 1),
d AS (SELECT t / sum(t) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM d""",
)
def js(spark, sf_dir):
    return rounded(S.js_divergence(selected(spark, sf_dir), "hostgal_photoz"))


@query(
    "a21_cohens_d",
    f"""WITH {SEL_SQL}, s AS (SELECT count(*) AS n1, sum(S) AS n2, var_samp(hostgal_photoz) AS v1, var_samp(CASE WHEN S = 1 THEN hostgal_photoz END) AS v2, avg(hostgal_photoz) AS m1, avg(CASE WHEN S = 1 THEN hostgal_photoz END) AS m2 FROM sel)
SELECT round(m1, 6) AS mean_true, round(m2, 6) AS mean_biased, round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d FROM s""",
)
def cohens_d(spark, sf_dir):
    return rounded(S.cohens_d(selected(spark, sf_dir), "hostgal_photoz"))


_NAMES = ["hostgal_photoz", "distmod", "mwebv", "libid_cadence"]
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS feature, {n}::DOUBLE AS x, S FROM sel" for n in _NAMES)


@query(
    "w9_ranked_ks",
    f"""WITH {SEL_SQL}, l AS ({_LONG}), g AS (SELECT feature, x, count(*)::DOUBLE AS t, sum(S)::DOUBLE AS b FROM l GROUP BY ALL),
d AS (SELECT feature, sum(t) OVER (PARTITION BY feature ORDER BY x) / sum(t) OVER (PARTITION BY feature) AS ft, sum(b) OVER (PARTITION BY feature ORDER BY x) / sum(b) OVER (PARTITION BY feature) AS fb, sum(t) OVER (PARTITION BY feature) AS nt, sum(b) OVER (PARTITION BY feature) AS nb FROM g),
k AS (SELECT feature, max(nt)::BIGINT AS n_true, max(nb)::BIGINT AS n_biased, max(abs(ft - fb)) AS ks FROM d GROUP BY 1)
SELECT feature, n_true, n_biased, round(ks, 6) AS ks, row_number() OVER (ORDER BY round(ks, 9) DESC, feature)::INT AS rank FROM k""",
)
def ranked_ks(spark, sf_dir):
    return rounded(S.ranked_ks(selected(spark, sf_dir), _NAMES))


@query("w10_percentiles", f"WITH {SEL_SQL} SELECT round(quantile_cont(hostgal_photoz, 0.025), 6) AS p2_5, round(quantile_cont(hostgal_photoz, 0.5), 6) AS p50, round(quantile_cont(hostgal_photoz, 0.975), 6) AS p97_5 FROM sel")
def percentiles(spark, sf_dir):
    found = Q.percentiles(selected(spark, sf_dir), "hostgal_photoz", [0.025, 0.5, 0.975])[()]
    return rounded(spark.createDataFrame([tuple(found)], "p2_5 double, p50 double, p97_5 double"))


@query("u4_distinct_values", f"WITH {SEL_SQL} SELECT DISTINCT round(mwebv, 6) AS mwebv FROM sel")
def distinct_values(spark, sf_dir):
    return rounded(selected(spark, sf_dir).select("mwebv").distinct())


_GAP = " + ".join(f"(p_{c} - (y = {c})::INT) * (p_{c} - (y = {c})::INT)" for c in (64, 90, 95))
_BIN = "CASE WHEN p < 0 OR p > 1 THEN NULL " + " ".join(f"WHEN p >= {k}::DOUBLE * 0.1::DOUBLE THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END"
LONGP_SQL = SCORED_SQL + ", longp AS (" + " UNION ALL ".join(f"SELECT object_id, epoch, S, {c} AS class_id, p_{c} AS p, (y = {c})::INT::DOUBLE AS hit FROM scored" for c in (64, 90, 95)) + ")"
BINS_SQL = LONGP_SQL + f""", bins AS (SELECT epoch, class_id, bin, count(*)::DOUBLE AS n, avg(p) AS mean_pred, avg(hit) AS mean_obs FROM (SELECT *, {_BIN} AS bin FROM longp) WHERE bin IS NOT NULL GROUP BY ALL)"""
MURPHY_SQL = BINS_SQL + """, m0 AS (SELECT *, n / sum(n) OVER (PARTITION BY epoch, class_id) AS w, sum(n * mean_obs) OVER (PARTITION BY epoch, class_id) / sum(n) OVER (PARTITION BY epoch, class_id) AS base FROM bins),
m1 AS (SELECT epoch, class_id, sum(w * (mean_pred - mean_obs) * (mean_pred - mean_obs)) AS rel, sum(w * (mean_obs - base) * (mean_obs - base)) AS res, max(base * (1 - base)) AS unc, sum(w * abs(mean_pred - mean_obs)) AS ece FROM m0 GROUP BY ALL)"""


@query("a13_brier", f"WITH {SCORED_SQL} SELECT epoch, S, count(*) AS n, round(avg({_GAP}), 6) AS brier FROM scored GROUP BY epoch, S")
def brier(spark, sf_dir):
    return rounded(C.brier(scored(spark, sf_dir), ("epoch", "S")))


@query("a14_murphy_decomposition", f"WITH {MURPHY_SQL} SELECT epoch, round(sum(rel), 6) AS reliability, round(sum(res), 6) AS resolution, round(sum(unc), 6) AS uncertainty, round(avg(ece), 6) AS mean_ece, round(sum(rel) - sum(res) + sum(unc), 6) AS binned_brier FROM m1 GROUP BY 1")
def murphy(spark, sf_dir):
    return rounded(C.murphy(scored(spark, sf_dir), ("epoch",)))


@query("a14_reliability_bins", f"WITH {BINS_SQL} SELECT epoch, class_id, bin, n, round(mean_pred, 6) AS mean_pred, round(mean_obs, 6) AS mean_obs FROM bins")
def reliability_bins(spark, sf_dir):
    return rounded(C.bins(scored(spark, sf_dir), ("epoch",)))


@query("a15_classwise_ece", f"WITH {MURPHY_SQL} SELECT epoch, class_id, round(ece, 6) AS ece FROM m1")
def classwise_ece(spark, sf_dir):
    return rounded(C.classwise_ece(scored(spark, sf_dir), ("epoch",)))


@query("a15_bin_counts", f"WITH {LONGP_SQL} SELECT c.class_id::INT AS class_id, b.bin::INT AS bin, count(l.p) AS n FROM (SELECT unnest([64, 90, 95]) AS class_id) c CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT *, {_BIN} AS bin FROM longp WHERE epoch = 2) l ON l.class_id = c.class_id AND l.bin = b.bin GROUP BY ALL")
def bin_counts(spark, sf_dir):
    return C.bin_counts(scored(spark, sf_dir).where("epoch = 2"))


def _edges(x: str, parts: int, source: str, by: str = "") -> str:
    marks = ", ".join(f"{i}.0::DOUBLE / {parts}" for i in range(parts + 1))
    return f"SELECT {by + ', ' if by else ''}list_sort(list_distinct(quantile_cont({x}, [{marks}]))) AS edges FROM {source}" + (f" GROUP BY {by}" if by else "")


def _edge_bin(x: str) -> str:
    return f"CASE WHEN len(edges) >= 2 AND {x} >= edges[1] AND {x} <= edges[-1] THEN least(len(list_filter(edges, lambda e: e <= {x})), len(edges) - 1) - 1 END::INT"


@query(
    "a16_adaptive_bins",
    f"""WITH {LONGP_SQL}, l AS (SELECT * FROM longp WHERE epoch = 2), e AS ({_edges('p', 10, 'l', 'class_id')})
SELECT class_id, bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(hit), 6) AS mean_obs FROM (SELECT l.*, {_edge_bin('p')} AS bin FROM l JOIN e USING (class_id)) WHERE bin IS NOT NULL GROUP BY ALL""",
)
def adaptive_bins(spark, sf_dir):
    return rounded(C.adaptive_bins(kept(scored(spark, sf_dir).where("epoch = 2"), "scored")))


_POPULATIONS = "pops AS (SELECT *, -19.3::DOUBLE + distmod + 3.1::DOUBLE * mwebv AS m_r, unnest(['all', CASE WHEN S = 1 THEN 'selected' ELSE 'others' END]) AS population FROM scored)"
_CURVES = " UNION ALL ".join(f"SELECT population, epoch, {c} AS class_id, p_{c} AS p, (y = {c})::INT::DOUBLE AS hit FROM pops" for c in (64, 90, 95))


@query(
    "s15_reliability_curves",
    f"""WITH {SCORED_SQL}, {_POPULATIONS}, l AS ({_CURVES}), e AS ({_edges('p', 10, 'l', 'population, epoch, class_id')})
SELECT population, epoch, class_id, bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(hit), 6) AS mean_obs FROM (SELECT l.*, {_edge_bin('p')} AS bin FROM l JOIN e USING (population, epoch, class_id)) WHERE bin IS NOT NULL GROUP BY ALL""",
)
def reliability_curves(spark, sf_dir):
    """Curves of every population, epoch and class at once."""
    return rounded(C.adaptive_bins(C.populations(kept(scored(spark, sf_dir), "scored")), by=("population", "epoch")))


_KINDS = {"probability decile": ("p_64", 10), "magnitude quintile": ("m_r", 5), "redshift quintile": ("hostgal_photoz", 5)}


def _cells_sql() -> str:
    edges = ", ".join(f"e{i} AS ({_edges(c, n, 'pops', 'population, epoch')})" for i, (c, n) in enumerate(_KINDS.values()))
    strata = " UNION ALL ".join(f"SELECT * FROM (SELECT p.*, '{k}' AS kind, {_edge_bin(c)} AS stratum FROM pops p JOIN e{i} USING (population, epoch)) WHERE stratum IS NOT NULL" for i, (k, (c, _)) in enumerate(_KINDS.items()))
    longp = " UNION ALL ".join(f"SELECT population, epoch, kind, stratum, {c} AS class_id, p_{c} AS p, (y = {c})::INT::DOUBLE AS hit FROM st" for c in (64, 90, 95))
    g = "population, epoch, kind, stratum"
    return f"""WITH {SCORED_SQL}, {_POPULATIONS}, {edges}, st AS (SELECT *, 'all' AS kind, 0 AS stratum FROM pops UNION ALL {strata}), lp AS ({longp}),
b AS (SELECT {g}, class_id, {_BIN} AS bin, count(*)::DOUBLE AS n, avg(p) AS mp, avg(hit) AS mo FROM lp GROUP BY ALL),
m0 AS (SELECT *, n / sum(n) OVER w AS part, sum(n * mo) OVER w / sum(n) OVER w AS base FROM b WINDOW w AS (PARTITION BY {g}, class_id)),
m1 AS (SELECT {g}, class_id, sum(part * (mp - mo) * (mp - mo)) AS rel, sum(part * (mo - base) * (mo - base)) AS res, max(base * (1 - base)) AS unc, sum(part * abs(mp - mo)) AS ece FROM m0 GROUP BY ALL),
m2 AS (SELECT {g}, sum(rel) AS reliability, sum(res) AS resolution, sum(unc) AS uncertainty, avg(ece) AS mean_ece FROM m1 GROUP BY ALL),
bs AS (SELECT {g}, count(*) AS n, avg({_GAP}) AS brier FROM st GROUP BY ALL)
SELECT {g}, n, round(brier, 9) AS brier, round(reliability, 9) AS reliability, round(resolution, 9) AS resolution, round(uncertainty, 9) AS uncertainty, round(mean_ece, 9) AS mean_ece, round(reliability - resolution + uncertainty, 9) AS binned_brier, n < 30 AS exploratory FROM bs JOIN m2 USING ({g})"""


@query("s15_audit_cells", _cells_sql())
def audit_cells(spark, sf_dir):
    """The audit's figures in one table: each population and epoch, whole and in every kind of stratum."""
    rows = C.populations(kept(scored(spark, sf_dir), "scored")).withColumn("m_r", F.lit(-19.3) + F.col("distmod") + 3.1 * F.col("mwebv"))
    return rounded(C.audit_cells(rows, _KINDS, ("population", "epoch")), 9)  # shares of 1,200 rows tie at six places


def _stratified_sql(x: str, parts: int) -> str:
    longp = " UNION ALL ".join(f"SELECT stratum, {c} AS class_id, p_{c} AS p, (y = {c})::INT::DOUBLE AS hit FROM st" for c in (64, 90, 95))
    return f"""WITH {SCORED_SQL}, s2 AS (SELECT *, -19.3::DOUBLE + distmod + 3.1::DOUBLE * mwebv AS m_r FROM scored WHERE epoch = 2), e AS ({_edges(x, parts, 's2')}),
st AS (SELECT * FROM (SELECT s2.*, {_edge_bin(x)} AS stratum FROM s2, e) WHERE stratum IS NOT NULL), lp AS ({longp}),
b AS (SELECT stratum, class_id, {_BIN} AS bin, count(*)::DOUBLE AS n, avg(p) AS mp, avg(hit) AS mo FROM lp GROUP BY ALL),
m0 AS (SELECT *, n / sum(n) OVER (PARTITION BY stratum, class_id) AS w, sum(n * mo) OVER (PARTITION BY stratum, class_id) / sum(n) OVER (PARTITION BY stratum, class_id) AS base FROM b),
m1 AS (SELECT stratum, class_id, sum(w * (mp - mo) * (mp - mo)) AS rel, sum(w * (mo - base) * (mo - base)) AS res, max(base * (1 - base)) AS unc, sum(w * abs(mp - mo)) AS ece FROM m0 GROUP BY ALL),
m2 AS (SELECT stratum, sum(rel) AS reliability, sum(res) AS resolution, sum(unc) AS uncertainty, avg(ece) AS mean_ece FROM m1 GROUP BY 1),
bs AS (SELECT stratum, count(*) AS n, avg({_GAP}) AS brier FROM st GROUP BY 1)
SELECT stratum, n, round(brier, 6) AS brier, round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(uncertainty, 6) AS uncertainty, round(mean_ece, 6) AS mean_ece, round(reliability - resolution + uncertainty, 6) AS binned_brier, n < 30 AS exploratory FROM bs JOIN m2 USING (stratum)"""


def _stratified(spark, sf_dir, x: str, parts: int):
    rows = scored(spark, sf_dir).where("epoch = 2").withColumn("m_r", F.lit(-19.3) + F.col("distmod") + 3.1 * F.col("mwebv"))
    rows = kept(rows, "scored")  # cut at its percentiles, then scored
    return rounded(C.stratified(C.strata(rows, x, parts, "stratum"), "stratum"))


@query("a17_photoz_quintiles", _stratified_sql("hostgal_photoz", 5))
def photoz_quintiles(spark, sf_dir):
    return _stratified(spark, sf_dir, "hostgal_photoz", 5)


@query("a17_probability_deciles", _stratified_sql("p_64", 10))
def probability_deciles(spark, sf_dir):
    return _stratified(spark, sf_dir, "p_64", 10)


@query("a17_magnitude_quintiles", _stratified_sql("m_r", 5))
def magnitude_quintiles(spark, sf_dir):
    return _stratified(spark, sf_dir, "m_r", 5)


def _deltas_sql() -> str:
    def one(tag: str, epoch: int) -> str:
        return f"SELECT (SELECT avg({_GAP}) FROM scored WHERE epoch = {epoch}) AS brier_{tag}, (SELECT sum(rel) FROM m1 WHERE epoch = {epoch}) AS rel_{tag}, (SELECT avg(ece) FROM m1 WHERE epoch = {epoch}) AS ece_{tag}"

    gains = ", ".join(f"round({k}_raw, 6) AS {k}_raw, round({k}_new, 6) AS {k}_new, round({k}_raw - {k}_new, 6) AS {k}_gain, round(100 * ({k}_raw - {k}_new) / {k}_raw, 6) AS {k}_gain_pct" for k in ("brier", "rel", "ece"))
    return f"WITH {MURPHY_SQL}, a AS ({one('raw', 0)}), b AS ({one('new', 7)}) SELECT {gains} FROM a, b"


@query("a31_calibration_deltas", _deltas_sql())
def calibration_deltas(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(C.deltas(rows.where("epoch = 0"), rows.where("epoch = 7")))


_W = "(1.0::DOUBLE / p_spec)"


@query("a10_weight_diagnostics", f"WITH {SEL_SQL}, w AS (SELECT {_W} AS w FROM sel WHERE S = 1) SELECT count(*) AS n, round(min(w), 6) AS w_min, round(quantile_cont(w, 0.5), 6) AS w_median, round(quantile_cont(w, 0.95), 6) AS w_p95, round(max(w), 6) AS w_max, round(avg(w), 6) AS w_mean, round(stddev_pop(w), 6) AS w_std, round(stddev_pop(w) / avg(w), 6) AS cv, round(sum(w) * sum(w) / sum(w * w), 6) AS ess, round(sum(w) * sum(w) / sum(w * w) / count(*), 6) AS ess_fraction FROM w")
def weight_diagnostics(spark, sf_dir):
    return rounded(W.weight_diagnostics(selected(spark, sf_dir).where("S = 1").withColumn("w", 1.0 / F.col("p_spec"))))


def _balance_sql() -> str:
    def one(f: str) -> str:
        u, v = f"(avg({f}) FILTER (S = 1) - avg({f})) / stddev_pop({f})", f"(sum({_W} * {f}) FILTER (S = 1) / sum({_W}) FILTER (S = 1) - avg({f})) / stddev_pop({f})"
        return f"SELECT '{f}' AS feature, round({u}, 6) AS smd_unweighted, round({v}, 6) AS smd_weighted, round(abs({u}) - abs({v}), 6) AS reduction FROM sel HAVING stddev_pop({f}) > 0"

    return f"WITH {SEL_SQL} " + " UNION ALL ".join(map(one, ("hostgal_photoz", "distmod", "mwebv", "hostgal_photoz_err")))


@query("a11_covariate_balance", _balance_sql().replace("HAVING stddev_pop(hostgal_photoz_err) > 0", "HAVING stddev_pop(hostgal_photoz_err) > 1e-12"))
def balance(spark, sf_dir):
    return rounded(W.balance(selected(spark, sf_dir).withColumn("w", 1.0 / F.col("p_spec")), ["hostgal_photoz", "distmod", "mwebv", "hostgal_photoz_err"]))


@query("a12_positivity", f"WITH {SEL_SQL} SELECT count(*) AS n, count(*) FILTER (hostgal_photoz > 1.5) AS n_affected, round(100.0::DOUBLE * count(*) FILTER (hostgal_photoz > 1.5) / count(*), 6) AS pct_affected, round(coalesce(min(hostgal_photoz) FILTER (hostgal_photoz > 1.5), 1.5::DOUBLE), 6) AS z_min, round(coalesce(max(hostgal_photoz) FILTER (hostgal_photoz > 1.5), 1.5::DOUBLE), 6) AS z_max, 0.1::DOUBLE AS p_low, round(0.1::DOUBLE + (0.8::DOUBLE - 0.1::DOUBLE) / (1 + exp((1.5::DOUBLE - 0.5::DOUBLE) / 0.15::DOUBLE)), 6) AS p_high FROM sel")
def positivity(spark, sf_dir):
    return rounded(W.positivity(selected(spark, sf_dir)))


def _study(rows, spark, sf_dir):
    """Rows of the study's classes: what novelty is fitted to. All objects are not broadcast, however small their file is."""
    return rows.join(metadata(spark, sf_dir).where("true_target <> 15").select("object_id").hint("merge"), "object_id", "left_semi")


def _fit_sql(features: tuple[str, ...], where: str) -> str:
    cells = ", ".join(f"coalesce(avg({f}), 0) AS m_{f}, CASE WHEN count({f}) = 0 THEN 1.0::DOUBLE ELSE greatest(coalesce(stddev_samp({f}), 0.000001::DOUBLE), 0.000001::DOUBLE) END AS s_{f}" for f in features)
    return f"fit AS (SELECT {cells} FROM train WHERE {where})"


def _score_sql(features: tuple[str, ...]) -> str:
    total = " + ".join(f"coalesce((({f} - m_{f}) / s_{f}) * (({f} - m_{f}) / s_{f}), 0)" for f in features)
    have = " + ".join(f"({f} IS NOT NULL)::INT" for f in features)
    return f"CASE WHEN ({have}) = 0 THEN 0.0::DOUBLE ELSE sqrt(({total}) / ({have})) END"


@query("a7_novelty_fit", f"WITH {WIDE_SQL}, train AS (SELECT w.* FROM wide w JOIN meta USING (object_id) WHERE true_target <> 15), {_fit_sql(N.SUBSPACES[2.0], 'epoch = 2')} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(m_{f}, 6) AS mean, round(s_{f}, 6) AS std FROM fit" for f in N.SUBSPACES[2.0]))
def novelty_fit(spark, sf_dir):
    fitted = N.fit(_study(wide(spark, sf_dir), spark, sf_dir).where("epoch = 2"), list(N.SUBSPACES[2.0]))
    return rounded(spark.createDataFrame([(f, float(m), float(s)) for f, (m, s) in fitted.items()], "feature string, mean double, std double"))


def _epoch_novelty_sql(epoch: float) -> str:
    f = N.SUBSPACES[epoch]
    return f"WITH {WIDE_SQL}, train AS (SELECT w.* FROM wide w JOIN meta USING (object_id) WHERE true_target <> 15), {_fit_sql(f, f'epoch = {epoch}')} SELECT object_id, round({_score_sql(f)}, 6) AS novelty FROM wide, fit WHERE epoch = {epoch}"


def _epoch_novelty(spark, sf_dir, epoch: float):
    rows = kept(wide(spark, sf_dir).where(F.col("epoch") == epoch), "representations")  # fitted to and scored
    return rounded(N.epoch_scores(_study(rows, spark, sf_dir), rows, epoch).select("object_id", "novelty"))


@query("a8_novelty_score", _epoch_novelty_sql(2.0))
def novelty_score(spark, sf_dir):
    return _epoch_novelty(spark, sf_dir, 2.0)


@query("m5_epoch_novelty", _epoch_novelty_sql(7.0))
def epoch_novelty(spark, sf_dir):
    return _epoch_novelty(spark, sf_dir, 7.0)


@query("m6_held_out_novelty", f"WITH {WIDE_SQL}, train AS (SELECT w.* FROM wide w JOIN meta USING (object_id) WHERE true_target <> 15), {_fit_sql(N.SUBSPACES[0.0], 'epoch = 0')} SELECT object_id, round({_score_sql(N.SUBSPACES[0.0]).replace('hostgal_photoz', 'w.hostgal_photoz').replace('m_w.', 'm_').replace('s_w.', 's_')}, 6) AS novelty FROM wide w JOIN meta USING (object_id), fit WHERE epoch = 0 AND true_target = 15")
def held_out_novelty(spark, sf_dir):
    rows = wide(spark, sf_dir).join(metadata(spark, sf_dir).select("object_id", "true_target").hint("merge"), "object_id")
    return rounded(N.epoch_scores(rows.where("true_target <> 15"), P.held_out(rows, 15), 0.0).select("object_id", "novelty"))


@query("a9_novelty_scale", f"WITH {SCORED_SQL} SELECT round(stddev_pop(novelty), 6) AS scale FROM scored WHERE epoch = 2 AND S = 1")
def novelty_scale(spark, sf_dir):
    return rounded(spark.createDataFrame([(N.scale(scored(spark, sf_dir).where("epoch = 2 and S = 1")),)], "scale double"))


@query("f6_fused_score", f"WITH {SCORED_SQL}, s AS (SELECT stddev_pop(novelty) AS scale FROM scored WHERE epoch = 2 AND S = 1) SELECT object_id, round(p_64 + 0.05::DOUBLE * novelty / scale, 6) AS score FROM scored, s WHERE epoch = 2")
def fused(spark, sf_dir):
    rows = scored(spark, sf_dir).where("epoch = 2")
    return rounded(rows.select("object_id", fused_score(F.col("p_64"), F.col("novelty"), N.scale(rows.where("S = 1")), 0.05).alias("score")))


@query("a32_exceedance", f"WITH {SCORED_SQL}, t AS (SELECT quantile_cont(novelty, 0.95) AS threshold FROM scored WHERE epoch = 2 AND S = 1) SELECT round(threshold, 6) AS threshold, count(*) AS n, round(100.0::DOUBLE * avg((novelty > threshold)::INT), 6) AS pct_above FROM scored, t WHERE epoch = 2 AND S = 0 GROUP BY threshold")
def exceedance(spark, sf_dir):
    rows = scored(spark, sf_dir).where("epoch = 2")
    return rounded(N.exceedance(rows.where("S = 1"), rows.where("S = 0")))


def _auc_sql(rows: str) -> str:
    """Columns of the AUC query over rows (grp, x, hit)."""
    return f"""g AS (SELECT grp, x, sum(hit) AS tp, sum(1 - hit) AS fp FROM ({rows}) GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER (PARTITION BY grp ORDER BY x DESC) AS ctp, sum(fp) OVER (PARTITION BY grp ORDER BY x DESC) AS cfp FROM g),
a AS (SELECT grp, sum(tp)::BIGINT AS n_pos, sum(fp)::BIGINT AS n_neg, sum(fp * (ctp - tp / 2.0::DOUBLE)) AS wins, sum(tp * (ctp / (ctp + cfp))) AS ap FROM c GROUP BY grp)"""


_AUC_OUT = "n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(wins / (n_pos::DOUBLE * n_neg), 6) END AS roc_auc, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(ap / n_pos, 6) END AS avg_precision"


@query("a23_roc_auc", f"WITH {SCORED_SQL}, {_auc_sql('SELECT epoch AS grp, p_64 AS x, (y = 64)::INT AS hit FROM scored')} SELECT grp AS epoch, {_AUC_OUT} FROM a")
def roc_auc(spark, sf_dir):
    return rounded(D.auc(scored(spark, sf_dir).withColumn("hit", (F.col("y") == 64).cast("long")), "p_64", by=("epoch",)))


@query("a24_average_precision_ties", f"WITH {SCORED_SQL}, {_auc_sql('SELECT epoch AS grp, round(p_95, 2) AS x, (y = 95)::INT AS hit FROM scored')} SELECT grp AS epoch, {_AUC_OUT} FROM a")
def average_precision_ties(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("hit", (F.col("y") == 95).cast("long")).withColumn("x", F.round("p_95", 2))
    return rounded(D.auc(rows, "x", by=("epoch",)))


@query("a23_auc_labels", f"WITH {_auc_sql('SELECT 0 AS grp, n_chars::DOUBLE AS x, quality AS hit FROM documents JOIN labels USING (doc_id)')} SELECT {_AUC_OUT} FROM a")
def auc_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("long").alias("hit"))
    return rounded(D.auc(rows, "x"))


_SUBSETS = {"all": "true", "n_det>1": "n_det_total > 1", "n_pb>1": "n_det_passbands > 1", "both": "n_det_total > 1 AND n_det_passbands > 1"}
_SUBSET_SQL = " UNION ALL ".join(f"SELECT ''{k}'' AS grp, w.hostgal_photoz AS x, (true_target = 90)::INT AS hit FROM wide w JOIN meta USING (object_id) WHERE epoch = 2 AND ({c})".replace("''", "'") for k, c in _SUBSETS.items())


@query("p14_completeness_auc", f"WITH {WIDE_SQL}, {_auc_sql(_SUBSET_SQL)} SELECT grp AS subset, {_AUC_OUT} FROM a")
def completeness_auc(spark, sf_dir):
    rows = wide(spark, sf_dir).where("epoch = 2").join(metadata(spark, sf_dir).select("object_id", "true_target").hint("merge"), "object_id")
    return rounded(D.auc(D.completeness(rows.withColumn("hit", (F.col("true_target") == 90).cast("long"))), "hostgal_photoz", by=("subset",)))


QUERIES, ORACLE = query.queries, query.oracle
