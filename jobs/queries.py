"""The jobs as registered queries over the whole tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytriage.operators.features import FEATURES
from skytriage.query_features import WIDE_SQL, r6
from skytriage.registry import Registry, rounded
from skytriage.sources.shared import shared_base

from . import light_curve_store, selection_audit

query = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one. Its files stay."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


_TAIL = "list_sum(list_transform(range(1, 41), lambda k: 2.0::DOUBLE * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * t * t)))"
_SOURCE = ["n_true", "n_biased", "retention", "shift", "weight"]
_FEATURE = ["n_true", "n_biased", "mean_true", "mean_biased", "cohens_d", "ks", "p_value", "wasserstein", "smd", "smd_weighted"]


def _long_sql(table: str, part: str, item: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT lang, '{part}' AS part, {item} AS item, '{m}' AS metric, round({m}::DOUBLE, 6) + 0.0 AS value FROM {table}" for m in metrics)


AUDIT_SQL = f"""WITH r AS (SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN 'und' ELSE lang END AS lang, CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE source END AS source, coalesce(text, '') AS text, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN 1 ELSE 0 END AS S FROM documents),
s0 AS (SELECT lang, source, count(*) AS n_true, sum(S) AS n_biased FROM r GROUP BY ALL),
s AS (SELECT *, n_biased / n_true AS retention, n_biased / nullif(sum(n_biased) OVER l, 0) - n_true / sum(n_true) OVER l AS shift,
  (n_true / sum(n_true) OVER l) / nullif(n_biased / nullif(sum(n_biased) OVER l, 0), 0) AS weight, sum(n_biased) OVER l AS own FROM s0 WINDOW l AS (PARTITION BY lang)),
n AS (SELECT lang, S, weight, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS words,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::DOUBLE AS lines FROM r JOIN s USING (lang, source) WHERE own >= 1),
x AS ({' UNION ALL '.join(f"SELECT lang, '{f}' AS feature, {f} AS x, S, weight FROM n" for f in ('chars', 'words', 'lines'))}),
g AS (SELECT lang, feature, x, count(*)::DOUBLE AS t, sum(S)::DOUBLE AS b FROM x GROUP BY ALL),
d AS (SELECT lang, feature, sum(t) OVER o / sum(t) OVER w AS ft, sum(b) OVER o / sum(b) OVER w AS fb, sum(t) OVER w AS nt, sum(b) OVER w AS nb, coalesce(lead(x) OVER o - x, 0) AS step FROM g WINDOW w AS (PARTITION BY lang, feature), o AS (PARTITION BY lang, feature ORDER BY x)),
k AS (SELECT lang, feature, max(nt) AS n_true, max(nb) AS n_biased, max(abs(ft - fb)) AS ks, sum(abs(ft - fb) * step) AS wasserstein FROM d GROUP BY ALL),
p AS (SELECT *, (sqrt(n_true * n_biased / (n_true + n_biased)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n_true * n_biased / (n_true + n_biased))) * ks AS t FROM k),
m AS (SELECT lang, feature, count(*) AS n1, sum(S) AS n2, var_samp(x) AS v1, var_samp(x) FILTER (S = 1) AS v2, avg(x) AS mean_true, avg(x) FILTER (S = 1) AS mean_biased, stddev_pop(x) AS std, sum(weight * x) FILTER (S = 1) / sum(weight) FILTER (S = 1) AS v FROM x GROUP BY ALL),
f AS (SELECT lang, feature, n_true, n_biased, mean_true, mean_biased, ks, wasserstein, CASE WHEN t < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_TAIL})) END AS p_value,
  CASE WHEN (n1 - 1) * v1 + (n2 - 1) * v2 > 0 THEN (mean_biased - mean_true) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) ELSE 0.0::DOUBLE END AS cohens_d, (mean_biased - mean_true) / nullif(std, 0) AS smd, (v - mean_true) / nullif(std, 0) AS smd_weighted FROM p JOIN m USING (lang, feature)),
e AS (SELECT lang, sum(weight) FILTER (S = 1) * sum(weight) FILTER (S = 1) / sum(weight * weight) FILTER (S = 1) AS ess, sum(weight) FILTER (S = 1) * sum(weight) FILTER (S = 1) / sum(weight * weight) FILTER (S = 1) / sum(S) AS ess_fraction FROM n GROUP BY 1)
{_long_sql('s', 'source', 'source', _SOURCE)} UNION ALL {_long_sql('f', 'feature', 'feature', _FEATURE)} UNION ALL {_long_sql('e', 'weights', "'all'", ['ess', 'ess_fraction'])}"""


@query("job1_selection_audit", AUDIT_SQL)
def job1_selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1-selection-audit")
    for _ in range(2):
        found = selection_audit.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return rounded(found)


_DOUBLES = [f"{f}{x}" for f in FEATURES for x in ("", "_err")] + ["det_time_span_days"]


@query("job2_light_curve_store", f"WITH {WIDE_SQL} SELECT object_id, epoch, {r6(*_DOUBLES)}, {', '.join(f'{f}_status' for f in FEATURES)}, n_obs_total, n_det_total, n_det_passbands, well_constrained_features, unconstrained_features FROM wide WHERE object_id IN (SELECT object_id FROM obs WHERE passband BETWEEN 0 AND 5 AND mjd IS NOT NULL AND flux IS NOT NULL AND flux_err >= 0) AND object_id IN (SELECT object_id FROM meta WHERE true_target IN (64, 90, 95))")
def job2_light_curve_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2-light-curve-store")
    for _ in range(2):
        light_curve_store.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/customer.parquet", out)
    return rounded(light_curve_store.read_features(spark, out))


QUERIES, ORACLE = query.queries, query.oracle
