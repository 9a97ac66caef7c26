"""Queries that write a sink and give what is read back from it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .config import SelectionConfig, load_yaml
from .functions.scalars import selection_probability
from .operators import calibration as C
from .operators import population as P
from .plans.views import META_SQL, OBS_SQL, POP_SQL, SCORED_SQL, SEL_SQL, metadata, observations, population, scored, selected
from .query_features import r6
from .registry import Registry, rounded
from .sources import download, readers, sinks
from .sources.shared import shared_folder

query = Registry()


@query("s6_gzip_csv_round_trip", f"WITH {POP_SQL} SELECT object_id, {r6('hostgal_photoz', 'hostgal_photoz_err')}, true_target FROM pop WHERE true_target IN (64, 90, 95)")
def gzip_csv(spark, sf_dir):
    """The TRUE table as gzip CSV files with a header, read again by declared types."""
    folder = shared_folder(spark, "interim-csv")
    rows = P.true_population(population(spark, sf_dir)).select("object_id", "hostgal_photoz", "hostgal_photoz_err", "true_target")
    sinks.write_table(rows, folder, "csv")
    return rounded(readers.read_csv(spark, folder, readers.METADATA_SCHEMA))


@query("s12_parallel_download", f"WITH {OBS_SQL} SELECT passband, count(*) AS n, round(sum(flux), 4) AS total_flux, count(DISTINCT object_id) AS n_objects FROM obs GROUP BY ALL")
def downloaded(spark, sf_dir):
    """Partitions fetched by URL in parallel tasks (files of the shared folder stand for a server), then read as one table."""
    folder = shared_folder(spark, "raw")
    columns = [f.name for f in readers.OBSERVATION_SCHEMA.fields]
    sinks.write_table(observations(spark, sf_dir).select(columns).repartition(6, "object_id"), f"{folder}/served", "csv")
    fetched = download.fetch_all(spark, sorted(download.urls_of(f"{folder}/served")), f"{folder}/raw")
    paths = [r.target for r in fetched.collect()]
    rows = readers.read_csv(spark, paths, readers.OBSERVATION_SCHEMA)
    return rounded(rows.groupBy("passband").agg(F.count("*").alias("n"), F.sum("flux").alias("total_flux"), F.count_distinct("object_id").alias("n_objects")), 4)


@query("s7_cached_columns", f"WITH {OBS_SQL} SELECT object_id, {r6('mjd', 'flux')} FROM obs")
def cached(spark, sf_dir):
    """Columns written at the first call and read at the second."""
    folder, obs = shared_folder(spark, "columns"), observations(spark, sf_dir)
    readers.cached_columns(obs, folder, ["object_id", "mjd", "flux", "passband"])
    return rounded(readers.cached_columns(obs.limit(0), folder, ["object_id", "mjd", "flux"]))


@query("s8_manifest", f"WITH {SEL_SQL} SELECT 'rows' AS name, count(*)::DOUBLE AS value FROM sel UNION ALL SELECT 'class ' || true_target, count(*)::DOUBLE FROM sel GROUP BY true_target UNION ALL SELECT 'retention ' || coalesce(true_target::VARCHAR, 'overall'), round(sum(S) / count(*), 6) FROM sel GROUP BY ROLLUP (true_target) UNION ALL SELECT 'digests agree', 1.0::DOUBLE")
def manifest(spark, sf_dir):
    """A stage's table and manifest; the digest in the manifest is taken again from the files."""
    folder = shared_folder(spark, "manifest")
    sinks.write_table(selected(spark, sf_dir), f"{folder}/table")
    table = spark.read.parquet(f"{folder}/table")
    sinks.write_json(f"{folder}/manifest.json", sinks.manifest("biased", f"{folder}/table", table))
    found = json.loads(sinks.read_text(f"{folder}/manifest.json"))
    out = [("rows", float(found["rows"])), *((f"class {k}", float(v)) for k, v in found["classes"].items()), *((f"retention {k}", float(v["retention"])) for k, v in found["selection"].items())]
    out.append(("digests agree", float(found["sha256"] == sinks.table_digest(spark, f"{folder}/table"))))
    return spark.createDataFrame(out, "name string, value double")


_GAP = " + ".join(f"(p_{c} - (y = {c})::INT) * (p_{c} - (y = {c})::INT)" for c in (64, 90, 95))


@query("s10_metrics_json", f"WITH {SCORED_SQL} SELECT epoch::VARCHAR AS epoch, S::VARCHAR AS S, count(*) AS n, round(avg({_GAP}), 6) AS brier FROM scored GROUP BY epoch, S")
def metrics_json(spark, sf_dir):
    folder = shared_folder(spark, "metrics")
    sinks.write_json(f"{folder}/brier.json", sinks.metrics(C.brier(scored(spark, sf_dir), ("epoch", "S")), "epoch", "S"))
    found = json.loads(sinks.read_text(f"{folder}/brier.json"))
    return rounded(spark.createDataFrame([(e, s, v["n"], v["brier"]) for e, x in found.items() for s, v in x.items()], "epoch string, S string, n long, brier double"))


@query("s11_yaml_settings", f"WITH {POP_SQL} SELECT object_id, round(0.2::DOUBLE + (0.9::DOUBLE - 0.2::DOUBLE) / (1 + exp((hostgal_photoz - 0.6::DOUBLE) / 0.1::DOUBLE)), 6) AS p_spec FROM pop")
def yaml_settings(spark, sf_dir):
    """Selection with settings that come from a YAML file."""
    folder = shared_folder(spark, "settings")
    sinks.write_text(f"{folder}/selection.yaml", "seed: 7\np_floor: 0.2\np_bright: 0.9\nz_50: 0.6\nw_z: 0.1\n")
    config = load_yaml(f"{folder}/selection.yaml", SelectionConfig)
    return rounded(population(spark, sf_dir).select("object_id", selection_probability(F.col("hostgal_photoz"), config).alias("p_spec")))


_REPORT = "SELECT '# Classes' AS line UNION ALL SELECT '## Balance' UNION ALL SELECT '| true_target | n | share |' UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || true_target || ' | ' || count(*) || ' | ' || printf('%.4f', count(*)::DOUBLE / (SELECT count(*) FROM meta)) || ' |' FROM meta GROUP BY true_target"


@query("s14_markdown_report", f"WITH {META_SQL} {_REPORT}")
def report(spark, sf_dir):
    """Lines of a written report that are not empty."""
    folder, meta = shared_folder(spark, "report"), metadata(spark, sf_dir)
    rows = P.class_balance(meta).withColumn("share", F.col("n") / meta.count())
    sinks.write_text(f"{folder}/report.md", sinks.markdown("Classes", {"Balance": rows}))
    return spark.createDataFrame([(x,) for x in sinks.read_text(f"{folder}/report.md").splitlines() if x], "line string")


QUERIES, ORACLE = query.queries, query.oracle
