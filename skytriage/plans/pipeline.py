"""The population pipeline: raw metadata -> validated interim table -> TRUE -> TRUE with the selection, each with a manifest."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import PopulationConfig, SelectionConfig
from ..operators import population, validate
from ..sources import readers, sinks

STAGES = ("interim", "true", "biased")


def run_stage(spark: SparkSession, stage: str, root: str, raw: str | list[str] | None = None, selection: SelectionConfig = SelectionConfig(), classes: PopulationConfig = PopulationConfig()) -> DataFrame:  # noqa: B008
    """Runs one stage on its predecessor's table under root and returns its own. All rows are validated, not a sample."""
    at = {s: f"{root}/{s}.parquet" for s in STAGES}
    if stage == "interim":
        if raw is None:
            raise ValueError("the first stage needs raw files")
        df, parent, config = validate.validate_metadata(readers.read_csv(spark, raw, readers.METADATA_SCHEMA)), None, {}
    elif stage == "true":
        df, parent, config = validate.validate_true_population(population.true_population(spark.read.parquet(at["interim"]))), at["interim"], asdict(classes)
    elif stage == "biased":
        df, parent, config = population.select(validate.check_finite_photoz(spark.read.parquet(at["true"])), selection), at["true"], asdict(selection)
    else:
        raise ValueError(f"no stage {stage}")
    sinks.write_table(df, at[stage])
    out = spark.read.parquet(at[stage])
    sinks.write_json(f"{root}/{stage}.manifest.json", sinks.manifest(stage, at[stage], out, parent, config))
    return out


def run_all(spark: SparkSession, root: str, raw: str | list[str], selection: SelectionConfig = SelectionConfig()) -> DataFrame:  # noqa: B008
    out = None
    for stage in STAGES:
        out = run_stage(spark, stage, root, raw, selection)
    return out
