"""Sources: CSV with declared types, Parquet, several partitions at once. Missing floats come in as null, never as NaN."""

from __future__ import annotations

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .shared import filesystem

METADATA_SCHEMA = StructType([StructField("object_id", LongType()), StructField("hostgal_photoz", DoubleType()), StructField("hostgal_photoz_err", DoubleType()), StructField("true_target", IntegerType())])
OBSERVATION_SCHEMA = StructType([StructField("object_id", LongType()), StructField("mjd", DoubleType()), StructField("passband", IntegerType()), StructField("flux", DoubleType()), StructField("flux_err", DoubleType()), StructField("detected_bool", IntegerType())])
#: Other names of a column, as headers have them.
ALIASES = {"detected": "detected_bool", "target": "true_target"}


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.nanvl(c, F.lit(None).cast(k)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def header(spark: SparkSession, path: str | list[str]) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV files, gzip included, by header names; aliases are renamed, columns that the schema lacks come in as strings.

    Only `columns` (all of them by default) are parsed, which the CSV reader prunes to. A gzip file is one task however
    large; convert() turns it into Parquet once."""
    kinds = {f.name: f.dataType for f in schema.fields}
    found = header(spark, path)
    names = [c if c in kinds else ALIASES.get(c, c) for c in found]
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    df = raw.toDF(*names)
    wanted = [c for c in names if columns is None or c in columns]
    if columns is not None and (lost := set(columns) - set(names)):
        raise ValueError(f"columns missing: {sorted(lost)}")
    out = df.select(*(F.expr(f"try_cast(`{c}` AS {kinds[c].simpleString()})").alias(c) if c in kinds else F.col(c) for c in wanted))
    return nan_to_null(out)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(df.withColumnsRenamed({c: ALIASES[c] for c in df.columns if c in ALIASES and ALIASES[c] not in df.columns}))


def extract_objects(spark: SparkSession, paths: list[str], ids: DataFrame, schema: StructType = OBSERVATION_SCHEMA) -> DataFrame:
    """Observations of some objects over many partition files: one scan of all files and a semi join."""
    return read_csv(spark, paths, schema).join(ids.select("object_id"), "object_id", "left_semi")


def convert(spark: SparkSession, paths: str | list[str], schema: StructType, target: str, columns: list[str] | None = None) -> DataFrame:
    """CSV written once as Parquet, which later scans prune and push filters into."""
    read_csv(spark, paths, schema, columns).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def cached_columns(df: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Columns of df from their Parquet copy, which is written if it is not there or lacks one of them; a scan of it reads
    the columns that are asked for and no others."""
    spark = df.sparkSession
    fs, path = filesystem(folder)
    if fs.get_file_info(f"{path}/_SUCCESS").type != FileType.NotFound:
        there = spark.read.parquet(folder)
        if set(columns) <= set(there.columns):
            return there.select(*columns)
    df.select(*columns).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
