"""Light curves that lie together by object: tables bucketed and sorted by their key, whose scans need no exchange.

A table is written once under an explicit path, in `buckets` files' worth of hash buckets, each sorted. Joins of tables of
equal bucketing, and groupings and windows by the key (or by more columns than it), then run where the rows lie. The catalog
entry is the session's own; the files outlive it and are opened again by their path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Colocated:
    """A bucketed table at a path: `write` makes one, `open` finds one again; close() forgets the catalog entry, not the files."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: tuple[str, ...], buckets: int):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets
        self.name = f"colocated_{uuid.uuid4().hex}"
        lines = ", ".join(f"`{c}`" for c in (key, *order))
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({lines}) INTO {buckets} BUCKETS LOCATION '{path}'")

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, order: tuple[str, ...] = (), buckets: int = 64) -> Colocated:
        """One shuffle by the key, so that each bucket is one file; files that were at the path are replaced."""
        spark, name = df.sparkSession, f"colocated_{uuid.uuid4().hex}"
        rows = df.repartition(buckets, F.col(key))
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # of an explicit path: the files stay
        return cls(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), key, order, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def of_objects(observations: Colocated, meta: Colocated) -> DataFrame:
    """Semi join of two co-located tables, bucket by bucket: neither side moves, whatever their sizes."""
    if (observations.buckets, observations.key) != (meta.buckets, meta.key):
        raise ValueError("tables of different buckets or keys are not co-located")
    return observations.rows().join(meta.rows().select(meta.key).hint("merge"), meta.key, "left_semi")


def exchanges(df: DataFrame) -> int:
    """Shuffles and broadcasts of the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:*()0123456789").startswith(("Exchange", "BroadcastExchange", "ReusedExchange")) for line in plan.splitlines())
