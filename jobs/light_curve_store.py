"""Incremental light-curve store: new photometry of study objects is filed by object, and its as-of features are made anew.

    python -m jobs.light_curve_store --events DIR --customers PATH --out DIR [--config FILE]

A file stream with a checkpoint takes the files that no earlier run has taken. Of each batch

- rows that break a rule of observations go to <out>/refused/batch=<n>, with the rules;
- rows of study objects go to <out>/store/batch=<n>/bucket=<b>, b being a hash of the object;
- buckets that the batch touches, and only they, have their features computed from all their stored rows and replaced in
  <out>/features/bucket=<b>.

Late rows are no special case: an object's first detection is found among all its rows. A batch that is repeated after a
failure writes the same folders again, so nothing is counted twice, and a run without new files writes nothing. The
checkpoint lies in <out>/checkpoint and belongs to the store: remove both or none. Objects change class only for batches
that come later.
"""

from __future__ import annotations

from argparse import Namespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytriage.config import FeatureConfig
from skytriage.operators import asof, features
from skytriage.operators import population as P
from skytriage.operators.validate import observation_rules
from skytriage.plans.views import objects, photometry

from .common import command_line, log, settings

NAME = "light_curve_store"
STORED = "object_id long, mjd double, passband int, flux double, flux_err double, detected_bool int, batch long, bucket int"


def watched(path: str) -> str:
    """A pattern of that one path, since a stream lists a lone file only by a pattern; a folder's files are listed as well."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/[{name[0]}]{name[1:]}" if not set(name) & set("*?[{") else path


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int")


def take(batch: DataFrame, number: int, study: DataFrame, out: str, config: dict) -> None:
    """One batch: file its rows, then renew the features of the buckets it touches."""
    spark = batch.sparkSession
    rows = photometry(batch)
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, (_, bad) in observation_rules().items())))
    judged = rows.withColumn("broken", broken)
    judged.where(F.size("broken") > 0).write.mode("overwrite").parquet(f"{out}/refused/batch={number}")
    sound = P.of_objects(judged.where(F.size("broken") == 0).drop("broken"), study).withColumn("bucket", bucket_of(config["buckets"]))
    sound.repartition("bucket").sortWithinPartitions("bucket", "object_id", "mjd").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/store/batch={number}")

    store = spark.read.schema(STORED).parquet(f"{out}/store")
    new = store.where(F.col("batch") == number)
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # `buckets` numbers at most
    log.info("batch %d: %d rows filed in buckets %s, %d refused", number, new.count(), touched, spark.read.parquet(f"{out}/refused/batch={number}").count())
    if not touched:
        return
    held = store.where(F.col("bucket").isin(touched)).drop("batch", "bucket")  # partitions of other buckets are not read
    own = P.with_observations(study, held)
    found = FeatureConfig(snr_threshold=config["snr_threshold"])
    epochs = tuple(float(e) for e in config["epochs"])
    made = features.representation(own, asof.epoch_sequences(held, epochs, found), epochs, found).withColumn("bucket", bucket_of(config["buckets"]))
    made.repartition("bucket").sortWithinPartitions("object_id", "epoch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/features")
    log.info("batch %d: features of %d buckets renewed in %s/features", number, len(touched), out)


def run(spark: SparkSession, events: str, customers: str, out: str, config: dict | None = None) -> int:
    """Takes what is new under `events` (a Parquet folder, file or pattern) and waits for it; returns the batches taken."""
    config = config or settings(NAME)
    study = P.true_population(objects(spark.read.parquet(customers)), tuple(config["classes"]))
    path = watched(events)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path)
    taken = []

    def each(batch: DataFrame, number: int) -> None:
        take(batch, number, study, out, config)
        taken.append(number)

    log.info("reading %s and %s", path, customers)
    stream = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%d batches taken into %s", len(taken), out)
    return len(taken)


def read_features(spark: SparkSession, out: str) -> DataFrame:
    """The features of all buckets."""
    return spark.read.parquet(f"{out}/features").drop("bucket")


def main(spark: SparkSession, args: Namespace, config: dict) -> None:
    run(spark, args.events, args.customers, args.out, config)


if __name__ == "__main__":
    command_line(NAME, __doc__.split("\n")[0], {"events": "Parquet files of events, a folder that grows", "customers": "Parquet of customers", "out": "folder of the store"}, main)
