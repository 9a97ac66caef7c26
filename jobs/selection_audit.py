"""Selection audit of labelled texts: what labelling has kept of each language, and how far the labelled texts have shifted.

    python -m jobs.selection_audit --documents PATH --labels PATH --out DIR [--config FILE]

All documents are the true population, those with a label the biased one. <out> is a table (item, part, metric, value)
partitioned by lang:

- part "source": documents, labelled ones, retention, shift of the source's share of the language, and the weight that
  gives the labelled documents the sources of the population again;
- part "feature" (length in characters, words and lines): means, Cohen's d, Kolmogorov-Smirnov statistic with its p-value,
  Wasserstein distance, and the standardized difference of means without and with these weights;
- part "weights": effective number of labelled documents, and its share.

Every run audits all documents and replaces the partitions of all languages, so that a rerun gives the same table.
"""

from __future__ import annotations

from argparse import Namespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from skytriage.operators import population as P
from skytriage.operators import shift as S

from .common import command_line, log, settings

NAME = "selection_audit"
TABLE = "item string, part string, metric string, value double, lang string"


def measure(name: str) -> Column:
    """A length of the column text."""
    if name == "chars":
        return F.char_length("text")
    if name == "words":
        return F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    if name == "lines":
        return F.when(F.col("text") == "", 0).otherwise(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    raise ValueError(f"no feature {name}")


def measured(documents: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """A narrow row for each document, with S = 1 if it has a label. A missing language is und, a missing source none."""
    named = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c)).alias(c)
    texts = documents.select(F.col("doc_id").alias("object_id"), named("lang", "und"), named("source", "none"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = texts.select("object_id", "lang", "source", *(measure(f).cast("double").alias(f) for f in features))
    return P.membership(narrow, labels.where("doc_id is not null").select(F.col("doc_id").alias("object_id")))


def long(df: DataFrame, part: str, item: str | None, metrics: list[str]) -> DataFrame:
    name = F.col(item) if item else F.lit("all")
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")
    return df.select(name.alias("item"), F.lit(part).alias("part"), "lang", cells).select("item", "part", "x.metric", "x.value", "lang")


def audit(rows: DataFrame, features: list[str], least_rows: int = 1) -> DataFrame:
    """The audit's rows of narrow documents. Languages with fewer than `least_rows` labelled documents have their sources only."""
    sources = rows.groupBy("lang", "source").agg(F.count("*").alias("n_true"), F.sum("S").alias("n_biased"))
    total = sources.groupBy("lang").agg(F.sum("n_true").alias("t"), F.sum("n_biased").alias("b"))
    share_t, share_b = F.col("n_true") / F.col("t"), F.try_divide("n_biased", "b")
    sources = sources.join(total, "lang").select("lang", "source", "n_true", "n_biased", (F.col("n_biased") / F.col("n_true")).alias("retention"), (share_b - share_t).alias("shift"), F.try_divide(share_t, share_b).alias("weight"))

    enough = total.where(F.col("b") >= least_rows).select("lang")
    own = rows.join(enough, "lang", "left_semi").join(sources.select("lang", "source", "weight"), ["lang", "source"])
    each = S.long_features(own, features, ["lang", "S", "weight"])
    one = F.col("S") == 1
    by = ("lang", "feature")
    means = each.groupBy(*by).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("std"), F.avg(F.when(one, F.col("x"))).alias("u"), (F.sum(F.when(one, F.col("weight") * F.col("x"))) / F.sum(F.when(one, F.col("weight")))).alias("v"))
    means = means.select(*by, F.try_divide(F.col("u") - F.col("m"), "std").alias("smd"), F.try_divide(F.col("v") - F.col("m"), "std").alias("smd_weighted"))
    ks = S.ks(each, "x", by=by).withColumn("p_value", S.ks_p_value(F.col("ks"), F.col("n_true"), F.col("n_biased")))
    found = ks.join(S.wasserstein(each, "x", by=by), list(by)).join(S.cohens_d(each, "x", by=by), list(by)).join(means, list(by))

    w = F.when(one, F.col("weight"))
    weights = own.groupBy("lang").agg(F.sum(w).alias("s1"), F.sum(w * w).alias("s2"), F.sum("S").alias("n_biased"))
    weights = weights.select("lang", (F.col("s1") * F.col("s1") / F.col("s2")).alias("ess"), (F.col("s1") * F.col("s1") / F.col("s2") / F.col("n_biased")).alias("ess_fraction"))

    out = long(sources, "source", "source", ["n_true", "n_biased", "retention", "shift", "weight"])
    out = out.unionByName(long(found, "feature", "feature", ["n_true", "n_biased", "mean_true", "mean_biased", "cohens_d", "ks", "p_value", "wasserstein", "smd", "smd_weighted"]))
    return out.unionByName(long(weights, "weights", None, ["ess", "ess_fraction"]))


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> DataFrame:
    """Audits the documents at one path by the labels at another into the table `out`, and returns it read back."""
    config = config or settings(NAME)
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    rows = measured(docs, marks, config["features"]).persist(StorageLevel.DISK_ONLY)  # the texts are read once; narrow rows lie with the executors
    try:
        log.info("read %d documents of %s, %d labelled by %s", rows.count(), documents, rows.where("S = 1").count(), labels)
        audit(rows, config["features"], config["least_rows"]).repartition("lang").sortWithinPartitions("lang", "part", "item", "metric").write.mode("overwrite").partitionBy("lang").parquet(out)
    finally:
        rows.unpersist()
    found = spark.read.schema(TABLE).parquet(out)
    log.info("wrote %d rows of %d languages to %s", found.count(), found.select("lang").distinct().count(), out)
    return found


def main(spark: SparkSession, args: Namespace, config: dict) -> None:
    run(spark, args.documents, args.labels, args.out, config)


if __name__ == "__main__":
    command_line(NAME, __doc__.split("\n")[0], {"documents": "Parquet of documents", "labels": "Parquet of labels", "out": "folder of the audit"}, main)
