"""A training corpus from raw documents: quality rules, one document of each near-duplicate group, no secrets, packing.

STAGES lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's docs. All but the last return the columns of the documents they were given, in
their order, whatever further columns these have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytriage.llm.common import ready, shared_folder, table, tokenizer_path
from skytriage.llm.ngram_join import ngram_groups
from skytriage.llm.packing import pack
from skytriage.llm.quality import kept_documents
from skytriage.llm.secret_scan import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; each row is judged by its own text, where it lies."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 the document of the smallest id stays; repeated rows of it are one.

    Rows are told apart by id and text, so an id may stand in several groups: each group keeps one row, the one of the
    smallest id and then of the least hash of its text. Documents without words are groups of their own. Rows with a null id
    cannot be named by a group, and stay."""
    groups = ngram_groups(docs, width=5, percent=80).where("doc_id is not null")
    first = groups.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.doc_id", "x.h")
    first = first.unionByName(groups.where("group is null").select("doc_id", "h")).toDF("_first", "_hash").distinct()
    columns = docs.columns  # renamed by place, so that none can clash
    k, text = (f"_in{columns.index(c)}" for c in ("doc_id", "text"))
    rows = docs.toDF(*(f"_in{i}" for i in range(len(columns))))
    same = (F.col(k) == F.col("_first")) & (F.xxhash64(text) == F.col("_hash"))
    kept = rows.where(F.col(k).isNotNull()).join(first, same, "left_semi")
    if not groups.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([k, text])
    return kept.unionByName(rows.where(F.col(k).isNull())).toDF(*columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are put out of the texts, as [kind]; n_chars, where there is one, follows."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the last stage's rows are the pipeline's."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("secret scans", secret_stage), ("packing", packing_stage)]

#: A fitted classifier and a tokenizer decide, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
