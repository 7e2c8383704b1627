"""A corpus pipeline: each stage reads what its predecessor wrote and calls one of the text operators."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from spectrafold.llm import lines, packing, quality, secrets, similar
from spectrafold.llm.queries import packing_files
from spectrafold.scale import shared_dir

# The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Rows are whole texts: a batch of Spark's 10 000 takes some 30 MB, held by the executor and its worker several times over.
BATCH_ROWS = 1000


def _small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones of those it gets."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs.select(*COLUMNS), forest)


@_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and with them documents of which nothing is left."""
    done = lines.dedup_lines(docs.select(*COLUMNS))
    kept = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _recounted(kept, F.col("n_removed") > 0)


@_small_batches
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose five-word shingles have a Jaccard similarity of 0.8 or more to those of an earlier one.

    SimHash fingerprints propose them and an exact check follows; what the fingerprints cannot tell is joined exactly.
    Earlier is a smaller id; documents without one come last and are compared as well.
    """
    return similar.without_near_duplicates(docs.select(*COLUMNS))


@_small_batches
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    done = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("before")))
    return _recounted(done, ~F.col("text").eqNullSafe(F.col("before")))


@_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences with their ids."""
    return packing.pack(docs, *packing_files())


def _recounted(docs: DataFrame, changed) -> DataFrame:
    """n_chars follows a text that was changed."""
    n = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", n).select(*COLUMNS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packed),
]

# Fingerprints, trees, similarity joins and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. Each stage's rows are written to the shared folder before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
