"""Training-text pipeline over `documents`: filter, deduplicate, decontaminate, redact, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import scratch_path
from gridloom.llm import decontaminate, near_copies, packing, pii, quality
from gridloom.shipping import ship_package


#: Texts sent to a Python worker at once; Spark's own 10 000 rows are too many beside whole documents.
BATCH_ROWS = 1_000


def _python_steps(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    SimHash proposes the closest copies, a prefix filter all others.
    """
    _python_steps(spark)
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item contaminates."""
    _python_steps(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced in the text; n_chars, where there is one, follows the new text."""
    clean = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every row."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii_redaction", pii_redaction), ("packing", pack)]
#: Fingerprints, shared prefixes, boosted trees and the dynamic program have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again as the next one's input.

    Empty tables pass through all stages; what a stage does with nulls, ties and repeated rows stands at its operator.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(rows, before)  # the stages set it for themselves
    return docs
