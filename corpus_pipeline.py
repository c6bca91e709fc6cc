"""From raw documents to packed training sequences, each stage written and read again.

Stages take (spark, docs, sf_dir) and return a frame. All but the last return
the columns of their input; the rows they drop are gone for later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotide.llm import decontaminate, exact, near, packing, quality
from heliotide.llm.arrow import remainder
from heliotide.session import cut_lineage


#: Near copies in the stage: five words and 80 %; operator 2 by itself has its own values.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold of the quality classifier (operator 1).

    The model learns from the labelled rows of ``docs`` that are not held out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    vectors = quality.statistics_of(docs.join(F.broadcast(_sampled(labels)), "doc_id", "left_semi"))
    known = cut_lineage(vectors).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return quality.accepted(docs, quality.fit(known))


def _sampled(labels: DataFrame) -> DataFrame:
    """Ids of at most about ``quality.FIT_ROWS`` labelled rows, by the hash of the id."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    share = min(1.0, quality.FIT_ROWS / max(1, ids.count()))
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts (operator 7)."""
    return exact.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near duplicates (operator 2); each row is judged by its own text."""
    return near.without_copies(docs, NEAR_SIZE, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark (operator 6)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (operator 10)."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Classifier, shingle join and tokenizer have no SQL form; the rows are tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
