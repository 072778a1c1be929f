"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Every stage gets all rows its predecessor kept, with the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import common, exact_dedup, packing, quality_classifier, secret_scan, simhash_dedup
from tidepool.llm.queries import BYTE_BPE, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; the labels of the held-out fifth are not learnt."""
    held_out = F.coalesce(common.id_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), where=~held_out)
    return quality_classifier.accepted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every near-duplicate component."""
    return simhash_dedup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with each secret replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("secret scans", secrets), ("best-fit packing", pack)]

#: No SQL: a trained model and a tokenizer take part. Tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.reread(docs, "pipeline-" + name.replace(" ", "-").lower())
    return docs
