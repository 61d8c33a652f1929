"""The corpus pipeline: five stages, each over all that its predecessor kept, written as Parquet between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, kneser, minhash, packing, pii, wordbpe
from tessera.llm.common import materialize, table

#: The stage's similarity; op5 has its own, 85.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps; rows without a doc_id cannot be named and stay.

    Null and empty texts are rejected.  Of rows that share a doc_id all go if one is rejected.  Without usable labels
    every text stays; columns of any name are kept.
    """
    bad = kneser.classify(docs, table(spark, sf_dir, "labels")).where("not kept").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component at 80 percent, by full five-word shingle sets.

    Ties do not occur (the smallest doc_id stays); rows that share a kept doc_id, null ids and texts without words all stay.
    """
    return minhash.keep_first(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, an empty benchmark removes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; rows, null texts among them, all stay."""
    return pii.redact(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their place in packed sequences; a null text is the end id alone."""
    return packing.pack(docs, wordbpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit),
]

#: Trained models, iterative components and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
