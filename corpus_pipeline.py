"""A training corpus from raw documents: five stages, each written and read again by the next.

Every stage takes the documents that the one before has kept. All but the last return the
columns of the documents table; the last returns a row per packed piece. Tests compare each
stage with a plain version; not all stages can be said in SQL, so there is none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noteloom.llm.common import read_table, stored
from noteloom.llm.grouping_pack import pack
from noteloom.llm.pii import mask_pii
from noteloom.llm.probminhash import drop_near_duplicates
from noteloom.llm.risk_rules import keep_documents
from noteloom.llm.rule_ensemble import accept_documents
from noteloom.session import ship_package


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels", "doc_id", "quality")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more."""
    return accept_documents(docs, _labels(ship_package(spark), sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return keep_documents(docs, _labels(ship_package(spark), sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies, the one with the smallest id."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and the length corrected."""
    ship_package(spark)
    return mask_pii(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    ship_package(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
