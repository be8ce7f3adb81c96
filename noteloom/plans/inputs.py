"""The given tables in the roles of the data model."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.embedding import embed, letter_profile
from noteloom.operators.lines import line_chunks
from noteloom.operators.postings import Postings, build_postings
from noteloom.session import checkpoint_root

LETTERS = 26
_DERIVED: dict[tuple, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share when the input has fewer splits than there are cores.

    One small file is one split. Inputs of many splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; the source is the knowledge base."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kb_id"), "text"))


def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as chunks."""
    return line_chunks(notes(spark, sf_dir), "kb_id")


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], Any]) -> Any:
    """What an index job derives from the documents: made once for an application, and again when their files change."""
    meta = table(spark, sf_dir, "documents").select(
        "_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at"))
    files = meta.distinct().agg(F.sum(F.xxhash64("file_path", "file_size", "at").cast("decimal(38,0)")).alias("files")).first()
    key = (spark.sparkContext.applicationId, what, sf_dir, files.files)
    if key not in _DERIVED:
        _DERIVED[key] = make()
    return _DERIVED[key]


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with their vectors as a chunk table: a search reads the columns it needs."""
    def make() -> str:
        path = f"{checkpoint_root(spark)}/lines-{uuid4().hex}"
        embedded_lines(spark, sf_dir).write.parquet(path)
        return path

    return spark.read.parquet(_once(spark, sf_dir, "lines", make))


def line_postings(spark: SparkSession, sf_dir: str, kind: str = "text") -> Postings:
    """The inverted file of the document lines."""
    return _once(spark, sf_dir, f"postings of {kind}", lambda: build_postings(note_lines(spark, sf_dir), kind))


def embedded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with their vectors."""
    return embed(note_lines(spark, sf_dir), "content", letter_profile, LETTERS, batch_size=4096)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions over all knowledge bases."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.lit(None).cast("string").alias("kb_id"), "text"
    )


def scoped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; every second one asks a single knowledge base."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("kb_id"),
        "text",
    )


def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(questions(spark, sf_dir), "text", letter_profile, LETTERS, batch_size=4096)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as chunks; the label is the document."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
