"""The catalogue file: every base and document with its sources, sealed by a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.schemas import CATALOG_DOCUMENTS, KNOWLEDGE_BASES
from noteloom.sources.snapshots import publish, read_current, stage

FORMAT = 1
_SEALED = "kind string, key bigint, format int, payload string, sha256 string"


class CatalogueDamaged(ValueError):
    """A record does not match its checksum."""


def _sorted_json(df: DataFrame) -> F.Column:
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def seal(df: DataFrame, kind: str, key: str) -> DataFrame:
    """One sealed record per row: canonical JSON, its format and its SHA-256."""
    payload = _sorted_json(df)
    return df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), F.lit(FORMAT).alias("format"),
        payload.alias("payload"), F.sha2(payload, 256).alias("sha256"),
    )


def damaged(sealed: DataFrame) -> DataFrame:
    """Records of another format or with a checksum that does not fit."""
    return sealed.filter((F.col("format") != FORMAT) | (F.sha2("payload", 256) != F.col("sha256")))


def write_catalogue(bases: DataFrame, documents: DataFrame, table: str) -> str:
    """Write both record kinds as one snapshot and publish it."""
    spark = bases.sparkSession
    sealed = seal(bases, "base", "kb_id").unionByName(seal(documents, "document", "doc_id"))
    snapshot = stage(sealed, table)
    publish(spark, table, snapshot)
    return snapshot


def read_catalogue(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """Bases and documents; a damaged record stops the read."""
    sealed = read_current(spark, table)
    bad = damaged(sealed).select("kind", "key").first()
    if bad is not None:
        raise CatalogueDamaged(f"{bad['kind']} {bad['key']}")
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "mode": "FAILFAST"}
    parse = lambda kind, schema: sealed.filter(F.col("kind") == kind).select(F.from_json("payload", schema, options).alias("r")).select("r.*")
    return parse("base", KNOWLEDGE_BASES), parse("document", CATALOG_DOCUMENTS)


def export_metadata(bases: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue records from the index tables: bases and documents, never chunks.

    Documents need ``size, mtime_ns`` and ``pending_size, pending_mtime_ns`` of their files.
    """
    active = F.struct(
        F.col("file_path").alias("path"), "content_hash", "char_count", "size", "mtime_ns"
    )
    pending = F.when(
        F.col("pending_file_path").isNotNull(),
        F.struct(
            F.col("pending_file_path").alias("path"), F.col("pending_content_hash").alias("content_hash"),
            F.col("pending_char_count").alias("char_count"), F.col("pending_size").alias("size"),
            F.col("pending_mtime_ns").alias("mtime_ns"),
        ),
    )
    return bases.orderBy("kb_id"), documents.select(
        "doc_id", "kb_id", "title", "ingest_version", active.alias("active"), pending.alias("pending"), "created_at", "updated_at"
    ).orderBy("doc_id")
