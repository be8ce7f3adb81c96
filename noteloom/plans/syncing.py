"""Queries of the jobs that keep a published index in step with its sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.lines import line_chunks
from noteloom.operators.syncing import rebuild_index as rebuild_job
from noteloom.operators.syncing import sync_index
from noteloom.plans import inputs as I
from noteloom.session import checkpoint_root
from noteloom.sources.table_set import TableSet, content_digest, copy_tables, create_set

# doc_id % 7: 1 the index is a version behind; 2 touched; 3 the file is gone; 4 edited; 5 a source
# waits; 6 only in the catalogue. doc_id % 17 = 0: only in the index.
def _n() -> Column:
    return F.col("doc_id") % 7


def _path(tag: str) -> Column:
    return F.concat(F.col("source"), F.lit(f"/{tag}-"), F.col("doc_id").cast("string"))


def chunker(documents: DataFrame) -> DataFrame:
    return line_chunks(documents, "kb_id")


def published(spark: SparkSession, d: str) -> TableSet:
    """An index over the documents as it was published before some sources changed."""
    docs = I.spread(I.table(spark, d, "documents").select("doc_id", "source", "text", "n_chars"))
    title = F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("title")
    kb, zero = F.col("source").alias("kb_id"), F.lit(0).alias("created_at")

    def record(tag: str, extra: str):
        text = F.concat(F.lit(extra), F.col("text"))
        return F.struct(
            _path(tag).alias("path"), F.sha2(text, 256).alias("content_hash"), F.length(text).cast("bigint").alias("char_count"),
            F.octet_length(text).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"))

    catalogue = docs.filter(F.col("doc_id") % 17 != 0).select(
        "doc_id", kb, title, F.lit(2).cast("bigint").alias("ingest_version"), record("v1", "").alias("active"),
        F.when(_n() == 5, record("v2", "new ")).alias("pending"), zero, F.lit(0).alias("updated_at"))
    old = docs.filter(_n() != 6).withColumn("text", F.when(_n() == 1, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    waits = lambda value: F.when((_n() == 5), value)
    documents = old.select(
        "doc_id", kb, title, F.when(_n() == 1, 1).otherwise(2).cast("bigint").alias("ingest_version"), _path("v1").alias("file_path"),
        F.sha2("text", 256).alias("content_hash"), F.length("text").cast("bigint").alias("char_count"),
        waits(_path("v2")).alias("pending_file_path"), waits(F.sha2(F.concat(F.lit("new "), "text"), 256)).alias("pending_content_hash"),
        waits(F.length("text").cast("bigint") + 4).alias("pending_char_count"), zero, F.lit("ready").alias("status"),
        F.size(F.split("text", "\n")).cast("bigint").alias("chunk_count"))
    root = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    return create_set(root, {"catalogue": catalogue, "documents": documents, "chunks": chunker(old.select("doc_id", kb, "text"))}, buckets=16)


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """The files as they are now, the waiting ones too."""
    docs = I.table(spark, d, "documents").select("doc_id", "source", "text")
    now = docs.filter(_n() != 3).select(
        _path("v1").alias("path"), F.when(_n() == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"),
        F.when(_n().isin(2, 4), 2).otherwise(1).cast("bigint").alias("mtime_ns"))
    waiting = docs.filter(_n() == 5).select(
        _path("v2").alias("path"), F.concat(F.lit("new "), "text").cast("binary").alias("content"), F.lit(1).cast("bigint").alias("mtime_ns"))
    return now.unionByName(waiting).withColumn("size", F.octet_length("content").cast("bigint"))


def state(index: TableSet) -> DataFrame:
    """Each document with the hash of its chunks put together, as the published tables have them."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c.content), "\n")
    chunks = index.table("chunks").groupBy("doc_id").agg(F.sha2(joined, 256).alias("chunks_hash"), F.count(F.lit(1)).alias("n_chunks"))
    return index.table("documents").join(chunks, "doc_id", "left").select(
        "doc_id", "ingest_version", "content_hash", "chunk_count", "n_chunks", "chunks_hash")


def _synced(spark: SparkSession, d: str, force: bool) -> DataFrame:
    index, plan, _ = sync_index(published(spark, d), source_files(spark, d), chunker, force)
    times = index.table("catalogue").select("doc_id", F.col("active.mtime_ns").alias("source_time"))
    return plan.select("doc_id", "action").join(state(index), "doc_id", "left").join(times, "doc_id", "left")


def sync_apply(spark: SparkSession, d: str) -> DataFrame:
    """What was done with each document, and its record and chunks as published afterwards."""
    return _synced(spark, d, False)


def forced_reindex(spark: SparkSession, d: str) -> DataFrame:
    """The same with every document that is not blocked built again."""
    return _synced(spark, d, True)


def rebuild_index(spark: SparkSession, d: str) -> DataFrame:
    """All documents of the catalogue, built anew from their sources; missing files are put back first."""
    index = published(spark, d)
    lost = I.table(spark, d, "documents").filter(_n() == 3).select(
        _path("v1").alias("path"), F.col("text").cast("binary").alias("content"), F.lit(1).cast("bigint").alias("mtime_ns"),
        F.octet_length("text").cast("bigint").alias("size"))
    return state(rebuild_job(index, source_files(spark, d).unionByName(lost), chunker))


def copied_tables(spark: SparkSession, d: str) -> DataFrame:
    """Three tables copied, checked by digest and published together, against their sources."""
    index = published(spark, d)
    tables = {name: index.table(name) for name in index.folders}
    copy = copy_tables(tables, f"{checkpoint_root(spark)}/copy-{uuid.uuid4().hex}", buckets=8)
    parts = []
    for name, df in tables.items():
        both = content_digest(df).join(content_digest(copy.table(name)).withColumnRenamed("digest", "copied"), "n_rows", "left")
        parts.append(both.select(F.lit(name).alias("table_name"), "n_rows", F.col("digest").eqNullSafe(F.col("copied")).alias("equal")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (sync_apply, forced_reindex, rebuild_index, copied_tables)}

_STATE = """
d AS (SELECT *, doc_id % 7 AS n, doc_id % 17 = 0 AS loose FROM documents),
p AS (
  SELECT *, CASE WHEN loose OR n IN (3, 6) THEN 'blocked' WHEN n = 4 THEN 'reindex' WHEN n = 1 THEN 'resume'
    {force} WHEN n = 2 THEN 'refresh' ELSE 'skip' END AS action FROM d WHERE NOT (loose AND n = 6)),
t AS (
  SELECT doc_id, n, loose, action, CASE WHEN n = 6 THEN NULL WHEN n = 1 AND action = 'blocked' THEN 'old ' || text
    WHEN action = 'reindex' AND n = 4 THEN text || '!' ELSE text END AS now FROM p)
SELECT doc_id, action, CASE WHEN n = 6 THEN NULL WHEN action = 'reindex' THEN 3 WHEN n = 1 AND action = 'blocked' THEN 1 ELSE 2 END::BIGINT AS ingest_version,
  sha256(now) AS content_hash, len(string_split(now, chr(10)))::BIGINT AS chunk_count, len(string_split(now, chr(10)))::BIGINT AS n_chunks,
  sha256(now) AS chunks_hash,
  CASE WHEN loose THEN NULL WHEN n IN (2, 4) THEN 2 ELSE 1 END::BIGINT AS source_time
FROM t"""

ORACLES = {
    "sync_apply": "WITH " + _STATE.format(force=""),
    "forced_reindex": "WITH " + _STATE.format(force="WHEN TRUE THEN 'reindex'"),
    "rebuild_index": """
WITH t AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 5 THEN 'new ' || text WHEN 4 THEN text || '!' ELSE text END AS now FROM documents WHERE doc_id % 17 <> 0)
SELECT doc_id, 3::BIGINT AS ingest_version, sha256(now) AS content_hash, len(string_split(now, chr(10)))::BIGINT AS chunk_count,
  len(string_split(now, chr(10)))::BIGINT AS n_chunks, sha256(now) AS chunks_hash FROM t""",
    "copied_tables": """
SELECT 'catalogue' AS table_name, count(*) AS n_rows, true AS equal FROM documents WHERE doc_id % 17 <> 0
UNION ALL SELECT 'documents', count(*), true FROM documents WHERE doc_id % 7 <> 6
UNION ALL SELECT 'chunks', sum(len(string_split(text, chr(10))))::BIGINT, true FROM documents WHERE doc_id % 7 <> 6""",
}
