"""Uploads over a stream of files: decided once, repeated arrivals skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.operators.maintenance import decide_reupload
from noteloom.session import checkpoint_root
from noteloom.sources.intake import intake
from noteloom.sources.snapshots import current_path, publish, read_current, stage

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """New files of a folder as they arrive."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(folder)


def accepted_uploads(files: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Accepted files, each (title, content) once within the watermark."""
    checked = intake(files.withWatermark("modificationTime", lateness)).filter(F.col("reason").isNull())
    return checked.select("title", "content_hash", "char_count", "text", "modificationTime").dropDuplicatesWithinWatermark(
        ["title", "content_hash"]
    )


def rejected_uploads(files: DataFrame) -> DataFrame:
    """Files that do not become documents, with the reason."""
    return intake(files).filter(F.col("reason").isNotNull()).select("path", "title", "reason", "modificationTime")


def new_documents(documents: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows for titles without a document, waiting for their first processing.

    Ids follow the largest one in the order of the titles; only the new titles of one batch
    are numbered. Columns that an upload does not tell are null.
    """
    fresh = latest.join(documents.select("title"), "title", "left_anti")
    top = documents.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.orderBy("title"))
    named = fresh.withColumn("number", number).join(F.broadcast(top)).withColumn("doc_id", (F.col("top") + F.col("number")).cast("bigint"))
    known = {
        "doc_id": F.col("doc_id"), "title": F.col("title"), "status": F.lit("pending"), "ingest_version": F.lit(1), "chunk_count": F.lit(0),
        "pending_file_path": F.concat(F.lit("candidates/"), F.col("doc_id").cast("string"), F.lit("-v1")),
        "pending_content_hash": F.col("u.content_hash"), "pending_char_count": F.col("u.char_count"),
    }
    return named.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in documents.schema])


def apply_uploads(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """Document rows after a batch of uploads; the last upload of a document counts.

    Documents need the columns of :func:`decide_reupload` and ``title``. A new title becomes a
    new document.
    """
    by_title = uploads.groupBy("title").agg(F.max_by(F.struct("content_hash", "char_count"), "modificationTime").alias("u"))
    latest = by_title.join(documents.select("title", "doc_id"), "title").select(
        "doc_id", F.col("u.content_hash").alias("new_hash"), F.col("u.char_count").alias("new_chars")
    )
    decided = decide_reupload(latest, documents).select(
        "doc_id", "outcome", "next_status", "next_version", "new_hash", "new_chars"
    )
    j = documents.join(decided, "doc_id", "left")
    o = F.coalesce(F.col("outcome"), F.lit("unchanged"))
    starts = o.isin("replace", "retry")
    path = F.concat(F.lit("candidates/"), F.col("doc_id").cast("string"), F.lit("-v"), F.col("next_version").cast("string"))
    pending = lambda column, value: (
        F.when(starts, value).when(o != "cancel_pending", F.col(column)).alias(column)
    )
    changed = {
        "status": F.coalesce("next_status", "status").alias("status"),
        "ingest_version": F.coalesce("next_version", "ingest_version").cast("bigint").alias("ingest_version"),
        "pending_file_path": pending("pending_file_path", F.when(o == "retry", F.col("file_path")).otherwise(path)),
        "pending_content_hash": pending("pending_content_hash", F.col("new_hash")),
        "pending_char_count": pending("pending_char_count", F.col("new_chars")),
    }
    return j.select(*[changed.get(c, F.col(c)) for c in documents.columns]).unionByName(new_documents(documents, by_title))


def run_rejects(files: DataFrame, rejects: str, checkpoint: str | None = None):
    """Append every rejected file of a stream to the table at ``rejects``, once."""
    place = checkpoint or f"{checkpoint_root(files.sparkSession)}/rejects"
    return rejected_uploads(files).writeStream.format("parquet").option("path", rejects).option(
        "checkpointLocation", place).trigger(availableNow=True).start()


def run_uploads(files: DataFrame, table: str, checkpoint: str | None = None, on_batch: Callable[[DataFrame], None] | None = None):
    """Keep the document table of ``table`` up to date with a stream of files.

    Each batch writes a new snapshot and then moves the pointer. A batch that is replayed
    after a failure finds its content already pending and changes nothing.
    """
    spark = files.sparkSession
    place = checkpoint or f"{checkpoint_root(spark)}/uploads"

    def batch(frame: DataFrame, _: int) -> None:
        after = apply_uploads(read_current(frame.sparkSession, table), frame)
        if on_batch is not None:
            on_batch(after)
        publish(frame.sparkSession, table, stage(after, table))

    if current_path(spark, table) is None:
        raise FileNotFoundError(f"{table} has no published snapshot")
    return accepted_uploads(files).writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start()
