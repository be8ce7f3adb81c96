"""Jobs that bring a published index up to date with its sources, or build it anew.

An index is a table set of ``catalogue`` (the record of sources), ``documents`` (what was built
from them) and ``chunks``. Both jobs find out what to build, build it, check it and publish all
three tables with one step of the pointer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators.maintenance import observe, plan_sync, promote_pending, suspects, sync_summary
from noteloom.operators.quality import index_problems
from noteloom.session import checkpointed
from noteloom.sources.table_set import TableSet, create_set

#: Chunks of documents (doc_id, kb_id, text), with doc_id, chunk_index and content at least.
Chunker = Callable[[DataFrame], DataFrame]


def _problems(staged: dict[str, DataFrame]) -> DataFrame:
    """Documents whose chunks do not fit their record, and chunks without a document."""
    documents, chunks = staged["documents"], staged["chunks"]
    numbers = index_problems(chunks, documents).select("doc_id", "code")
    orphans = chunks.join(documents, "doc_id", "left_anti").select("doc_id", F.lit("chunk_without_document").alias("code"))
    return numbers.unionByName(orphans)


def _texts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` (with path) and the text of each file."""
    return wanted.join(files.select("path", F.decode("content", "UTF-8").alias("text")), "path")


def _built(sources: DataFrame, chunker: Chunker) -> tuple[DataFrame, DataFrame]:
    """Document rows and chunks of sources (doc_id, kb_id, title, path, ingest_version, text)."""
    chunks = checkpointed(chunker(sources.select("doc_id", "kb_id", "text")))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = sources.select(
        "doc_id", "kb_id", "title", "ingest_version", F.col("path").alias("file_path"), F.sha2("text", 256).alias("content_hash"),
        F.length("text").cast("bigint").alias("char_count"), F.lit("ready").alias("status"))
    return rows.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), chunks


def _as_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Built rows with the columns of ``documents``; what a build does not set stays as it is there."""
    rest = [f.name for f in documents.schema if f.name not in rows.columns]
    return rows.join(documents.select("doc_id", *rest), "doc_id", "left").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in documents.schema])


def sync_index(index: TableSet, files: DataFrame, chunker: Chunker, force: bool = False) -> tuple[TableSet, DataFrame, DataFrame]:
    """Detect, build, check and publish: the new version, the plan and its summary.

    Files: ``path, size, mtime_ns, content``. Only files whose size or time differ are read to
    be compared, and only sources to be indexed are read for their text. Documents that are
    blocked keep their rows. With ``force`` every document that is not blocked is built again.
    """
    catalogue, documents = index.table("catalogue"), index.table("documents")
    seen = checkpointed(suspects(files.select("path", "size", "mtime_ns"), catalogue))
    looked = observe(seen.filter(F.col("verdict") == "suspect"), files).select("doc_id", "verdict", "observed")
    settled = seen.filter(F.col("verdict") != "suspect").select("doc_id", "verdict")
    observed = checkpointed(looked.unionByName(settled, allowMissingColumns=True))
    plan = checkpointed(plan_sync(catalogue, documents, observed, force))
    doing = plan.filter(F.col("action").isin("reindex", "resume", "refresh")).select("doc_id", "action", "ingest_version")
    building = doing.filter(F.col("action") != "refresh")
    record = catalogue.drop("ingest_version").join(doing, "doc_id").join(observed.select("doc_id", "observed"), "doc_id", "left")
    record = record.withColumn("active", F.coalesce("observed", "active")).drop("observed")
    sources = record.join(building.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "kb_id", "title", F.col("active.path").alias("path"), "ingest_version", "created_at")
    sources = checkpointed(_texts(sources, files))
    rows, chunks = _built(sources, chunker)
    rows = rows.join(sources.select("doc_id", "created_at"), "doc_id")
    built = index.replace(
        building, {"documents": _as_documents(rows, documents), "chunks": chunks, "catalogue": record.join(building.select("doc_id"), "doc_id", "left_semi")},
        _problems)
    refreshed = doing.filter(F.col("action") == "refresh")
    after = built.replace(refreshed, {"catalogue": record.join(refreshed.select("doc_id"), "doc_id", "left_semi")})
    return after, plan, sync_summary(plan)


def rebuild_index(index: TableSet, files: DataFrame, chunker: Chunker) -> TableSet:
    """Build every document of the catalogue from its source, a waiting one first, and publish the whole set.

    A source that is missing, or a document that fails the check, leaves the published version
    as it was.
    """
    catalogue = promote_pending(index.table("catalogue"))
    catalogue = catalogue.withColumn("ingest_version", F.col("ingest_version") + 1)
    sources = catalogue.select("doc_id", "kb_id", "title", F.col("active.path").alias("path"), "ingest_version", "created_at")
    texts = checkpointed(_texts(sources, files))
    rows, chunks = _built(texts, chunker)
    rows = rows.join(texts.select("doc_id", "created_at"), "doc_id")

    def problems(staged: dict[str, DataFrame]) -> DataFrame:
        missing = staged["catalogue"].join(staged["documents"], "doc_id", "left_anti")
        return _problems(staged).unionByName(missing.select("doc_id", F.lit("source_missing").alias("code")))

    documents = index.table("documents")
    blank = documents.select(*[(F.col("doc_id") if f.name == "doc_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in documents.schema])
    tables = {"catalogue": catalogue, "documents": _as_documents(rows, blank), "chunks": chunks}
    return create_set(index.root, tables, index.key, index.buckets, problems)
