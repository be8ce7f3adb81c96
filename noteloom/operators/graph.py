"""Document graph: which documents have chunks that are close to each other.

All knowledge bases are built in one job. Chunks: ``chunk_id, doc_id, kb_id,
chunk_index, embedding``. Documents: ``doc_id, kb_id, title, char_count``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions.nearest import NearestVectors
from noteloom.operators.retrieval import _matrix


def _checked(max_chunks: int | None) -> int | None:
    if max_chunks is not None and max_chunks <= 0:
        raise ValueError("max_chunks must be greater than zero")
    return max_chunks


def chunk_pool(chunks: DataFrame, max_chunks: int) -> DataFrame:
    """Round-robin sample per knowledge base: first chunks of all documents, then second ones.

    Only the first ``max_chunks`` ranks of a document can enter the pool, so both
    windows keep a bounded number of rows per group before they shuffle.
    """
    size = _checked(max_chunks)
    in_document = Window.partitionBy("kb_id", "doc_id").orderBy("chunk_index", "chunk_id")
    in_base = Window.partitionBy("kb_id").orderBy("chunk_rank", "doc_id")
    return (
        chunks.withColumn("chunk_rank", F.row_number().over(in_document))
        .filter(F.col("chunk_rank") <= size)
        .withColumn("pool_rank", F.row_number().over(in_base))
        .filter(F.col("pool_rank") <= size)
    )


#: A base of a few blocks is dealt into more, so that it is not left to a few tasks.
_SMALL_BLOCK = 2048


def blocks_of(rows: Column, block_rows: int) -> Column:
    """Into how many blocks a base of so many rows is dealt; each row is sent to every block of its base."""
    return F.greatest(F.ceil(rows / block_rows), F.least(F.ceil(rows / _SMALL_BLOCK), F.lit(4))).cast("int")


def _nearest(top_k: int):
    names = ["source_chunk", "target_chunk", "source_doc", "target_doc", "similarity"]

    def nearest(sources: pa.Table, targets: pa.Table) -> pa.Table:
        (a, of_a, x), (b, of_b, y) = (
            (t["chunk_id"].to_numpy(), t["doc_id"].to_numpy(), _matrix(t["embedding"], "graph") if t.num_rows else np.zeros((0, 0))) for t in (sources, targets))
        order = np.argsort(b, kind="stable")
        best = NearestVectors(x, top_k)
        if len(a) and len(b):
            # Targets by their places in the order of ids: ties go to the smaller id.
            best.update(y[order], np.arange(len(b)), allowed=lambda q, rows: of_a[q][:, None] != of_b[order][None, rows])
        s, t, v = best.rows()
        t = order[t]
        return pa.Table.from_arrays([pa.array(c) for c in (a[s], b[t], of_a[s], of_b[t], v)], names=names)

    return nearest


def graph_pairs(
    chunks: DataFrame, top_k: int = S.GRAPH_TOP_K, min_similarity: float = S.GRAPH_MIN_SIMILARITY,
    max_chunks: int | None = None, block_rows: int = 16_384,
) -> DataFrame:
    """Nearest chunks of other documents of the same base; the threshold applies after the top-k.

    All chunks take part, or the pool of ``max_chunks`` per base. Each base is dealt into blocks
    of about ``block_rows``, a smaller one into a few of 2048; a task compares one block with one other and keeps
    ``top_k`` of each chunk, and the best of all blocks are kept at the end. The search is exact, so its
    work grows with the square of a base; use :mod:`ann` cells where that is too much.
    """
    if block_rows <= 0:
        raise ValueError("block_rows must be greater than zero")
    pool = chunks if _checked(max_chunks) is None else chunk_pool(chunks, max_chunks)
    pool = pool.select("kb_id", "chunk_id", "doc_id", "embedding")
    blocks = pool.groupBy("kb_id").agg(blocks_of(F.count(F.lit(1)), block_rows).alias("blocks"))
    dealt = pool.join(blocks, "kb_id").withColumn("own", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = ["kb_id", "chunk_id", "doc_id", "embedding"]
    # Renamed, as both sides of the cogroup come from one table.
    sources = dealt.select(*[F.col(c).alias(c) for c in rows], F.col("own").alias("a"), F.col("other").alias("b"))
    targets = dealt.select(*[F.col(c).alias(c) for c in rows], F.col("other").alias("a"), F.col("own").alias("b"))
    found = sources.groupBy("kb_id", "a", "b").cogroup(targets.groupBy("kb_id", "a", "b")).applyInArrow(
        _nearest(top_k), "source_chunk bigint, target_chunk bigint, source_doc bigint, target_doc bigint, similarity double")
    best = Window.partitionBy("source_chunk").orderBy(F.desc("similarity"), "target_chunk")
    kept = found.withColumn("_rank", F.row_number().over(best)).where((F.col("_rank") <= top_k) & (F.col("similarity") >= min_similarity))
    return kept.join(pool.select(F.col("chunk_id").alias("source_chunk"), "kb_id"), "source_chunk").select(
        "kb_id", "source_chunk", "target_chunk", "source_doc", "target_doc", "similarity")


def graph_nodes(documents: DataFrame, chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """Documents with their number of chunks; ``truncated`` when the base exceeds ``max_chunks``.

    Chunks are counted per document before the join.
    """
    size = _checked(max_chunks)
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    nodes = documents.join(counted, "doc_id", "left").select(
        "kb_id", "doc_id", "title", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
        F.col("char_count").alias("chars"),
    )
    totals = nodes.groupBy("kb_id").agg((F.lit(False) if size is None else F.sum("chunks") > size).alias("truncated"))
    return nodes.join(totals, "kb_id")


def graph_edges(pairs: DataFrame) -> DataFrame:
    """One edge per unordered pair of documents, with weights relative to the strongest edge.

    A single link counts half; from two links on the mean similarity counts in full.
    """
    edge = pairs.groupBy(
        "kb_id", F.least("source_doc", "target_doc").alias("source"),
        F.greatest("source_doc", "target_doc").alias("target"),
    ).agg(F.count(F.lit(1)).alias("links"), F.avg("similarity").alias("similarity"))
    raw = edge.withColumn("raw", F.col("similarity") * F.least(F.lit(1.0), F.col("links") / 2))
    strongest = raw.groupBy("kb_id").agg(F.max("raw").alias("top"))
    top = F.col("top")
    return raw.join(strongest, "kb_id").select(
        "kb_id", "source", "target",
        F.bround(F.col("raw") / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0)), 4).alias("weight"),
        "links", F.bround("similarity", 4).alias("similarity"),
    )


def build_graph(
    documents: DataFrame, chunks: DataFrame, top_k: int = S.GRAPH_TOP_K,
    min_similarity: float = S.GRAPH_MIN_SIMILARITY, max_chunks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every knowledge base. A base with one document has no edges."""
    return (
        graph_nodes(documents, chunks, max_chunks),
        graph_edges(graph_pairs(chunks, top_k, min_similarity, max_chunks)),
    )


def edge_counts(
    chunks: DataFrame, thresholds: tuple[float, ...] = S.GRAPH_THRESHOLD_PRESETS,
    top_k: int = S.GRAPH_TOP_K, max_chunks: int | None = None,
) -> DataFrame:
    """Edges per threshold, and whether the number fell strictly against the threshold before.

    The neighbours are found once, at the lowest threshold.
    """
    pairs = graph_pairs(chunks, top_k, min(thresholds), max_chunks)
    presets = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    edges = (
        pairs.withColumn("threshold", F.explode(F.filter(presets, lambda t: t <= F.col("similarity"))))
        .select(
            "kb_id", "threshold", F.least("source_doc", "target_doc").alias("a"),
            F.greatest("source_doc", "target_doc").alias("b"),
        )
        .distinct()
        .groupBy("kb_id", "threshold").agg(F.count(F.lit(1)).alias("edges"))
    )
    every = chunks.select("kb_id").distinct().select("kb_id", F.explode(presets).alias("threshold"))
    w = Window.partitionBy("kb_id").orderBy("threshold")
    filled = every.join(edges, ["kb_id", "threshold"], "left").withColumn(
        "edges", F.coalesce("edges", F.lit(0)).cast("bigint")
    )
    return filled.withColumn(
        "strictly_fewer", F.coalesce(F.col("edges") < F.lag("edges").over(w), F.lit(True))
    )
