"""Approximate vector search: random hyperplane cells, probed instead of a full scan.

A chunk lies in the cell given by the signs of ``bits`` projections. A question probes
the cells that differ from its own in the least certain signs; all cells are the exact
search. Stored partitioned by ``cell``, a search reads only the probed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom import settings as S
from noteloom.functions.nearest import NearestVectors
from noteloom.operators.retrieval import _matrix
from noteloom.operators.scoring import merge_top, score_all

_SEED = 7


@dataclass(frozen=True)
class CellShape:
    """What an index was built with; keep it beside the table."""

    dimension: int
    bits: int = 12

    def planes(self) -> np.ndarray:
        return np.random.default_rng(_SEED).standard_normal((self.dimension, self.bits))


def build_cells(chunks: DataFrame, shape: CellShape) -> DataFrame:
    """``chunks`` with their ``cell``. Write it partitioned by ``cell`` to prune scans."""
    planes = shape.planes()
    schema = T.StructType([*chunks.schema.fields, T.StructField("cell", T.LongType(), False)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(shape.bits, dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), "chunks")
            cell = ((vectors @ planes > 0) @ powers) if len(vectors) else np.zeros(0, dtype=np.int64)
            yield batch.append_column("cell", pa.array(cell, pa.int64()))

    return chunks.mapInArrow(assign, schema)


def _flips(margin: np.ndarray) -> Iterator[int]:
    """Sets of signs to flip, as bits, by the margin that they give up, the empty set first.

    From each set two follow: its last sign joined by the next one, or replaced by it.
    """
    order = np.argsort(margin, kind="stable")
    yield 0
    waiting = [(float(margin[order[0]]), 0, 1 << int(order[0]))]
    while waiting:
        cost, last, flips = heappop(waiting)
        yield flips
        if last + 1 < len(order):
            bit, more = 1 << int(order[last + 1]), float(margin[order[last + 1]])
            heappush(waiting, (cost + more, last + 1, flips | bit))
            heappush(waiting, (cost + more - float(margin[order[last]]), last + 1, flips ^ (1 << int(order[last])) | bit))


def probed_cells(projection: np.ndarray, probes: int) -> list[int]:
    """The ``probes`` cells nearest to a question, or all there are."""
    own = sum(1 << i for i, p in enumerate(projection) if p > 0)
    return [own ^ f for f in islice(_flips(np.abs(projection)), probes)]


def _cell_kernel(planes: np.ndarray, probes: int, top_n: int):
    def kernel(questions: pa.Table, batches: Iterator[pa.RecordBatch]):
        query = _matrix(questions["embedding"], "questions")
        ids = questions["question_id"].to_numpy()
        askers: dict[int, list[int]] = {}
        for q, projection in enumerate(query @ planes if len(query) else []):
            for cell in probed_cells(projection, probes):
                askers.setdefault(cell, []).append(q)
        who = {cell: np.array(q) for cell, q in askers.items()}
        best = NearestVectors(query, top_n)
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            vectors = _matrix(batch.column("embedding"), "chunks") if batch.num_rows else np.zeros((0, len(planes)))
            chunk_ids = batch.column("chunk_id").to_numpy()
            for cell in np.unique(cells):
                if int(cell) in who:
                    rows = np.flatnonzero(cells == cell)
                    best.update(vectors[rows], chunk_ids[rows], who[int(cell)])
        q, chunk, score = best.rows()
        yield ids[q], chunk, score

    return kernel


def search_cells(
    questions: DataFrame, cells: DataFrame, shape: CellShape, top_n: int = S.VECTOR_TOP_N, probes: int = 16
) -> DataFrame:
    """Approximate cosine top-N: (question_id, chunk_id, similarity, vector_rank)."""
    planes = shape.planes()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), "questions") if batch.num_rows else np.zeros((0, len(planes)))
            found = {c for p in vectors @ planes for c in probed_cells(p, probes)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["cell"])

    # At most 2^bits numbers. As values of a filter they choose the partitions that are read.
    wanted = [r.cell for r in questions.select("embedding").mapInArrow(probe, "cell bigint").distinct().collect()]
    scored = score_all(
        questions.select("question_id", "embedding"),
        cells.where(F.col("cell").isin(wanted)).select("chunk_id", F.col("cell").cast("bigint"), "embedding"),
        _cell_kernel(planes, probes, top_n),
    )
    return merge_top(scored, top_n, "vector_rank").withColumnRenamed("score", "similarity")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    found = exact.join(approximate.select("question_id", "chunk_id", F.lit(1).alias("f")), ["question_id", "chunk_id"], "left")
    return found.agg(F.avg(F.coalesce("f", F.lit(0))).alias("recall"))
