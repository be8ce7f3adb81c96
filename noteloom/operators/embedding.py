"""Embedding jobs: a user-supplied embedder run over partitions in fixed batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom import settings as S

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class TransientEmbeddingError(RuntimeError):
    """A failure worth retrying; every other failure stops the job at once."""


class EmbeddingContractError(ValueError):
    """The embedder returned the wrong number, dimension or kind of vectors."""


def letter_profile(texts: Sequence[str]) -> list[list[float]]:
    """A deterministic embedder: how often each ASCII letter occurs, ignoring case."""
    out = []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        count = np.bincount(raw, minlength=256)
        out.append((count[65:91] + count[97:123]).astype(np.float64).tolist())
    return out


def _checked(embedder: Embedder, texts: list[str], dimension: int, retries: int, pause: float) -> np.ndarray:
    """One batch through the embedder; only transient failures of this batch repeat."""
    for attempt in range(retries + 1):
        try:
            vectors = embedder(texts)
            break
        except TransientEmbeddingError:
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    if len(vectors) != len(texts):
        raise EmbeddingContractError(f"expected {len(texts)} vectors, got {len(vectors)}")
    if any(len(v) != dimension for v in vectors):
        raise EmbeddingContractError(f"every vector must have {dimension} components")
    out = np.asarray(vectors, dtype=np.float64)
    if not np.isfinite(out).all():
        raise EmbeddingContractError("vectors must be finite")
    return out


def embed(
    df: DataFrame, text_column: str, embedder: Embedder, dimension: int = S.EMBED_DIMENSION,
    batch_size: int = S.EMBED_BATCH, retries: int = S.EMBED_RETRIES, pause_seconds: float = 0.5,
) -> DataFrame:
    """``df`` with an ``embedding`` column.

    Only the text goes to Python, in Arrow batches that are cut into embedder batches. The
    column is marked as not repeatable, so the optimizer never evaluates it twice, and a
    scan that does not use it does not evaluate it at all.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        parts = [
            _checked(embedder, texts[i : i + batch_size], dimension, retries, pause_seconds)
            for i in range(0, len(texts), batch_size)
        ]
        values = np.concatenate(parts).ravel() if parts else np.zeros(0)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64()))

    return df.withColumn("embedding", run.asNondeterministic()(F.col(text_column)))


def embed_distinct(
    questions: DataFrame, text_column: str, embedder: Embedder, dimension: int = S.EMBED_DIMENSION, **options
) -> DataFrame:
    """Embed each distinct text once and give the vector to every row that has it."""
    once = embed(questions.select(text_column).distinct(), text_column, embedder, dimension, **options)
    return questions.join(once, text_column)
