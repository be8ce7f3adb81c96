"""Labels found in the corpus itself: which document holds a passage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.binding import let
from noteloom.functions.topk import RunningTopK
from noteloom.operators.scoring import merge_top, score_all
from noteloom.session import hinted

#: Whole words inside a passage by which its documents are found.
ANCHOR_WORDS = 5


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _anchors(words: Column) -> Column:
    """Fingerprints of all runs of as many words as an anchor has."""
    place = F.sequence(F.lit(0), F.size(words) - ANCHOR_WORDS)
    runs = F.transform(place, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(ANCHOR_WORDS)]))
    return F.when(F.size(words) >= ANCHOR_WORDS, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _containment_kernel(questions: pa.Table, batches: Iterator[pa.RecordBatch]):
    ids = questions["question_id"].to_numpy()
    passages = questions["text"].to_pylist()
    best = RunningTopK(len(ids), 1)
    for batch in batches:
        texts = batch.column("content").to_pylist()
        held = np.array([[p in t for p in passages] for t in texts], dtype=bool).reshape(len(texts), len(ids))
        best.update(held.astype(np.float64), batch.column("chunk_id").to_numpy(), held)
    q, doc, score = best.rows()
    yield ids[q], doc, score


def first_document_with(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """The lowest document id whose whole text holds the passage: (question_id, doc_id).

    Words strictly inside a passage are whole words of a document that holds it, so documents
    and passages meet on a fingerprint of the words after the first one, and only those that meet
    are compared by their texts. Passages too short for that (:func:`short_passages`), if there are
    any, are searched in every text.
    """
    asked = questions.select("question_id", F.col("text").alias("passage"))
    texts = documents.select("doc_id", "text")
    inner = asked.where(~short_passages(F.col("passage"))).select(
        "question_id", "passage", let(_words(F.col("passage")), lambda w: F.xxhash64(*[F.get(w, F.lit(1 + k)) for k in range(ANCHOR_WORDS)])).alias("anchor"))
    runs = texts.select("doc_id", F.explode(let(_words(F.col("text")), _anchors)).alias("anchor"))
    met = runs.join(hinted(inner.select("question_id", "anchor")), "anchor").select("question_id", "doc_id").distinct()
    held = texts.join(hinted(met), "doc_id").join(hinted(asked), "question_id").where(F.contains("text", "passage"))
    found = held.groupBy("question_id").agg(F.min("doc_id").alias("doc_id"))
    short = questions.where(short_passages(F.col("text"))).select("question_id", "text")
    if short.isEmpty():
        return found
    scored = score_all(short, texts.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), _containment_kernel)
    return found.unionByName(merge_top(scored, 1).select("question_id", F.col("chunk_id").alias("doc_id")))


def short_passages(passage: Column) -> Column:
    """Passages with too few inner words for an anchor."""
    return F.size(_words(passage)) < ANCHOR_WORDS + 2
