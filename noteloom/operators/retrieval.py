"""The two retrieval channels, their fusion, and the hybrid search of a question batch.

Question tables have ``question_id bigint, kb_id (null = all), text string`` and, for
the vector channel, ``embedding array<double>``. Chunk tables have ``chunk_id bigint,
doc_id, kb_id, content`` and ``embedding``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions.nearest import NearestVectors
from noteloom.functions.topk import RunningTopK
from noteloom.operators.postings import Postings, bm25_hits, build_postings, folded_grams, gram_statistics, word_hits
from noteloom.session import checkpointed
from noteloom.operators.scoring import MAX_BROADCAST_QUESTIONS, STRIPE_ROWS, merge_top, score_all

def _in_scope(questions: pa.Table, batch: pa.RecordBatch) -> np.ndarray:
    """``[row, question]``: the question covers all knowledge bases or this row's."""
    shape = (batch.num_rows, questions.num_rows)
    if "kb_id" not in questions.column_names or "kb_id" not in batch.schema.names:
        return np.ones(shape, dtype=bool)
    wanted = questions["kb_id"].to_pylist()
    everywhere = np.array([w is None for w in wanted], dtype=bool)
    out = np.broadcast_to(everywhere, shape).copy()
    if not everywhere.all():
        have = batch.column("kb_id").dictionary_encode()
        place = {v: i for i, v in enumerate(have.dictionary.to_pylist())}
        row = have.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for q, w in enumerate(wanted):
            if w is not None:
                out[:, q] = row == place.get(w, -2)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, what: str) -> np.ndarray:
    """A list column as a float64 matrix; every row must be finite and equally long."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(values) == 0:
        return np.zeros((0, 0))
    lengths = pc.list_value_length(values)
    dimension = lengths[0].as_py()
    if values.null_count or not dimension or pc.any(pc.not_equal(lengths, dimension)).as_py():
        raise ValueError(f"{what}: vectors are missing or differ in dimension; rebuild the index")
    out = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(values), dimension)
    if not np.isfinite(out).all():
        raise ValueError(f"{what}: vectors hold values that are not finite; rebuild the index")
    return out


def _scope_codes(questions: pa.Table, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers of the bases that questions ask (-1 for all) and that rows lie in; None if no question names one."""
    if "kb_id" not in questions.column_names or "kb_id" not in batch.schema.names:
        return None
    wanted = questions["kb_id"].to_pylist()
    if all(w is None for w in wanted):
        return None
    have = batch.column("kb_id").dictionary_encode()
    place = {v: i for i, v in enumerate(have.dictionary.to_pylist())}
    asked = np.array([-1 if w is None else place.get(w, -2) for w in wanted], dtype=np.int32)
    return asked, have.indices.fill_null(-3).to_numpy(zero_copy_only=False).astype(np.int32)


def _vector_kernel(top_n: int):
    def kernel(questions: pa.Table, batches: Iterator[pa.RecordBatch]):
        query = _matrix(questions["embedding"], "questions")
        ids = questions["question_id"].to_numpy()
        best = NearestVectors(query, top_n)
        for batch in batches:
            if batch.num_rows == 0 or len(ids) == 0:
                continue
            vectors = _matrix(batch.column("embedding"), "chunks")
            if vectors.shape[1] != query.shape[1]:
                raise ValueError("question and chunk vectors differ in dimension; rebuild the index")
            chunk_ids = batch.column("chunk_id").to_numpy()
            codes = _scope_codes(questions, batch)
            if codes is None:
                best.update(vectors, chunk_ids)
                continue
            asked, base = codes
            for code in np.intersect1d(asked, np.append(base, -1)):
                rows = slice(None) if code == -1 else base == code
                best.update(vectors[rows], chunk_ids[rows], np.flatnonzero(asked == code))
        q, chunk, score = best.rows()
        yield ids[q], chunk, score

    return kernel


def search_vector(
    questions: DataFrame, chunks: DataFrame, top_n: int = S.VECTOR_TOP_N,
    max_questions: int = MAX_BROADCAST_QUESTIONS, stripe_rows: int = STRIPE_ROWS,
) -> DataFrame:
    """Exact cosine top-N: (question_id, chunk_id, similarity, vector_rank)."""
    scope_q = ["kb_id"] if "kb_id" in questions.columns else []
    scope_c = ["kb_id"] if "kb_id" in chunks.columns else []
    scored = score_all(
        questions.select("question_id", *scope_q, "embedding"),
        chunks.select("chunk_id", *scope_c, "embedding"),
        _vector_kernel(top_n), max_questions, stripe_rows,
    )
    return merge_top(scored, top_n, "vector_rank").withColumnRenamed("score", "similarity")


# ---------------------------------------------------------------- keyword search


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _literal_kernel(top_n: int):
    def kernel(questions: pa.Table, batches: Iterator[pa.RecordBatch]):
        ids = questions["question_id"].to_numpy()
        needles = [_ascii_lower(t) for t in questions["literal"].to_pylist()]
        best = RunningTopK(len(ids), top_n)
        for batch in batches:
            texts = [_ascii_lower(t or "") for t in batch.column("content").to_pylist()]
            matched = np.array([[n in t for n in needles] for t in texts], dtype=bool).reshape(len(texts), len(needles))
            best.update(np.zeros(matched.shape), batch.column("chunk_id").to_numpy(), matched & _in_scope(questions, batch))
        q, chunk, score = best.rows()
        yield ids[q], chunk, score

    return kernel


def search_literal(questions: DataFrame, chunks: DataFrame, top_n: int = S.KEYWORD_TOP_N) -> DataFrame | None:
    """Chunks that hold a question too short for a trigram (ASCII case ignored), by id; None if no question is so short."""
    scope_q = ["kb_id"] if "kb_id" in questions.columns else []
    scope_c = ["kb_id"] if "kb_id" in chunks.columns else []
    short = questions.filter(F.size(folded_grams(F.col("text"))) == 0).select("question_id", *scope_q, F.trim("text").alias("literal"))
    short = short.filter(F.col("literal") != "")
    if short.isEmpty():
        return None
    scored = score_all(short, chunks.select("chunk_id", *scope_c, "content"), _literal_kernel(top_n))
    return merge_top(scored, top_n, "keyword_rank")


def keyword_statistics(chunks: DataFrame) -> DataFrame:
    """Index-wide counts for BM25: (gram, df, tokens).

    One row per trigram with the number of chunks that hold it. The row whose gram is
    the empty string has the number of chunks as ``df`` and all trigrams as ``tokens``. An index
    of postings has these counts beside it.
    """
    return gram_statistics(chunks)


def search_bm25(
    questions: DataFrame, chunks: DataFrame, top_n: int = S.KEYWORD_TOP_N, postings: Postings | None = None,
    max_questions: int | None = None, stripe_rows: int | None = None,
) -> DataFrame:
    """Trigram keyword search: (question_id, chunk_id, score, keyword_rank).

    A question matches chunks that hold any of its trigrams; BM25 with statistics of the whole
    index orders them. Questions too short for a trigram match literally (ASCII case ignored)
    and are ordered by id. Only these read texts; all others read ``postings``, an index of
    ``chunks``, which is written first if none is given. ``max_questions`` and ``stripe_rows``
    are of no use here any more: the index bounds a pass and a block by itself.
    """
    index = postings or build_postings(chunks, "text")
    hits = bm25_hits(questions, index, top_n)
    literal = search_literal(questions, chunks, top_n)
    return hits if literal is None else hits.unionByName(literal)


def search_trgm(
    questions: DataFrame, chunks: DataFrame, top_n: int = S.KEYWORD_TOP_N,
    min_similarity: float = S.TRGM_MIN_SIMILARITY, postings: Postings | None = None,
    max_questions: int | None = None, stripe_rows: int | None = None,
) -> DataFrame:
    """Word-trigram similarity search over ``postings`` of kind words: (question_id, chunk_id, score, keyword_rank)."""
    index = postings or build_postings(chunks, "words")
    return word_hits(questions, index, top_n, min_similarity)


# ---------------------------------------------------------------- fusion


def fuse_rrf(vector_hits: DataFrame, keyword_hits: DataFrame, constant: int = S.RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two ranked channels.

    Ties keep vector hits first, by vector rank, then keyword-only hits by keyword rank.
    """
    v = vector_hits.select(
        "question_id", "chunk_id", F.col("vector_rank").cast("bigint").alias("vector_rank"),
        F.lit(None).cast("bigint").alias("keyword_rank"), F.col("similarity").alias("vector_similarity"),
    )
    k = keyword_hits.select(
        "question_id", "chunk_id", F.lit(None).cast("bigint").alias("vector_rank"),
        F.col("keyword_rank").cast("bigint").alias("keyword_rank"),
        F.lit(None).cast("double").alias("vector_similarity"),
    )
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(rank)), F.lit(0.0))
    fused = (
        v.unionByName(k)
        .groupBy("question_id", "chunk_id")
        .agg(*[F.min(c).alias(c) for c in ("vector_rank", "keyword_rank", "vector_similarity")])
        .withColumn("rrf_score", part("vector_rank") + part("keyword_rank"))
    )
    w = Window.partitionBy("question_id").orderBy(
        F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")
    )
    return fused.withColumn("rank", F.row_number().over(w).cast("bigint"))


def rehydrate(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach chunk text; ids that no longer exist drop out."""
    return fused.join(chunks.drop("embedding"), "chunk_id")


def retrieve(
    questions: DataFrame, chunks: DataFrame, top_k: int = S.RETRIEVE_TOP_K,
    vector_top_n: int = S.VECTOR_TOP_N, keyword_top_n: int = S.KEYWORD_TOP_N,
    keyword_channel: str = "bm25", postings: Postings | None = None,
) -> DataFrame:
    """Hybrid search of all questions in one plan; ``top_k`` is cut before rehydration.

    With ``postings`` of the keyword channel's kind, chunk texts are read at rehydration only.
    """
    vector_hits = search_vector(questions, chunks, vector_top_n)
    if keyword_channel == "bm25":
        keyword_hits = search_bm25(questions, chunks, keyword_top_n, postings)
    elif keyword_channel == "trgm":
        keyword_hits = search_trgm(questions, chunks, keyword_top_n, postings=postings)
    else:
        raise ValueError("keyword_channel must be 'bm25' or 'trgm'")
    fused = fuse_rrf(vector_hits, keyword_hits).filter(F.col("rank") <= top_k)
    held = chunks.drop("kb_id", "embedding") if "kb_id" in chunks.columns else chunks.drop("embedding")
    # top_k narrow rows per question: the hint holds while the measured batch is small.
    few = questions.limit(MAX_BROADCAST_QUESTIONS + 1).count() <= MAX_BROADCAST_QUESTIONS
    return held.join(F.broadcast(fused) if few else fused, "chunk_id")
