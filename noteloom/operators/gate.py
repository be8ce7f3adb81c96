"""The evidence gate: is what was found enough to answer?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions.vectors import threshold_pair, valid_similarity


def similarity_samples(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per question: number of candidates and the highest valid similarity, if any."""
    found = candidates.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.max(valid_similarity(F.col("vector_similarity"))).alias("max_vector_similarity"),
    )
    return questions.join(found, "question_id", "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("bigint")
    )


def evidence_band(count: Column, similarity: Column, lower: Column, upper: Column) -> Column:
    """insufficient, borderline or sufficient; a hit without a score is borderline."""
    valid = valid_similarity(similarity)
    return (
        F.when(count == 0, "insufficient")
        .when(valid.isNull(), "borderline")
        .when(valid < lower, "insufficient")
        .when(valid < upper, "borderline")
        .otherwise("sufficient")
    )


def gate(
    samples: DataFrame, refuse_below: float = S.REFUSE_BELOW, answer_from: float = S.ANSWER_FROM
) -> DataFrame:
    """Add ``band`` and both thresholds to similarity samples."""
    lower, upper = threshold_pair(refuse_below, answer_from)
    return samples.withColumns({
        "band": evidence_band(
            F.col("candidate_count"), F.col("max_vector_similarity"), F.lit(lower), F.lit(upper)
        ),
        "refuse_below": F.lit(lower),
        "answer_from": F.lit(upper),
    })


def status_of_band(band: Column) -> Column:
    """Answer status that a band leads to before any model is called."""
    return F.create_map(*[F.lit(x) for p in S.BAND_STATUS.items() for x in p])[band]


def possible_sources(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """The first candidates of each question, for manual checking in the grey zone."""
    return candidates.filter(F.col("rank") <= limit)
