"""Retrieval and refusal metrics, threshold sweep and regression gate.

Items: ``question_id, library, difficulty, in_kb, expected_doc, expected_keywords``.
Candidates: ``question_id, rank, doc_title, content, vector_similarity``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions.texts import casefold
from noteloom.functions.vectors import threshold_pair
from noteloom.operators.gate import evidence_band, status_of_band

_UNIT = "\x1f"


def relevant(candidates: DataFrame, fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """Candidates of the expected document that hold at least one keyword; case is ignored.

    Needs ``expected_doc, expected_keywords, doc_title, content``. The folded texts are
    columns of their own because a Python function cannot stand inside a lambda.
    """
    folded = candidates.withColumns({
        "_expected": fold(F.col("expected_doc")), "_actual": fold(F.col("doc_title")),
        "_keywords": fold(F.array_join("expected_keywords", _UNIT)), "_content": fold(F.col("content")),
    })
    return folded.filter(
        (F.col("_expected") == F.col("_actual"))
        & F.exists(F.split("_keywords", _UNIT), lambda k: F.contains(F.col("_content"), k))
    ).drop("_expected", "_actual", "_keywords", "_content")


def first_hit_ranks(items: DataFrame, candidates: DataFrame, fold=casefold) -> DataFrame:
    """Rank of the first relevant candidate per evaluable item; null when there is none."""
    evaluable = items.filter(
        F.col("in_kb") & F.col("expected_doc").isNotNull() & (F.size("expected_keywords") > 0)
    )
    # Candidates per question are few, so the text comparison follows the join on the question.
    hits = (
        relevant(candidates.join(evaluable.select("question_id", "expected_doc", "expected_keywords"), "question_id"), fold)
        .groupBy("question_id").agg(F.min("rank").alias("hit_rank"))
    )
    return evaluable.select("question_id", "library", "difficulty").join(hits, "question_id", "left")


def _by_level(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate overall, by library and by difficulty in one pass: level, grp, values."""
    library, difficulty = F.col("library"), F.col("difficulty")
    return (
        df.groupingSets([[], [library], [difficulty]], library, difficulty)
        .agg(F.grouping_id().alias("_g"), *aggregates)
        .withColumn("level", F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "library").otherwise("difficulty"))
        .withColumn("grp", F.coalesce("library", "difficulty", F.lit("all")))
        .drop("_g", "library", "difficulty")
    )


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """recall@k and MRR per level; a miss counts 0 and stays in the denominator."""
    return _by_level(
        ranks,
        F.count(F.lit(1)).alias("total"),
        F.count("hit_rank").alias("hits"),
        F.sum(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))).alias("reciprocal"),
    ).select(
        "level", "grp", "total", "hits",
        _rate(F.col("hits"), F.col("total")).alias("recall_at_k"),
        _rate(F.col("reciprocal"), F.col("total")).alias("mrr"),
    )




def _refusal_aggregates() -> list[Column]:
    out = []
    for name, side in (("in_kb", F.col("in_kb")), ("out_of_kb", ~F.col("in_kb"))):
        out += [
            F.count_if(side).alias(f"{name}_total"),
            F.count_if(side & (F.col("status") == S.ANSWERED)).alias(f"{name}_answered"),
            F.count_if(side & (F.col("status") == S.NEEDS_REVIEW)).alias(f"{name}_review"),
        ]
    return out


def _refusal_rates(df: DataFrame) -> DataFrame:
    for name in ("in_kb", "out_of_kb"):
        total, answered, review = (F.col(f"{name}_{c}") for c in ("total", "answered", "review"))
        df = df.withColumns({
            f"{name}_hard_refused": F.greatest(F.lit(0), total - answered - review),
            f"{name}_answer_rate": _rate(answered, total),
            f"{name}_review_rate": _rate(review, total),
            f"{name}_hard_refusal_rate": _rate(F.greatest(F.lit(0), total - answered - review), total),
        })
    return df


def refusal_metrics(outcomes: DataFrame) -> DataFrame:
    """Answer, review and hard refusal rates inside and outside the bases, per level.

    Outcomes: ``library, difficulty, in_kb, status``.
    """
    return _refusal_rates(_by_level(outcomes, *_refusal_aggregates()))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Status and refusal reason counts per level as maps. Adds ``reason`` to the outcomes' columns."""
    counted = outcomes.select(
        "library", "difficulty",
        F.explode(F.array_compact(F.array(
            F.struct(F.when(F.col("in_kb"), "in_kb").otherwise("out_of_kb").alias("kind"), F.col("status").alias("value")),
            F.when(
                (F.col("status") != S.ANSWERED) & F.col("reason").isNotNull(),
                F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("value")),
            ),
        ))).alias("c"),
    ).select("library", "difficulty", F.col("c.kind").alias("kind"), F.col("c.value").alias("value"))
    library, difficulty, kind, value = (F.col(c) for c in ("library", "difficulty", "kind", "value"))
    tidy = (
        counted.groupingSets(
            [[kind, value], [kind, value, library], [kind, value, difficulty]], library, difficulty, kind, value
        )
        .agg(F.grouping(F.col("library")).alias("_l"), F.grouping(F.col("difficulty")).alias("_d"), F.count(F.lit(1)).alias("n"))
        .withColumn("level", F.when((F.col("_l") == 1) & (F.col("_d") == 1), "overall").when(F.col("_l") == 0, "library").otherwise("difficulty"))
        .withColumn("grp", F.coalesce("library", "difficulty", F.lit("all")))
    )
    # Statuses and reasons are fixed lists, so a map has a bounded number of entries.
    return tidy.groupBy("level", "grp", "kind").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts")
    )


def threshold_grid(
    refuse: tuple[float, ...] = S.SWEEP_REFUSE, answer: tuple[float, ...] = S.SWEEP_ANSWER
) -> list[tuple[float, float]]:
    """All pairs in which the refusal threshold is below the answer threshold."""
    return [(r, a) for r in refuse for a in answer if r < a]


def threshold_sweep(samples: DataFrame, pairs: list[tuple[float, float]] | None = None) -> DataFrame:
    """Refusal metrics of every threshold pair from one set of similarity samples.

    Samples: ``library, difficulty, in_kb, candidate_count, max_vector_similarity``. Each
    sample is repeated once per pair and aggregated inside its task.
    """
    grid = [threshold_pair(*p) for p in (pairs if pairs is not None else threshold_grid())]
    pair = F.explode(F.array(*[
        F.struct(F.lit(r).alias("refuse_below"), F.lit(a).alias("answer_from")) for r, a in grid
    ]))
    decided = samples.withColumn("p", pair).select(
        "library", "difficulty", "in_kb", "p.refuse_below", "p.answer_from",
        status_of_band(evidence_band(
            F.col("candidate_count"), F.col("max_vector_similarity"), F.col("p.refuse_below"), F.col("p.answer_from")
        )).alias("status"),
    )
    key = [F.col("refuse_below"), F.col("answer_from")]
    library, difficulty = F.col("library"), F.col("difficulty")
    grouped = (
        decided.groupingSets([key, [*key, library], [*key, difficulty]], *key, library, difficulty)
        .agg(F.grouping(library).alias("_l"), F.grouping(difficulty).alias("_d"), *_refusal_aggregates())
        .withColumn("level", F.when((F.col("_l") == 1) & (F.col("_d") == 1), "overall").when(F.col("_l") == 0, "library").otherwise("difficulty"))
        .withColumn("grp", F.coalesce("library", "difficulty", F.lit("all")))
        .drop("_l", "_d", "library", "difficulty")
    )
    return _refusal_rates(grouped)


def similarity_range(samples: DataFrame) -> DataFrame:
    """Lowest, highest and mean similarity inside and outside the bases."""
    v = F.col("max_vector_similarity")
    return samples.groupBy("in_kb").agg(
        F.count(F.lit(1)).alias("items"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"),
    )


# ---------------------------------------------------------------- reports and the gate


def tidy_report(retrieval: DataFrame, refusal: DataFrame) -> DataFrame:
    """Metrics as rows (level, grp, metric, value): retrieval per level, decisions overall."""
    r = retrieval.select("level", "grp", F.expr("stack(2, 'recall_at_k', recall_at_k, 'mrr', mrr) AS (metric, value)"))
    d = refusal.filter(F.col("level") == "overall").select(
        "level", "grp",
        F.expr(
            "stack(2, 'out_of_kb_answer_rate', out_of_kb_answer_rate,"
            " 'in_kb_hard_refusal_rate', in_kb_hard_refusal_rate) AS (metric, value)"
        ),
    )
    return r.unionByName(d)


def regression_gate(
    reference: DataFrame, candidate: DataFrame, max_mrr_drop: float = S.GATE_MRR_DROP,
    max_group_mrr_drop: float = S.GATE_GROUP_MRR_DROP,
) -> DataFrame:
    """Compare two tidy reports row by row; ``verdict`` is ok or the broken rule.

    Recall must not fall, MRR may fall a little, answers outside and hard refusals inside
    the bases must not rise. A group on one side only, and a value outside 0..1, fail too.
    """
    if max_mrr_drop < 0 or max_group_mrr_drop < 0:
        raise ValueError("allowed MRR drops must not be negative")
    key = ["level", "grp", "metric"]
    both = reference.withColumnRenamed("value", "reference").join(
        candidate.withColumnRenamed("value", "candidate"), key, "full_outer"
    )
    ref, cand, eps = F.col("reference"), F.col("candidate"), F.lit(S.GATE_EPSILON)
    allowed = F.when(F.col("level") == "overall", F.lit(max_mrr_drop)).otherwise(F.lit(max_group_mrr_drop))
    bad = lambda v: F.isnan(v) | ~v.between(0.0, 1.0)
    verdict = (
        F.when(ref.isNull() | cand.isNull(), "group_mismatch")
        .when(bad(ref) | bad(cand), "invalid_value")
        .when((F.col("metric") == "recall_at_k") & (cand + eps < ref), "recall_drop")
        .when((F.col("metric") == "mrr") & (ref - cand > allowed + eps), "mrr_drop")
        .when((F.col("metric") == "out_of_kb_answer_rate") & (cand > ref + eps), "out_of_kb_answers_rise")
        .when((F.col("metric") == "in_kb_hard_refusal_rate") & (cand > ref + eps), "hard_refusals_rise")
        .otherwise("ok")
    )
    return both.withColumn("verdict", verdict)


def comparability(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Report header fields (field, value as text) that are missing or differ."""
    wanted = reference.sparkSession.createDataFrame([(f,) for f in S.COMPARABLE_FIELDS], "field string")
    joined = wanted.join(reference.withColumnRenamed("value", "reference"), "field", "left").join(
        candidate.withColumnRenamed("value", "candidate"), "field", "left"
    )
    problem = F.when(F.col("reference").isNull() | F.col("candidate").isNull(), "missing").when(
        F.col("reference") != F.col("candidate"), "different"
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


# ---------------------------------------------------------------- manifest checks


def manifest_problems(libraries: DataFrame, items: DataFrame, documents: DataFrame, fold=casefold) -> DataFrame:
    """Everything wrong with a labelled question set: (code, library, detail).

    Libraries: ``key``. Items: ``library, question, difficulty, in_kb, expected_doc,
    expected_keywords``. Documents: ``library, title, text``.
    """
    item = items.withColumns({"_doc": fold(F.col("expected_doc")), "_q": fold(F.col("question"))})
    note = documents.withColumn("_doc", fold(F.col("title")))
    row = lambda df, code, library, detail: df.select(
        F.lit(code).alias("code"), F.col(library).alias("library"), F.col(detail).alias("detail")
    )
    inside = item.filter("in_kb")
    located = inside.join(note.select("library", "_doc", "text"), ["library", "_doc"])
    absent = located.withColumns({
        "_text": fold(F.col("text")), "_keywords": fold(F.array_join("expected_keywords", _UNIT)),
    }).filter(F.exists(F.split("_keywords", _UNIT), lambda k: ~F.contains(F.col("_text"), k)))
    sides = item.groupBy("library").agg(F.bool_or("in_kb").alias("some_in"), F.bool_or(~F.col("in_kb")).alias("some_out"))
    one_sided = libraries.select(F.col("key").alias("library")).join(sides, "library", "left").filter(
        ~(F.coalesce("some_in", F.lit(False)) & F.coalesce("some_out", F.lit(False)))
    )
    has_label = F.col("expected_doc").isNotNull() & (F.size("expected_keywords") > 0)
    no_label = F.col("expected_doc").isNull() & (F.coalesce(F.size("expected_keywords"), F.lit(0)) == 0)
    parts = [
        row(item.join(libraries, item["library"] == libraries["key"], "left_anti"), "unknown_library", "library", "question"),
        row(item.filter(~F.col("difficulty").isin(*S.DIFFICULTIES)), "unknown_difficulty", "library", "question"),
        row(inside.filter(~has_label), "label_missing", "library", "question"),
        row(item.filter(~F.col("in_kb") & ~no_label), "label_unexpected", "library", "question"),
        row(
            inside.filter(has_label).join(note, ["library", "_doc"], "left_anti"),
            "document_missing", "library", "question",
        ),
        row(absent, "keyword_missing", "library", "question"),
        row(note.join(inside, ["library", "_doc"], "left_anti"), "document_not_covered", "library", "title"),
        row(one_sided, "one_sided_library", "library", "library"),
        row(
            item.groupBy("library", "_q").agg(F.count(F.lit(1)).alias("n"), F.min("question").alias("question")).filter("n > 1"),
            "duplicate_question", "library", "question",
        ),
        row(
            note.groupBy("library", "_doc").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title")).filter("n > 1"),
            "duplicate_title", "library", "title",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scale_problems(libraries: DataFrame, items: DataFrame) -> DataFrame:
    """Unmet minimums of a formal baseline: (code, actual, required)."""
    size = items.agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("library").alias("used"),
        F.count_distinct(F.when(F.col("difficulty").isin(*S.DIFFICULTIES), F.col("difficulty"))).alias("difficulties"),
    )
    known = libraries.agg(F.count_distinct("key").alias("libraries"))
    facts = size.select(F.expr("stack(2, 'items', items, 'difficulties', difficulties) AS (code, actual)")).unionByName(
        known.select(F.lit("libraries").alias("code"), F.col("libraries").alias("actual"))
    )
    required = F.create_map(
        F.lit("items"), F.lit(S.MIN_ITEMS), F.lit("libraries"), F.lit(S.MIN_LIBRARIES),
        F.lit("difficulties"), F.lit(len(S.DIFFICULTIES)),
    )
    return facts.withColumn("required", required[F.col("code")]).filter(F.col("actual") < F.col("required"))
