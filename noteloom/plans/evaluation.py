"""Evaluation queries: labelled questions, metrics, sweeps and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.operators import evaluation as E
from noteloom.operators import gate as gating
from noteloom.operators import retrieval as R
from noteloom.operators.embedding import embed_distinct, letter_profile
from noteloom.operators.labels import first_document_with
from noteloom.plans import inputs as I
from noteloom.plans.search import ANSWER, BM25, FUSED, LINES, PROFILE_HITS, REFUSE
from noteloom.session import checkpointed

SWEEP = [(r, a) for r in (0.975, 0.98, 0.985, 0.99) for a in (0.985, 0.99, 0.995) if r < a]


def items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as labelled questions; a passage found in a document is in the base."""
    asked = I.questions(spark, d).select("question_id", "text")
    notes = I.notes(spark, d)
    found = first_document_with(asked, notes)
    base = found.join(notes.select("doc_id", "kb_id"), "doc_id")
    level = F.get(F.array(*[F.lit(x) for x in S.DIFFICULTIES]), (F.col("question_id") % 4).cast("int"))
    inside = F.col("doc_id").isNotNull()
    words = F.array_distinct(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) >= 4))
    return asked.join(base, "question_id", "left").select(
        "question_id", "text",
        F.coalesce("kb_id", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string"))).alias("library"),
        level.alias("difficulty"), inside.alias("in_kb"),
        F.when(inside, F.concat(F.lit("NOTE-"), F.col("doc_id").cast("string"))).alias("expected_doc"),
        F.when(inside, words).otherwise(F.array().cast("array<string>")).alias("expected_keywords"),
    )


def _asked(labelled: DataFrame) -> DataFrame:
    base = labelled.select("question_id", F.col("library").alias("kb_id"), "text")
    return embed_distinct(base, "text", letter_profile, I.LETTERS, batch_size=4096)


def _titled(found: DataFrame) -> DataFrame:
    return found.withColumn("doc_title", F.concat(F.lit("note-"), F.col("doc_id").cast("string")))


def _setup(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items and their hybrid candidates, each computed once."""
    labelled = checkpointed(items(spark, d))
    found = checkpointed(_titled(R.retrieve(_asked(labelled), I.stored_lines(spark, d), postings=I.line_postings(spark, d))))
    return labelled, found


def labelled_questions(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select(
        "question_id", "library", "difficulty", "in_kb", "expected_doc",
        F.size("expected_keywords").cast("bigint").alias("n_keywords"),
    )


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the labelled questions, were they a question manifest."""
    labelled = checkpointed(items(spark, d)).withColumnRenamed("text", "question")
    notes = I.notes(spark, d).select(
        F.col("kb_id").alias("library"), F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("title"), "text"
    )
    bases = notes.select(F.col("library").alias("key")).distinct()
    return E.manifest_problems(bases, labelled, notes, F.lower)


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    labelled, found = _setup(spark, d)
    m = E.retrieval_metrics(E.first_hit_ranks(labelled, found))
    return m.select("level", "grp", "total", "hits", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


def _samples(labelled: DataFrame, found: DataFrame) -> DataFrame:
    return gating.similarity_samples(labelled.select("question_id", "library", "difficulty", "in_kb"), found)


def _outcomes(labelled: DataFrame, found: DataFrame) -> DataFrame:
    gated = gating.gate(_samples(labelled, found), REFUSE, ANSWER)
    reason = F.when(F.col("band") == "borderline", "borderline_relevance").when(F.col("band") == "insufficient", "low_relevance")
    return gated.withColumns({"status": gating.status_of_band(F.col("band")), "reason": reason})


_RATES = [f"{side}_{what}_rate" for side in ("in_kb", "out_of_kb") for what in ("answer", "review", "hard_refusal")]


def refusal_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = E.refusal_metrics(_outcomes(*_setup(spark, d)))
    return m.select("level", "grp", "in_kb_total", "out_of_kb_total", *[F.round(c, 6).alias(c) for c in _RATES])


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = E.outcome_counts(_outcomes(*_setup(spark, d)))
    return counts.select("level", "grp", "kind", F.explode("counts").alias("value", "n"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    m = E.threshold_sweep(_samples(*_setup(spark, d)), SWEEP)
    return m.select("refuse_below", "answer_from", "level", "grp", "in_kb_total", "out_of_kb_total", *[F.round(c, 6).alias(c) for c in _RATES])


def similarity_range(spark: SparkSession, d: str) -> DataFrame:
    m = E.similarity_range(_samples(*_setup(spark, d)))
    return m.select("in_kb", "items", *[F.round(c, 6).alias(c) for c in ("lowest", "highest", "mean")])


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search as the reference report, keyword search alone as the candidate."""
    labelled, found = _setup(spark, d)
    asked = labelled.select("question_id", F.col("library").alias("kb_id"), "text")
    lines = I.note_lines(spark, d)
    hits = R.search_bm25(asked, lines, S.RETRIEVE_TOP_K, postings=I.line_postings(spark, d)).withColumnRenamed("keyword_rank", "rank")
    alone = checkpointed(_titled(
        hits.join(lines.select("chunk_id", "doc_id", "content"), "chunk_id").withColumn("vector_similarity", F.lit(None).cast("double"))
    ))

    def report(candidates: DataFrame) -> DataFrame:
        return E.tidy_report(
            E.retrieval_metrics(E.first_hit_ranks(labelled, candidates)), E.refusal_metrics(_outcomes(labelled, candidates))
        )

    verdict = E.regression_gate(report(found), report(alone))
    return verdict.select("level", "grp", "metric", F.round("reference", 6).alias("reference"), F.round("candidate", 6).alias("candidate"), "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        labelled_questions, manifest_check, retrieval_metrics, refusal_metrics, outcome_counts, threshold_sweep,
        similarity_range, regression_gate,
    )
}

# ---------------------------------------------------------------- equivalent SQL

_ITEMS = """
held AS (SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
items AS (
  SELECT b.item_id AS question_id, b.text, coalesce(d.source, 'src' || (b.item_id % 20)) AS library,
         ['smoke', 'basic', 'regular', 'hard'][b.item_id % 4 + 1] AS difficulty, d.doc_id IS NOT NULL AS in_kb,
         d.doc_id AS expected,
         CASE WHEN d.doc_id IS NULL THEN [] ELSE list_distinct(list_filter(regexp_split_to_array(b.text, '[^\\pL]+'), lambda w: length(w) >= 4)) END AS keywords
  FROM benchmark b LEFT JOIN held h USING (item_id) LEFT JOIN documents d ON d.doc_id = h.doc_id
)"""
_SCOPED = "asked AS (SELECT question_id, library AS kb_id, text FROM items)"
_FOUND = f"{LINES}, {_ITEMS}, {_SCOPED}, {BM25}, {PROFILE_HITS}, {FUSED}"
_RANKS = """
{name}_ranks AS (
  SELECT i.question_id, i.library, i.difficulty, min(f.rank) AS hit_rank
  FROM items i LEFT JOIN (
    SELECT f.question_id, f.rank FROM {source} f JOIN lines l USING (chunk_id) JOIN items i USING (question_id)
    WHERE f.rank <= 8 AND i.expected = l.doc_id AND len(list_filter(i.keywords, lambda k: contains(lower(l.content), lower(k)))) > 0
  ) f USING (question_id)
  WHERE i.in_kb AND len(i.keywords) > 0 GROUP BY 1, 2, 3
),
{name}_metrics AS (
  SELECT CASE WHEN grouping(library) = 0 THEN 'library' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level,
         coalesce(library, difficulty, 'all') AS grp, count(*) AS total, count(hit_rank) AS hits,
         count(hit_rank)::DOUBLE / count(*) AS recall_at_k, sum(coalesce(1.0::DOUBLE / hit_rank, 0)) / count(*) AS mrr
  FROM {name}_ranks GROUP BY GROUPING SETS ((), (library), (difficulty))
)"""
_SAMPLES = """
{name}_samples AS (
  SELECT i.question_id, i.library, i.difficulty, i.in_kb, count(f.chunk_id) AS n, max(f.vector_similarity) AS best
  FROM items i LEFT JOIN (SELECT * FROM {source} WHERE rank <= 8) f USING (question_id) GROUP BY ALL
)"""
_STATUS = """CASE WHEN n = 0 THEN 'insufficient' WHEN best IS NULL THEN 'needs_review' WHEN best < {lo} THEN 'insufficient'
            WHEN best < {hi} THEN 'needs_review' ELSE 'answered' END"""
_LEVEL = """CASE WHEN grouping(library) = 0 THEN 'library' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level,
         coalesce(library, difficulty, 'all') AS grp"""


def _rate(side: str, what: str, name: str) -> str:
    total = f"count(*) FILTER ({side})"
    return f"round(CASE WHEN {total} = 0 THEN 0 ELSE count(*) FILTER ({side} AND {what})::DOUBLE / {total} END, 6) AS {name}"


_RATE_SQL = ",\n         ".join(
    _rate(side, what, f"{name}_{kind}_rate")
    for name, side in (("in_kb", "in_kb"), ("out_of_kb", "NOT in_kb"))
    for kind, what in (("answer", "status = 'answered'"), ("review", "status = 'needs_review'"), ("hard_refusal", "status = 'insufficient'"))
)
_TOTALS = "count(*) FILTER (in_kb) AS in_kb_total, count(*) FILTER (NOT in_kb) AS out_of_kb_total"
_SETS = "GROUPING SETS ((), (library), (difficulty))"
_FUSED_SAMPLES = _SAMPLES.format(name="f", source="fused")
_F_OUTCOMES = f"outcomes AS (SELECT *, {_STATUS.format(lo=REFUSE, hi=ANSWER)} AS status FROM f_samples)"


def _tidy(name: str) -> str:
    outcomes = f"(SELECT *, {_STATUS.format(lo=REFUSE, hi=ANSWER)} AS status FROM {name}_samples)"
    return f"""
{name}_report AS (
  SELECT level, grp, 'recall_at_k' AS metric, recall_at_k AS value FROM {name}_metrics
  UNION ALL SELECT level, grp, 'mrr', mrr FROM {name}_metrics
  UNION ALL SELECT 'overall', 'all', 'out_of_kb_answer_rate',
    CASE WHEN count(*) FILTER (NOT in_kb) = 0 THEN 0 ELSE count(*) FILTER (NOT in_kb AND status = 'answered')::DOUBLE / count(*) FILTER (NOT in_kb) END FROM {outcomes}
  UNION ALL SELECT 'overall', 'all', 'in_kb_hard_refusal_rate',
    CASE WHEN count(*) FILTER (in_kb) = 0 THEN 0 ELSE count(*) FILTER (in_kb AND status = 'insufficient')::DOUBLE / count(*) FILTER (in_kb) END FROM {outcomes}
)"""


ORACLES = {
    "labelled_questions": f"""WITH {_ITEMS}
SELECT question_id, library, difficulty, in_kb, 'NOTE-' || expected AS expected_doc, len(keywords) AS n_keywords FROM items""",
    "manifest_check": f"""WITH {_ITEMS},
bases AS (SELECT DISTINCT source AS library FROM documents),
notes AS (SELECT source AS library, doc_id, 'note-' || doc_id AS title, text FROM documents)
SELECT 'unknown_library' AS code, library, text AS detail FROM items WHERE library NOT IN (SELECT library FROM bases)
UNION ALL SELECT 'label_missing', library, text FROM items WHERE in_kb AND len(keywords) = 0
UNION ALL SELECT 'keyword_missing', i.library, i.text FROM items i JOIN notes n ON i.library = n.library AND i.expected = n.doc_id
  WHERE len(list_filter(i.keywords, lambda k: NOT contains(lower(n.text), lower(k)))) > 0
UNION ALL SELECT 'document_not_covered', library, title FROM notes WHERE doc_id NOT IN (SELECT expected FROM items WHERE in_kb)
UNION ALL SELECT 'one_sided_library', library, library FROM bases LEFT JOIN items USING (library)
  GROUP BY library HAVING NOT (coalesce(bool_or(in_kb), false) AND coalesce(bool_or(NOT in_kb), false))
UNION ALL SELECT 'duplicate_question', library, min(text) FROM items GROUP BY library, lower(text) HAVING count(*) > 1""",
    "retrieval_metrics": f"""WITH {_FOUND}, {_RANKS.format(name='f', source='fused')}
SELECT level, grp, total, hits, round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr FROM f_metrics""",
    "refusal_metrics": f"""WITH {_FOUND}, {_FUSED_SAMPLES}, {_F_OUTCOMES}
SELECT {_LEVEL}, {_TOTALS}, {_RATE_SQL} FROM outcomes GROUP BY {_SETS}""",
    "outcome_counts": f"""WITH {_FOUND}, {_FUSED_SAMPLES}, {_F_OUTCOMES},
c AS (
  SELECT library, difficulty, CASE WHEN in_kb THEN 'in_kb' ELSE 'out_of_kb' END AS kind, status AS value FROM outcomes
  UNION ALL SELECT library, difficulty, 'reason', CASE WHEN status = 'needs_review' THEN 'borderline_relevance' ELSE 'low_relevance' END
  FROM outcomes WHERE status <> 'answered'
)
SELECT {_LEVEL}, kind, value, count(*) AS n FROM c GROUP BY GROUPING SETS ((kind, value), (kind, value, library), (kind, value, difficulty))""",
    "threshold_sweep": f"""WITH {_FOUND}, {_FUSED_SAMPLES},
pairs AS (SELECT * FROM (VALUES {', '.join(f'({r}::DOUBLE, {a}::DOUBLE)' for r, a in SWEEP)}) t(refuse_below, answer_from)),
outcomes AS (SELECT *, {_STATUS.format(lo='refuse_below', hi='answer_from')} AS status FROM f_samples, pairs)
SELECT refuse_below, answer_from, {_LEVEL}, {_TOTALS}, {_RATE_SQL} FROM outcomes
GROUP BY GROUPING SETS ((refuse_below, answer_from), (refuse_below, answer_from, library), (refuse_below, answer_from, difficulty))""",
    "similarity_range": f"""WITH {_FOUND}, {_FUSED_SAMPLES}
SELECT in_kb, count(*) AS items, round(min(best), 6) AS lowest, round(max(best), 6) AS highest, round(avg(best), 6) AS mean
FROM f_samples GROUP BY 1""",
    "regression_gate": f"""WITH {_FOUND},
alone AS (SELECT question_id, chunk_id, keyword_rank AS rank, NULL::DOUBLE AS vector_similarity FROM keyword_hits WHERE keyword_rank <= 8),
{_RANKS.format(name='f', source='fused')}, {_RANKS.format(name='k', source='alone')},
{_FUSED_SAMPLES}, {_SAMPLES.format(name='k', source='alone')}, {_tidy('f')}, {_tidy('k')},
j AS (SELECT level, grp, metric, f.value AS reference, k.value AS candidate FROM f_report f FULL OUTER JOIN k_report k USING (level, grp, metric))
SELECT level, grp, metric, round(reference, 6) AS reference, round(candidate, 6) AS candidate,
  CASE WHEN reference IS NULL OR candidate IS NULL THEN 'group_mismatch'
       WHEN metric = 'recall_at_k' AND candidate + 1e-12 < reference THEN 'recall_drop'
       WHEN metric = 'mrr' AND reference - candidate > CASE WHEN level = 'overall' THEN 0.01 ELSE 0.05 END + 1e-12 THEN 'mrr_drop'
       WHEN metric = 'out_of_kb_answer_rate' AND candidate > reference + 1e-12 THEN 'out_of_kb_answers_rise'
       WHEN metric = 'in_kb_hard_refusal_rate' AND candidate > reference + 1e-12 THEN 'hard_refusals_rise' ELSE 'ok' END AS verdict
FROM j""",
}
