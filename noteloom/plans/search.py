"""Search queries: both channels, fusion, hybrid search, evidence gate and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions.grams import query_grams
from noteloom.operators import gate as gating
from noteloom.operators import graph as G
from noteloom.operators import retrieval as R
from noteloom.operators.ann import CellShape, build_cells, search_cells
from noteloom.operators.audit import source_snapshots
from noteloom.operators.lines import spanned_lines
from noteloom.plans import inputs as I
from noteloom.session import checkpointed, hinted

# Letter profiles are much alike, so the gate needs higher thresholds than the defaults.
REFUSE, ANSWER = 0.985, 0.99
# Best similarities between different labels lie between 0.27 and 0.60 here.
GRAPH_FLOOR = 0.35
LSH = CellShape(dimension=64, bits=5)
GRAPH_PRESETS = (0.30, 0.35, 0.40, 0.45)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a question; even ids search only their own label."""
    chunks = I.vectors(spark, d).withColumn("kb_id", F.col("doc_id"))
    asked = chunks.select(
        F.col("chunk_id").alias("question_id"),
        F.when(F.col("chunk_id") % 2 == 0, F.col("kb_id")).alias("kb_id"), "embedding",
    )
    return R.search_vector(asked, chunks).select(
        "question_id", "chunk_id", "vector_rank", F.round("similarity", 6).alias("similarity")
    )


def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = I.vectors(spark, d)
    asked = chunks.select(F.col("chunk_id").alias("question_id"), "embedding")
    cells = build_cells(chunks, LSH)
    return search_cells(asked, cells, LSH, probes=8)


def trigram_terms(spark: SparkSession, d: str) -> DataFrame:
    return I.questions(spark, d).select(
        "question_id", F.posexplode(query_grams(F.col("text"), S.MAX_QUERY_GRAMS)).alias("place", "gram")
    ).select("question_id", F.col("place").cast("bigint").alias("place"), "gram")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search_bm25(I.scoped_questions(spark, d), I.note_lines(spark, d), postings=I.line_postings(spark, d))
    return hits.select("question_id", "chunk_id", "keyword_rank", F.round("score", 6).alias("score"))


def trgm_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search_trgm(I.scoped_questions(spark, d), I.note_lines(spark, d), postings=I.line_postings(spark, d, "words"))
    return hits.select("question_id", "chunk_id", "keyword_rank", F.round("score", 6).alias("similarity"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    asked, lines = I.embedded_questions(spark, d), I.stored_lines(spark, d)
    fused = R.fuse_rrf(R.search_vector(asked, lines), R.search_bm25(asked, lines, postings=I.line_postings(spark, d)))
    return fused.select(
        "question_id", "chunk_id", "vector_rank", "keyword_rank", F.round("rrf_score", 6).alias("rrf_score"), "rank"
    )


def _retrieved(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    return R.retrieve(asked, I.stored_lines(spark, d), postings=I.line_postings(spark, d))


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    found = _retrieved(spark, d, I.embedded_questions(spark, d))
    return found.select(
        "question_id", "rank", "chunk_id", "doc_id", "chunk_index", "vector_rank", "keyword_rank",
        F.round("vector_similarity", 6).alias("vector_similarity"), F.round("rrf_score", 6).alias("rrf_score"),
        F.length("content").cast("bigint").alias("n_chars"),
    )


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    asked = I.embedded_questions(spark, d)
    found = _retrieved(spark, d, asked)
    samples = gating.similarity_samples(asked.select("question_id"), found)
    return gating.gate(samples, REFUSE, ANSWER).select(
        "question_id", "candidate_count", F.round("max_vector_similarity", 6).alias("max_vector_similarity"),
        "band", gating.status_of_band(F.col("band")).alias("status"),
    )


def possible_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first three candidates of the questions in the grey zone."""
    asked = I.embedded_questions(spark, d)
    found = _retrieved(spark, d, asked).select("question_id", "rank", "chunk_id", "vector_similarity")
    grey = gating.gate(gating.similarity_samples(asked.select("question_id"), found), REFUSE, ANSWER).filter(
        F.col("band") == "borderline"
    )
    return gating.possible_sources(found.join(grey.select("question_id"), "question_id", "left_semi")).select(
        "question_id", "rank", "chunk_id", F.round("vector_similarity", 6).alias("vector_similarity")
    )


def citation_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The keyword hits of each question as citable records with the state of their document."""
    chunks = spanned_lines(I.notes(spark, d))
    hits = checkpointed(R.search_bm25(I.questions(spark, d), I.note_lines(spark, d), postings=I.line_postings(spark, d)))
    found = chunks.join(hinted(hits.withColumnRenamed("keyword_rank", "rank")), "chunk_id")
    docs = I.table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("kb_id"), F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("title"),
        F.sha2("text", 256).alias("content_hash"),
    )
    return source_snapshots(found, docs).select(
        "question_id", "index", "chunk_id", "doc_id", "kb_id", "doc_title", "content_hash", "char_start", "char_end"
    )


def _graph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Labels are documents of three knowledge bases; every vector is a chunk."""
    return I.vectors(spark, d).select(
        "chunk_id", "doc_id", (F.col("doc_id") % 3).alias("kb_id"), F.col("chunk_id").alias("chunk_index"), "embedding"
    )


def graph_pool(spark: SparkSession, d: str) -> DataFrame:
    return G.chunk_pool(_graph_chunks(spark, d), 100).select(
        "kb_id", "doc_id", "chunk_id", F.col("chunk_rank").cast("bigint").alias("chunk_rank"),
        F.col("pool_rank").cast("bigint").alias("pool_rank"),
    )


def graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_pairs(_graph_chunks(spark, d), min_similarity=GRAPH_FLOOR).select(
        "kb_id", "source_chunk", "target_chunk", "source_doc", "target_doc", F.round("similarity", 6).alias("similarity")
    )


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_edges(G.graph_pairs(_graph_chunks(spark, d), min_similarity=GRAPH_FLOOR))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their line counts; a base above 400 lines is marked as truncated."""
    docs = I.table(spark, d, "documents").select(
        F.col("source").alias("kb_id"), "doc_id", F.concat(F.lit("note-"), F.col("doc_id")).alias("title"),
        F.col("n_chars").alias("char_count"),
    )
    return G.graph_nodes(docs, I.note_lines(spark, d), S.GRAPH_POOL_CHUNKS)


def graph_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_counts(_graph_chunks(spark, d), GRAPH_PRESETS)


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, lsh_topk, trigram_terms, bm25_topk, trgm_similarity_topk, rrf_fuse, hybrid_retrieve,
        evidence_gate, possible_sources, citation_snapshots, graph_pool, graph_pairs, graph_edges, graph_nodes, graph_threshold_sweep,
    )
}

# ---------------------------------------------------------------- equivalent SQL

LINES = """
lines AS (
  SELECT (doc_id << 27) | i AS chunk_id, doc_id, kb_id, i AS chunk_index, content
  FROM (
    SELECT doc_id, kb_id, unnest(l) AS content, unnest(range(len(l))) AS i
    FROM (SELECT doc_id, source AS kb_id, string_split(text, chr(10)) AS l FROM documents)
  )
)"""

ASKED = "asked AS (SELECT item_id AS question_id, CAST(NULL AS VARCHAR) AS kb_id, text FROM benchmark)"
ASKED_SCOPED = """asked AS (
  SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'src' || (item_id % 20) END AS kb_id, text
  FROM benchmark)"""

TERMS = """
windows AS (
  SELECT question_id, text, unnest(range(1, greatest(length(text) - 1, 1))) AS i FROM asked
),
first_seen AS (
  SELECT question_id, substring(text, i::INT, 3) AS gram, min(i) AS i FROM windows
  WHERE NOT regexp_full_match(substring(text, i::INT, 3), '\\s+') GROUP BY 1, 2
),
ordered AS (
  SELECT question_id, gram, row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS p,
         count(*) OVER (PARTITION BY question_id) AS n
  FROM first_seen
),
places AS (
  SELECT question_id, n, unnest(range(least(n, 64))) AS place FROM (SELECT DISTINCT question_id, n FROM ordered)
),
terms AS (
  SELECT a.question_id, a.place, o.gram
  FROM places a JOIN ordered o ON o.question_id = a.question_id
   AND o.p = CASE WHEN a.n > 64 THEN round_even(a.place * (a.n - 1)::DOUBLE / 63.0, 0)::BIGINT ELSE a.place END
)"""

BM25 = TERMS[: TERMS.index("places AS")] + """terms AS (SELECT question_id, p AS place, gram FROM ordered),
folded AS (SELECT question_id, lower(gram) AS gram, count(*) AS times FROM terms GROUP BY 1, 2),
postings AS (
  SELECT chunk_id, kb_id, dl, gram, count(*) AS tf FROM (
    SELECT chunk_id, kb_id, greatest(length(t) - 2, 0) AS dl,
           unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substring(t, i::INT, 3))) AS gram
    FROM (SELECT chunk_id, kb_id, lower(content) AS t FROM lines)
  ) WHERE gram IN (SELECT gram FROM folded) GROUP BY ALL
),
totals AS (SELECT count(*)::DOUBLE AS n, sum(greatest(length(lower(content)) - 2, 0)) / count(*)::DOUBLE AS avgdl FROM lines),
idf AS (
  SELECT gram, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf
  FROM (SELECT gram, count(*)::DOUBLE AS df FROM postings GROUP BY gram), totals
),
bm25 AS (
  SELECT a.question_id, p.chunk_id,
         sum(f.times * round(i.idf * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / t.avgdl)) * 1e9)::BIGINT)::DOUBLE / 1e9 AS score
  FROM folded f JOIN asked a USING (question_id) JOIN postings p USING (gram) JOIN idf i USING (gram), totals t
  WHERE a.kb_id IS NULL OR a.kb_id = p.kb_id
  GROUP BY 1, 2
),
keyword_hits AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS keyword_rank FROM bm25
  QUALIFY keyword_rank <= 10
)"""

_PROFILE = (
    "list_transform(range(26), lambda c: (2 * length({t}) - length(replace({t}, chr(97 + c::INT), ''))"
    " - length(replace({t}, chr(65 + c::INT), '')))::DOUBLE)"
)

PROFILE_HITS = f"""
asked_v AS (SELECT question_id, kb_id, v, list_dot_product(v, v) AS s
            FROM (SELECT question_id, kb_id, {_PROFILE.format(t='text')} AS v FROM asked)),
lines_v AS (SELECT chunk_id, kb_id, v, list_dot_product(v, v) AS s
            FROM (SELECT chunk_id, kb_id, {_PROFILE.format(t='content')} AS v FROM lines)),
vector_hits AS (
  SELECT question_id, chunk_id, similarity,
         row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS vector_rank
  FROM (
    SELECT question_id, chunk_id,
           CASE WHEN a.s * l.s = 0 THEN 0
                ELSE round(greatest(-1, least(1, list_dot_product(a.v, l.v) / sqrt(a.s * l.s))), 9) END AS similarity
    FROM asked_v a, lines_v l WHERE a.kb_id IS NULL OR a.kb_id = l.kb_id
  ) QUALIFY vector_rank <= 20
)"""

FUSED = """
fused AS (
  SELECT *, row_number() OVER (
      PARTITION BY question_id ORDER BY rrf_score DESC, vector_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST) AS rank
  FROM (
    SELECT question_id, chunk_id, v.vector_rank, k.keyword_rank, v.similarity AS vector_similarity,
           coalesce(1.0::DOUBLE / (60 + v.vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + k.keyword_rank), 0) AS rrf_score
    FROM vector_hits v FULL OUTER JOIN keyword_hits k USING (question_id, chunk_id)
  )
)"""

HYBRID = f"{LINES}, {ASKED}, {BM25}, {PROFILE_HITS}, {FUSED}"

GATED = f"""
samples AS (
  SELECT a.question_id, count(f.chunk_id) AS candidate_count, max(f.vector_similarity) AS max_vector_similarity
  FROM asked a LEFT JOIN (SELECT * FROM fused WHERE rank <= 8) f USING (question_id) GROUP BY 1
),
gated AS (
  SELECT *, CASE WHEN candidate_count = 0 THEN 'insufficient' WHEN max_vector_similarity IS NULL THEN 'borderline'
                 WHEN max_vector_similarity < {REFUSE} THEN 'insufficient'
                 WHEN max_vector_similarity < {ANSWER} THEN 'borderline' ELSE 'sufficient' END AS band
  FROM samples
)"""

_GRAPH = """
vecs AS (
  SELECT vec_id AS chunk_id, label::BIGINT AS doc_id, (label % 3)::BIGINT AS kb_id,
         list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kb_id, doc_id ORDER BY chunk_id) AS chunk_rank FROM vecs
),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY chunk_rank, doc_id) AS pool_rank FROM ranked
  QUALIFY pool_rank <= {size}
)"""
_PAIRS = _GRAPH.format(size=2**62) + """,
near AS (
  SELECT *, row_number() OVER (PARTITION BY source_chunk ORDER BY similarity DESC, target_chunk) AS r
  FROM (
    SELECT p.kb_id, p.chunk_id AS source_chunk, n.chunk_id AS target_chunk, p.doc_id AS source_doc, n.doc_id AS target_doc,
           round(greatest(-1, least(1, list_dot_product(p.v, n.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(n.v, n.v)))), 9) AS similarity
    FROM pool p JOIN pool n ON p.kb_id = n.kb_id AND p.doc_id <> n.doc_id
  ) QUALIFY r <= 3
)"""

ORACLES = {
    "vector_topk": """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (
  SELECT a.vec_id AS question_id, b.vec_id AS chunk_id,
         round(greatest(-1, least(1, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))), 9) AS similarity
  FROM e a, e b WHERE a.vec_id % 2 = 1 OR a.label = b.label
)
SELECT question_id, chunk_id, vector_rank, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS vector_rank FROM s)
WHERE vector_rank <= 20""",
    "trigram_terms": f"WITH {ASKED}, {TERMS} SELECT question_id, place, gram FROM terms",
    "bm25_topk": f"""WITH {LINES}, {ASKED_SCOPED}, {BM25}
SELECT question_id, chunk_id, keyword_rank, round(score, 6) AS score FROM keyword_hits""",
    "trgm_similarity_topk": f"""WITH {LINES}, {ASKED_SCOPED},
words AS (
  SELECT 'q' AS side, question_id AS id, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN]+')) AS w FROM asked
  UNION ALL
  SELECT 'c', chunk_id, unnest(regexp_split_to_array(lower(content), '[^\\pL\\pN]+')) FROM lines
),
padded AS (SELECT DISTINCT side, id, '  ' || w || ' ' AS w FROM words WHERE w <> ''),
grams AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i::INT, 3))) AS gram FROM padded
),
sizes AS (SELECT side, id, count(*) AS n FROM grams GROUP BY ALL),
shared AS (
  SELECT q.id AS question_id, c.id AS chunk_id, count(*) AS n
  FROM grams q JOIN grams c USING (gram) WHERE q.side = 'q' AND c.side = 'c' GROUP BY 1, 2
),
scored AS (
  SELECT s.question_id, s.chunk_id, s.n::DOUBLE / (a.n + b.n - s.n) AS similarity
  FROM shared s
  JOIN sizes a ON a.side = 'q' AND a.id = s.question_id JOIN sizes b ON b.side = 'c' AND b.id = s.chunk_id
  JOIN asked k ON k.question_id = s.question_id JOIN lines l ON l.chunk_id = s.chunk_id
  WHERE k.kb_id IS NULL OR k.kb_id = l.kb_id
)
SELECT question_id, chunk_id, keyword_rank, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS keyword_rank
      FROM scored WHERE similarity >= 0.1)
WHERE keyword_rank <= 10""",
    "rrf_fuse": f"""WITH {HYBRID}
SELECT question_id, chunk_id, vector_rank, keyword_rank, round(rrf_score, 6) AS rrf_score, rank FROM fused""",
    "hybrid_retrieve": f"""WITH {HYBRID}
SELECT question_id, rank, chunk_id, doc_id, chunk_index, vector_rank, keyword_rank,
       round(vector_similarity, 6) AS vector_similarity, round(rrf_score, 6) AS rrf_score, length(content) AS n_chars
FROM fused JOIN lines USING (chunk_id) WHERE rank <= 8""",
    "evidence_gate": f"""WITH {HYBRID}, {GATED}
SELECT question_id, candidate_count, round(max_vector_similarity, 6) AS max_vector_similarity, band,
       CASE band WHEN 'sufficient' THEN 'answered' WHEN 'borderline' THEN 'needs_review' ELSE 'insufficient' END AS status
FROM gated""",
    "possible_sources": f"""WITH {HYBRID}, {GATED}
SELECT question_id, rank, chunk_id, round(vector_similarity, 6) AS vector_similarity
FROM fused WHERE rank <= 3 AND question_id IN (SELECT question_id FROM gated WHERE band = 'borderline')""",
    "citation_snapshots": f"""WITH {LINES}, {ASKED}, {BM25},
placed AS (
  SELECT chunk_id, doc_id, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS after, length(content) + 1 AS n
  FROM lines
)
SELECT question_id, keyword_rank AS index, chunk_id, p.doc_id, d.source AS kb_id, 'note-' || p.doc_id AS doc_title,
       sha256(d.text) AS content_hash, p.after - p.n AS char_start, least(p.after, length(d.text)) AS char_end
FROM keyword_hits JOIN placed p USING (chunk_id) JOIN documents d ON d.doc_id = p.doc_id""",
    "graph_pool": f"WITH {_GRAPH.format(size=100)} SELECT kb_id, doc_id, chunk_id, chunk_rank, pool_rank FROM pool",
    "graph_pairs": f"""WITH {_PAIRS}
SELECT kb_id, source_chunk, target_chunk, source_doc, target_doc, round(similarity, 6) AS similarity
FROM near WHERE similarity >= {GRAPH_FLOOR}""",
    "graph_edges": f"""WITH {_PAIRS},
edges AS (
  SELECT kb_id, least(source_doc, target_doc) AS source, greatest(source_doc, target_doc) AS target,
         count(*) AS links, avg(similarity) AS similarity
  FROM near WHERE similarity >= {GRAPH_FLOOR} GROUP BY 1, 2, 3
),
raw AS (SELECT *, similarity * least(1.0, links / 2) AS raw FROM edges)
SELECT kb_id, source, target,
       round_even(raw / coalesce(nullif(max(raw) OVER (PARTITION BY kb_id), 0), 1), 4) AS weight,
       links, round_even(similarity, 4) AS similarity
FROM raw""",
    "graph_nodes": """
WITH counted AS (SELECT doc_id, len(string_split(text, chr(10))) AS chunks FROM documents),
nodes AS (
  SELECT source AS kb_id, doc_id, 'note-' || doc_id AS title, chunks, n_chars AS chars FROM documents JOIN counted USING (doc_id)
)
SELECT *, sum(chunks) OVER (PARTITION BY kb_id) > 400 AS truncated FROM nodes""",
    "graph_threshold_sweep": f"""WITH {_PAIRS},
presets AS (SELECT unnest([0.30::DOUBLE, 0.35, 0.40, 0.45]) AS threshold),
every AS (SELECT DISTINCT kb_id, threshold FROM vecs, presets),
counted AS (
  SELECT e.kb_id, e.threshold, count(DISTINCT (least(source_doc, target_doc), greatest(source_doc, target_doc)))
           FILTER (n.source_chunk IS NOT NULL) AS edges
  FROM every e LEFT JOIN near n ON n.kb_id = e.kb_id AND n.similarity >= e.threshold GROUP BY 1, 2
)
SELECT *, coalesce(edges < lag(edges) OVER (PARTITION BY kb_id ORDER BY threshold), true) AS strictly_fewer FROM counted""",
}
