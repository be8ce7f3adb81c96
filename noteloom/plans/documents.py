"""Document queries: listings, intake, splitting, integrity, digests and text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions import canonical, texts, vectors
from noteloom.operators import chunking, context, images, lines, quality
from noteloom.operators.retrieval import search_bm25
from noteloom.plans import inputs as I
from noteloom.plans.search import LINES
from noteloom.session import checkpointed
from noteloom.sources.intake import intake


def note_table(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the role of the document table; labels give the status."""
    docs = I.table(spark, d, "documents")
    labels = I.table(spark, d, "labels")
    status = (
        F.when(F.col("quality").isNull(), "pending")
        .when(F.col("toxic") == 1, "processing").when(F.col("quality") == 1, "ready").otherwise("failed")
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("kb_id"), F.concat_ws("-", F.lit("note"), "doc_id", "lang").alias("title"),
        status.alias("status"), F.col("n_chars").alias("char_count"), "text",
    )


def kb_doc_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents per base, counting ready ones; a base without any shows 0."""
    notes = note_table(spark, d).select("kb_id", "doc_id", "status")
    bases = notes.select("kb_id").distinct()
    ready = notes.filter(F.col("status") == "ready").groupBy("kb_id").agg(F.count("doc_id").alias("n_ready"))
    total = notes.groupBy("kb_id").agg(F.count("doc_id").alias("n_docs"))
    return bases.join(total, "kb_id", "left").join(ready, "kb_id", "left").select(
        "kb_id", "n_docs", F.coalesce("n_ready", F.lit(0)).cast("bigint").alias("n_ready")
    )


def doc_listing(spark: SparkSession, d: str) -> DataFrame:
    """Ready documents whose title matches, newest first."""
    return (
        note_table(spark, d)
        .filter((F.col("status") == "ready") & texts.title_matches(F.col("title"), "-E_"))
        .select("kb_id", "doc_id", "title", "status", "char_count")
        .orderBy(F.desc("doc_id"))
    )


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Documents per base and status; statuses without documents show 0."""
    counted = note_table(spark, d).select("kb_id", "status").groupBy("kb_id").pivot("status", list(S.DOCUMENT_STATUSES)).count()
    return counted.select("kb_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in S.DOCUMENT_STATUSES])


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploaded files, some with a name or content that must be rejected."""
    n = F.col("doc_id") % 13
    path = (
        F.when(n == 1, F.concat(F.lit("C:\\fakepath\\n"), "doc_id", F.lit(".MD")))
        .when(n == 2, F.concat(F.lit("in/n"), "doc_id", F.lit(".pdf")))
        .when(n == 3, F.concat(F.repeat(F.lit("x"), 260), F.lit(".txt")))
        .otherwise(F.concat(F.lit("in/n"), "doc_id", F.lit(".txt")))
    )
    raw = F.col("text").cast("binary")
    content = (
        F.when(n == 4, F.lit(" \n\t").cast("binary"))
        .when(n == 5, F.concat(raw, F.unhex(F.lit("FF"))))
        .when(n == 6, F.concat(raw, F.unhex(F.lit("00"))))
        .otherwise(raw)
    )
    docs = I.spread(I.table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", path.alias("path"), content.alias("content"))


def intake_gate(spark: SparkSession, d: str) -> DataFrame:
    return intake(_files(spark, d), max_bytes=20_000).select(
        "doc_id", F.coalesce("reason", F.lit("accepted")).alias("verdict"), "char_count"
    )


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    hashed = I.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")
    ).filter(F.col("n_docs") > 1)


def title_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Titles (here: the first line) used twice in one base."""
    docs = I.table(spark, d, "documents").select(
        F.col("source").alias("kb_id"), F.lower(F.split("text", "\n")[0]).alias("title")
    )
    return quality.duplicates(docs, "kb_id", "title")


def line_units(spark: SparkSession, d: str) -> DataFrame:
    return lines.spanned_lines(I.notes(spark, d)).select(
        "doc_id", "chunk_index", "char_start", "char_end", F.sha2("content", 256).alias("content_hash")
    )


def line_pack(spark: SparkSession, d: str) -> DataFrame:
    """Lines folded into chunks of at most 800 characters; longer lines stay whole."""
    spans = chunking.pack_lines(lines.line_spans(F.col("text")), S.CHUNK_TARGET_CHARS, S.CHUNK_UNIT_LIMIT_CHARS)
    return I.notes(spark, d).select("doc_id", F.posexplode_outer(spans).alias("chunk_index", "s")).filter(
        F.col("chunk_index").isNotNull()
    ).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"),
    )


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    split = chunking.split_documents(I.notes(spark, d))
    return chunking.chunk_rows(split, "kb_id").select(
        "doc_id", "kb_id", "chunk_index", "char_start", "char_end", F.sha2("content", 256).alias("content_hash")
    )


def chunk_rejects(spark: SparkSession, d: str) -> DataFrame:
    return chunking.reject_rows(chunking.split_documents(I.notes(spark, d)), "kb_id")


def _rest(column: str) -> Column:
    """All elements but the first."""
    return F.slice(F.col(column), F.lit(2), F.greatest(F.size(column) - 1, F.lit(0)))


def sentence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per document cover the whole text: kept with oversized sentences whole."""
    split = chunking.split_documents(I.notes(spark, d), on_oversize="keep")
    return split.select(
        "doc_id", F.get("spans", F.lit(0))["start"].alias("first_char"),
        F.element_at("spans", -1)["end"].alias("last_char"),
        F.size(F.filter(
            F.zip_with("spans", _rest("spans"), lambda a, b: b["start"] > a["end"]), lambda gap: gap
        )).cast("bigint").alias("gaps"),
    )


def _damaged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Line chunks with faults at fixed places."""
    c = lines.spanned_lines(I.notes(spark, d), "kb_id")
    n = F.col("chunk_id")
    return c.withColumns({
        "doc_id": F.when(n % 101 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")),
        "kb_id": F.when(n % 83 == 0, F.lit("elsewhere")).otherwise(F.col("kb_id")),
        "char_end": F.when(n % 89 == 0, F.col("char_end") + 1_000_000).when(n % 79 == 0, F.col("char_end") - 1).otherwise(F.col("char_end")),
        "content": F.when(n % 97 == 0, F.reverse("content")).otherwise(F.col("content")),
    })


def chunk_integrity(spark: SparkSession, d: str) -> DataFrame:
    return quality.chunk_problems(_damaged_chunks(spark, d), I.notes(spark, d))


def chunk_index_contiguity(spark: SparkSession, d: str) -> DataFrame:
    c = I.note_lines(spark, d)
    kept = c.filter((F.col("doc_id") % 10 != 3) | (F.col("chunk_index") != 1))
    docs = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count")).withColumns({
        "status": F.lit("ready"),
        "chunk_count": F.when(F.col("doc_id") % 10 == 4, F.col("chunk_count") + 1)
        .when((F.col("doc_id") % 10 == 3) & (F.col("chunk_count") > 1), F.col("chunk_count") - 1)
        .otherwise(F.col("chunk_count")),
    })
    return quality.index_problems(kept, docs)


def reconstruct_source(spark: SparkSession, d: str) -> DataFrame:
    """Rebuild documents from chunks of two lines each; some chunks are missing or wrong."""
    docs = I.notes(spark, d)
    spans = lines.line_spans(F.col("text"))
    two = docs.select("doc_id", spans.alias("s")).select(
        "doc_id",
        F.posexplode(F.zip_with("s", F.concat(_rest("s"), F.array(F.lit(None).cast(
            "struct<start:bigint,end:bigint,content:string>"))), lambda a, b: F.struct(
            a["start"].alias("start"), F.coalesce(b["end"], a["end"]).alias("end"),
            F.concat(a["content"], F.coalesce(b["content"], F.lit(""))).alias("content"),
        ))).alias("i", "c"),
    ).select(
        "doc_id", F.col("i").cast("bigint").alias("chunk_id"), F.col("c.start").alias("char_start"),
        F.col("c.end").alias("char_end"),
        F.when((F.col("doc_id") % 11 == 0) & (F.col("i") == 1), F.reverse("c.content")).otherwise(F.col("c.content")).alias("content"),
    ).filter((F.col("doc_id") % 7 != 0) | ~F.col("chunk_id").isin(1, 2))
    sizes = docs.select("doc_id", F.length("text").cast("bigint").alias("char_count"))
    return quality.reconstruct(two, sizes).select(
        "doc_id", F.coalesce("code", F.lit("whole")).alias("verdict"), F.sha2("text", 256).alias("text_hash")
    )


def expanded_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of the eight best keyword hits per question, over chunks that cut sentences."""
    docs = I.notes(spark, d)
    chunks = chunking.chunk_rows(chunking.split_documents(docs, on_oversize="keep"), "kb_id").withColumn(
        "chunk_id", lines.line_id(F.col("doc_id"), F.col("chunk_index"))
    )
    chunks = checkpointed(chunks)  # read five times below; a real index is a stored table
    hits = search_bm25(I.questions(spark, d), chunks, S.RETRIEVE_TOP_K).withColumnRenamed("keyword_rank", "rank")
    sizes = docs.select("doc_id", "kb_id", F.length("text").cast("bigint").alias("char_count"))
    return context.expand_evidence(hits, chunks, sizes).select(
        "question_id", "place", "chunk_id", "is_anchor", F.array_join("context_chunk_ids", ",").alias("context_ids"), "problem"
    )


def dependency_islands(spark: SparkSession, d: str) -> DataFrame:
    """Lines as units; short lines act as headings."""
    units = I.note_lines(spark, d).select(
        "doc_id", F.lit(0).alias("section"), F.col("chunk_index").alias("unit"),
        (F.length("content") < 20).alias("heading"), texts.depends_on_previous(F.col("content")).alias("dependent"),
    )
    return context.dependency_islands(units).select("doc_id", "unit", "head", "tail", "headless")


def image_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Ten-character spans around line ends, joined to the packed chunks they touch."""
    docs = I.notes(spark, d)
    spans = lines.spanned_lines(docs)
    occurrences = spans.select(
        "doc_id", F.col("chunk_index").alias("ordinal"),
        F.greatest(F.col("char_end") - 5, F.lit(0)).alias("char_start"), (F.col("char_end") + 5).alias("char_end"),
    )
    return images.images_in_chunks(line_pack(spark, d), occurrences).select("doc_id", "chunk_index", "ordinal")


def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """Markdown images written around the first line of each document, inside and outside code."""
    first = F.regexp_replace(F.split("text", "\n")[0], r"[\[\]()!`\\<>]", "")
    text = F.concat(
        F.lit("![a"), F.col("doc_id").cast("string"), F.lit("](img/"), F.col("doc_id").cast("string"), F.lit(".png) "), first,
        F.lit("\n```\n![no](x.png)\n```\n![b][r]\n\n[r]: <../up.png>\n"),
    )
    found = images.occurrence_table(I.notes(spark, d).withColumn("md", text).select("doc_id", "md"), "md")
    return images.resolve_references(
        found.withColumn("base", F.lit("notes/n.md")), "base", "source_reference"
    ).select("doc_id", "ordinal", "source_reference", "alt_text", "char_start", "char_end", "asset_source_path")


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    shown = texts.redact(F.col("text"))
    return I.notes(spark, d).select(
        "doc_id", (shown != F.col("text")).alias("changed"), F.length(shown).cast("bigint").alias("n_chars"),
        F.sha2(shown, 256).alias("redacted_hash"),
    )


def question_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as questions: why some are not acceptable."""
    return I.table(spark, d, "conversations").select(
        "conv_id", "turn", F.coalesce(texts.question_error(F.col("text")), F.lit("ok")).alias("verdict")
    )


def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors with faults at fixed places, judged."""
    e = F.col("embedding").cast("array<double>")
    n = F.col("vec_id") % 7
    damaged = (
        F.when(n == 1, F.slice(e, 1, 63)).when(n == 2, F.transform(e, lambda x: F.lit(float("inf"))))
        .when(n == 3, F.transform(e, lambda x: F.lit(float("nan")))).otherwise(e)
    )
    return I.table(spark, d, "embeddings").select(
        "vec_id", vectors.is_valid_vector(damaged, 64).alias("valid")
    )


def path_check(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages as source paths: which are canonical and relative."""
    path = F.regexp_replace("url", r"^https?://", "")
    return I.table(spark, d, "pages").select("page_id", canonical.is_relative_source_path(path).alias("canonical"))


def profile_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "documents").select(
        "doc_id", canonical.fingerprint(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("fingerprint")
    )


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without a document of the same number."""
    e = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("label"))
    return quality.orphans(e, I.table(spark, d, "documents").select("doc_id"), "doc_id")


def table_digest(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256")
    )
    parts = [
        quality.table_digest(docs, "doc_id", "documents"),
        quality.table_digest(I.table(spark, d, "labels"), "doc_id", "labels"),
        quality.table_digest(I.table(spark, d, "nation"), "n_nationkey", "nation"),
        quality.table_digest(I.table(spark, d, "region"), "r_regionkey", "region"),
    ]
    return reduce(DataFrame.unionByName, parts)


def digest_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Which ranges of documents differ once they are redacted and short ones are rejected; keys are packed, eight documents a range."""
    docs = I.table(spark, d, "documents").select(F.shiftleft("doc_id", 9).alias("key"), "text")
    hashed = lambda text: F.sha2(text, 256).alias("text_sha256")
    redacted = docs.where(F.length("text") >= 100).select("key", hashed(texts.redact(F.col("text"))))
    return quality.table_differences(docs.select("key", hashed(F.col("text"))), redacted, "key")


def package_hash(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as packages whose turns are the files."""
    entries = I.table(spark, d, "conversations").select(
        F.col("conv_id").alias("package"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"),
        F.octet_length("text").alias("length"), F.sha2("text", 256).alias("sha256"),
    )
    return quality.package_hash(entries)


QUERIES = {
    f.__name__: f
    for f in (
        kb_doc_counts, doc_listing, status_histogram, intake_gate, content_hash, duplicate_content, title_conflicts,
        line_units, line_pack, chunk_markdown, chunk_rejects, sentence_coverage, chunk_integrity,
        chunk_index_contiguity, reconstruct_source, expanded_context, dependency_islands, image_overlap_join,
        image_scan, redact_text, question_cleaning, vector_validity, path_check, profile_fingerprint, orphan_rows,
        table_digest, digest_ranges, package_hash,
    )
}

# ---------------------------------------------------------------- equivalent SQL

_NOTES = """notes AS (
  SELECT doc_id, source AS kb_id, 'note-' || doc_id || '-' || lang AS title, n_chars AS char_count,
         CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'processing' WHEN quality = 1 THEN 'ready' ELSE 'failed' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)
)"""

SPANS = """spans AS (
  SELECT doc_id, kb_id, chunk_index, content, char_end - length(content) AS char_start, char_end
  FROM (
    SELECT doc_id, kb_id, chunk_index, content,
           sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS char_end
    FROM (
      SELECT doc_id, kb_id, i AS chunk_index, CASE WHEN i < n - 1 THEN l || chr(10) ELSE l END AS content
      FROM (SELECT doc_id, source AS kb_id, unnest(string_split(text, chr(10))) AS l,
                   unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents)
    ) WHERE content <> ''
  )
)"""

_PACK = SPANS + """,
fold AS (
  SELECT doc_id, chunk_index, char_end, 0::BIGINT AS pack, char_start AS first FROM spans WHERE chunk_index = 0
  UNION ALL
  SELECT s.doc_id, s.chunk_index, s.char_end,
         CASE WHEN s.char_end - f.first <= 800 THEN f.pack ELSE f.pack + 1 END,
         CASE WHEN s.char_end - f.first <= 800 THEN f.first ELSE s.char_start END
  FROM fold f JOIN spans s ON s.doc_id = f.doc_id AND s.chunk_index = f.chunk_index + 1
),
packs AS (
  SELECT doc_id, pack AS chunk_index, min(first) AS char_start, max(char_end) AS char_end FROM fold GROUP BY 1, 2
)"""


def _level(source: str, key: str) -> str:
    return f"SELECT name, {key} AS k, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM {source} GROUP BY 1, 2"


_REDACTED = r"""
WITH r AS (
  SELECT doc_id, text,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '(?i)\bBearer\s+[^\s,;]+', 'Bearer [REDACTED]', 'g'),
      '(?i)\bBasic\s+[A-Za-z0-9._~+/=-]+', 'Basic [REDACTED]', 'g'),
      '(?i)(["'']?(?:api[_-]?key|access[_-]?token|token|secret|authorization)["'']?\s*[:=]\s*["'']?)[^"'',\s}\]]+', '\1[REDACTED]', 'g'),
      '(://)[^/@\s:]+:[^/@\s]+@', '\1[REDACTED]@', 'g') AS shown
  FROM documents
)"""

ORACLES = {
    "kb_doc_counts": f"""WITH {_NOTES}
SELECT kb_id, count(*) AS n_docs, count(*) FILTER (status = 'ready') AS n_ready FROM notes GROUP BY 1""",
    "doc_listing": f"""WITH {_NOTES}
SELECT kb_id, doc_id, title, status, char_count FROM notes WHERE status = 'ready' AND title ILIKE '%-E_%'""",
    "status_histogram": f"""WITH {_NOTES}
SELECT kb_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
       count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed FROM notes GROUP BY 1""",
    "intake_gate": """
WITH f AS (SELECT doc_id, doc_id % 13 AS n, length(text) AS chars, strlen(text) + CASE WHEN doc_id % 13 IN (5, 6) THEN 1 ELSE 0 END AS bytes FROM documents),
v AS (
  SELECT doc_id, chars, CASE WHEN n = 3 THEN 'name_too_long' WHEN n = 2 THEN 'unsupported_type'
         WHEN n <> 4 AND bytes > 20000 THEN 'too_large' WHEN n = 4 THEN 'empty' WHEN n = 5 THEN 'not_utf8'
         WHEN n = 6 THEN 'nul' ELSE 'accepted' END AS verdict FROM f
)
SELECT doc_id, verdict, CASE WHEN verdict = 'accepted' THEN chars END AS char_count FROM v""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "duplicate_content": """SELECT sha256(text) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "title_conflicts": """SELECT source AS kb_id, lower(string_split(text, chr(10))[1]) AS title, count(*) AS n
FROM documents GROUP BY 1, 2 HAVING count(*) > 1""",
    "line_units": f"""WITH {SPANS}
SELECT doc_id, chunk_index, char_start, char_end, sha256(content) AS content_hash FROM spans""",
    "line_pack": f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk_index, char_start, char_end FROM packs",
    "sentence_coverage": "SELECT doc_id, 0::BIGINT AS first_char, length(text) AS last_char, 0::BIGINT AS gaps FROM documents",
    "chunk_integrity": f"""WITH {SPANS},
damaged AS (
  SELECT id AS chunk_id, CASE WHEN id % 101 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id,
         CASE WHEN id % 83 = 0 THEN 'elsewhere' ELSE kb_id END AS kb_id, char_start,
         CASE WHEN id % 89 = 0 THEN char_end + 1000000 WHEN id % 79 = 0 THEN char_end - 1 ELSE char_end END AS char_end,
         CASE WHEN id % 97 = 0 THEN reverse(content) ELSE content END AS content
  FROM (SELECT *, (doc_id << 27) | chunk_index AS id FROM spans)
),
judged AS (
  SELECT c.chunk_id, c.doc_id, CASE WHEN d.doc_id IS NULL THEN 'document_missing' WHEN c.kb_id <> d.source THEN 'kb_mismatch'
    WHEN char_start < 0 OR char_end <= char_start OR char_end > length(d.text) THEN 'span_out_of_bounds'
    WHEN length(content) <> char_end - char_start THEN 'length_mismatch'
    WHEN substring(d.text, char_start + 1, char_end - char_start) <> content THEN 'content_mismatch' END AS code
  FROM damaged c LEFT JOIN documents d ON d.doc_id = c.doc_id
)
SELECT chunk_id, doc_id, code FROM judged WHERE code IS NOT NULL""",
    "chunk_index_contiguity": f"""WITH {LINES},
stored AS (
  SELECT doc_id, count(*) + CASE WHEN doc_id % 10 = 4 THEN 1 WHEN doc_id % 10 = 3 AND count(*) > 1 THEN -1 ELSE 0 END AS chunk_count
  FROM lines GROUP BY doc_id
),
have AS (
  SELECT doc_id, count(*) AS chunks, min(chunk_index) AS lo, max(chunk_index) AS hi, count(DISTINCT chunk_index) AS u
  FROM lines WHERE doc_id % 10 <> 3 OR chunk_index <> 1 GROUP BY doc_id
)
SELECT doc_id, chunks, code FROM (
  SELECT doc_id, chunks, CASE WHEN chunks <> chunk_count THEN 'count_mismatch'
    WHEN lo <> 0 OR hi <> chunks - 1 OR u <> chunks THEN 'index_not_contiguous' END AS code
  FROM stored JOIN have USING (doc_id)
) WHERE code IS NOT NULL""",
    "reconstruct_source": f"""WITH {SPANS},
two AS (
  SELECT doc_id, chunk_index, char_start, coalesce(lead(char_end) OVER w, char_end) AS char_end,
         content || coalesce(lead(content) OVER w, '') AS content
  FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)
),
kept AS (
  SELECT doc_id, chunk_index, char_start, char_end,
         CASE WHEN doc_id % 11 = 0 AND chunk_index = 1 THEN reverse(content) ELSE content END AS content
  FROM two WHERE doc_id % 7 <> 0 OR chunk_index NOT IN (1, 2)
),
seen AS (
  SELECT *, coalesce(max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM kept
),
built AS (
  SELECT doc_id, bool_or(char_start > seen) AS gap,
         coalesce(string_agg(CASE WHEN char_end > seen THEN substring(content, seen - char_start + 1) END, '' ORDER BY char_start), '') AS text
  FROM seen GROUP BY doc_id
),
conflicts AS (
  SELECT k.doc_id, bool_or(substring(b.text, k.char_start + 1, length(k.content)) <> k.content) AS conflict
  FROM kept k JOIN built b USING (doc_id) GROUP BY 1
),
judged AS (
  SELECT doc_id, b.text, CASE WHEN gap THEN 'gap' WHEN length(b.text) <> length(d.text) THEN 'length_mismatch'
         WHEN conflict THEN 'conflict' ELSE 'whole' END AS verdict
  FROM documents d JOIN built b USING (doc_id) JOIN conflicts USING (doc_id)
)
SELECT doc_id, verdict, CASE WHEN verdict = 'whole' THEN sha256(text) END AS text_hash FROM judged""",
    "dependency_islands": f"""WITH {LINES},
u AS (
  SELECT doc_id, chunk_index AS unit, length(content) < 20 AS heading,
         regexp_matches(ltrim(content, ' ' || chr(9) || chr(13) || chr(10) || '>*-0123456789.)'),
           '(?i){texts.DEPENDENT_START_PATTERN}') AS dependent
  FROM lines
),
s AS (SELECT *, NOT dependent OR coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY unit), true) AS starts FROM u),
h AS (
  SELECT *, max(CASE WHEN starts THEN unit END) OVER (PARTITION BY doc_id ORDER BY unit) AS head,
         coalesce(min(CASE WHEN NOT dependent THEN unit END) OVER (
             PARTITION BY doc_id ORDER BY unit ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1,
           max(unit) OVER (PARTITION BY doc_id)) AS tail
  FROM s
)
SELECT h.doc_id, h.unit, h.head, h.tail, b.dependent AS headless FROM h JOIN u b ON b.doc_id = h.doc_id AND b.unit = h.head""",
    "image_overlap_join": f"""WITH RECURSIVE {_PACK}
SELECT p.doc_id, p.chunk_index, s.chunk_index AS ordinal
FROM packs p JOIN spans s ON s.doc_id = p.doc_id AND s.char_end + 5 > p.char_start AND greatest(s.char_end - 5, 0) < p.char_end""",
    "image_scan": """
WITH t AS (SELECT doc_id, 'img/' || doc_id || '.png' AS ref, 'a' || doc_id AS alt,
  regexp_replace(string_split(text, chr(10))[1], '[\\[\\]()!`\\\\<>]', '', 'g') AS line FROM documents),
s AS (SELECT *, length('![' || alt || '](' || ref || ')') AS first_end FROM t)
SELECT doc_id, 1::BIGINT AS ordinal, ref AS source_reference, alt AS alt_text, 0::BIGINT AS char_start, first_end AS char_end,
       'notes/' || ref AS asset_source_path FROM s
UNION ALL
SELECT doc_id, 2, '../up.png', 'b', first_end + 1 + length(line) + 22, first_end + 1 + length(line) + 29, 'up.png' FROM s""",
    "redact_text": _REDACTED + """
SELECT doc_id, shown <> text AS changed, length(shown) AS n_chars, sha256(shown) AS redacted_hash FROM r""",
    "question_cleaning": """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 500 THEN 'too_long' ELSE 'ok' END AS verdict
FROM conversations""",
    "vector_validity": "SELECT vec_id, vec_id % 7 NOT IN (1, 2, 3) AS valid FROM embeddings",
    "path_check": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, length(path) BETWEEN 1 AND 500 AND NOT contains(path, ':') AND NOT contains(path, '\')
  AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS canonical FROM p""",
    "profile_fingerprint": """SELECT doc_id, sha256('{"lang":' || to_json(lang) || ',"n_chars":' || n_chars || ',"source":' || to_json(source) || '}') AS fingerprint
FROM documents""",
    "orphan_rows": """SELECT vec_id AS doc_id, label::BIGINT AS label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
    "table_digest": f"""
WITH r AS (
  SELECT 'documents' AS name, doc_id AS k, 1 AS n, sha256('{{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"n_chars":' || n_chars
    || ',"source":' || to_json(source) || ',"text_sha256":"' || sha256(text) || '"}}') AS h FROM documents
  UNION ALL SELECT 'labels', doc_id, 1, sha256('{{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}}') FROM labels
  UNION ALL SELECT 'nation', n_nationkey, 1, sha256('{{"n_name":' || to_json(n_name) || ',"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}}') FROM nation
  UNION ALL SELECT 'region', r_regionkey, 1, sha256('{{"r_name":' || to_json(r_name) || ',"r_regionkey":' || r_regionkey || '}}') FROM region
),
a AS ({_level('(SELECT name, k, n, h FROM r)', 'k >> 12')}),
b AS ({_level('a', 'k >> 12')}),
c AS ({_level('b', '0')})
SELECT name AS table_name, n::BIGINT AS n_rows, h AS sha256 FROM c""",
    "digest_ranges": _REDACTED + """
SELECT doc_id >> 3 << 12 AS first_key, (doc_id >> 3 << 12) + 4095 AS last_key, count(*) AS left_rows, count(*) FILTER (length(text) >= 100) AS right_rows
FROM r GROUP BY doc_id >> 3 HAVING bool_or(shown <> text OR length(text) < 100)""",
    "package_hash": """
SELECT conv_id AS package, sha256(string_agg(strlen('t' || turn) || chr(0) || 't' || turn || chr(0) || strlen(text) || chr(0) || sha256(text), chr(10) ORDER BY 't' || turn)) AS package_hash
FROM conversations GROUP BY 1""",
}
