"""Maintenance, task, session and answer audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import texts
from noteloom.operators import audit, lines, maintenance, sessions
from noteloom.plans import inputs as I

SESSION_GAP = 12 * 3600


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Documents as catalogue records; every sixth has a source waiting."""
    docs = I.table(spark, d, "documents").filter(F.col("doc_id") % 17 != 0)
    record = lambda tag, extra: F.struct(
        F.concat(F.col("source"), F.lit(f"/{tag}-"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2(F.concat(F.lit(extra), F.col("text")), 256).alias("content_hash"),
        F.col("n_chars").alias("char_count"), F.octet_length("text").cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("mtime_ns"),
    )
    return docs.select(
        "doc_id", F.col("source").alias("kb_id"), F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("title"),
        F.lit(2).cast("bigint").alias("ingest_version"), record("v1", "").alias("active"),
        F.when(F.col("doc_id") % 6 == 5, record("v2", "new ")).alias("pending"), F.lit(0).alias("created_at"),
        F.lit(0).alias("updated_at"),
    )


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The same documents as index rows, some older, changed, renamed or missing."""
    docs = I.table(spark, d, "documents").filter(F.col("doc_id") % 6 != 4)
    n = F.col("doc_id") % 6
    path = lambda tag: F.concat(F.col("source"), F.lit(f"/{tag}-"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", F.col("source").alias("kb_id"),
        F.concat(F.when(n == 3, "renamed-").otherwise("note-"), F.col("doc_id").cast("string")).alias("title"),
        F.when(n == 1, 1).otherwise(2).cast("bigint").alias("ingest_version"), path("v1").alias("file_path"),
        F.sha2(F.concat(F.when(n.isin(1, 2), "old ").otherwise(""), F.col("text")), 256).alias("content_hash"),
        F.col("n_chars").alias("char_count"), F.when(n == 5, path("v2")).alias("pending_file_path"),
        F.when(n == 5, F.sha2(F.concat(F.lit("new "), F.col("text")), 256)).alias("pending_content_hash"),
        F.when(n == 5, F.col("n_chars")).alias("pending_char_count"), F.lit(0).alias("created_at"),
        F.when(n == 0, "ready").when(n == 1, "failed").when(n == 2, "processing").otherwise("pending").alias("status"),
        F.when(n == 1, 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("chunk_count"),
    )


def sync_classify(spark: SparkSession, d: str) -> DataFrame:
    """Relation and sync action per document, given what became of its source file."""
    observed = I.table(spark, d, "documents").select(
        "doc_id",
        F.get(F.array(*[F.lit(v) for v in ("same", "touched", "changed", "missing", "same")]), (F.col("doc_id") % 5).cast("int")).alias("verdict"),
    )
    plan = maintenance.plan_sync(_catalogue(spark, d), _index(spark, d), observed)
    return plan.select("doc_id", "relation", "action", "ingest_version")


def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    observed = I.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 2, "changed").otherwise("touched").alias("verdict"))
    return maintenance.sync_summary(maintenance.plan_sync(_catalogue(spark, d), _index(spark, d), observed))


def source_changes(spark: SparkSession, d: str) -> DataFrame:
    """Compare the catalogue with files that were touched, edited, emptied or removed."""
    catalogue = _catalogue(spark, d)
    n = F.col("doc_id") % 9
    raw = F.col("text").cast("binary")
    files = I.table(spark, d, "documents").filter(n != 3).select(
        F.concat(F.col("source"), F.lit("/v1-"), F.col("doc_id").cast("string")).alias("path"),
        F.when(n == 4, F.concat(raw, F.lit("!").cast("binary"))).when(n == 5, F.lit(" \n").cast("binary"))
        .when(n == 6, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw).alias("content"),
        F.when(n.isin(2, 4, 5, 6), 2).otherwise(1).cast("bigint").alias("mtime_ns"),
    ).withColumn("size", F.octet_length("content").cast("bigint"))
    seen = maintenance.suspects(files.select("path", "size", "mtime_ns"), catalogue)
    doubtful = maintenance.observe(seen.filter(F.col("verdict") == "suspect"), files)
    settled = seen.filter(F.col("verdict") != "suspect").select("doc_id", "verdict", F.lit(None).cast("bigint").alias("char_count"))
    return settled.unionByName(doubtful.select("doc_id", "verdict", F.col("observed.char_count").alias("char_count")))


def reupload_decide(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 5
    incoming = I.table(spark, d, "documents").select(
        "doc_id",
        F.sha2(F.concat(F.when(m == 0, "old ").when(m == 1, "new ").when(m == 2, "newer ").otherwise(""), F.col("text")), 256).alias("new_hash"),
    )
    return maintenance.decide_reupload(incoming, _index(spark, d)).select(
        "doc_id", "outcome", "content_changed", "next_status", "next_version"
    )


def failure_marks(spark: SparkSession, d: str) -> DataFrame:
    """A failed build for every third document; some reports are of an older version."""
    docs = _index(spark, d).withColumns({
        "last_error_code": F.lit(None).cast("string"), "last_error_message": F.lit(None).cast("string"),
    })
    chunks = I.note_lines(spark, d).filter(F.col("doc_id") % 4 != 0).select("doc_id", "chunk_id")
    failed = docs.filter(F.col("doc_id") % 3 == 2).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(F.col("ingest_version")).cast("bigint").alias("ingest_version"),
        F.col("pending_file_path").alias("candidate_path"), F.lit("BUILD").alias("code"), F.lit("failed").alias("message"),
    )
    return maintenance.mark_failures(failed, docs, chunks).select(
        "doc_id", "status", "last_error_code", F.col("pending_file_path").isNotNull().alias("still_pending")
    )


def stale_results(spark: SparkSession, d: str) -> DataFrame:
    """Build results that came too late: their version is no longer wanted."""
    results = _catalogue(spark, d).select("doc_id", (F.lit(1) + F.col("doc_id") % 2).cast("bigint").alias("ingest_version"))
    _, late = maintenance.split_current(results, _index(spark, d))
    return late.select("doc_id", "ingest_version")


def rebuild_promote(spark: SparkSession, d: str) -> DataFrame:
    promoted = maintenance.promote_pending(_catalogue(spark, d))
    return promoted.select(
        "doc_id", F.col("active.path").alias("path"), F.col("active.content_hash").alias("content_hash"),
        F.col("pending").isNull().alias("nothing_pending"),
    )


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table after removing one base and every tenth document."""
    docs = _index(spark, d).select("doc_id", "kb_id")
    chunks = I.note_lines(spark, d).join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "chunk_id")
    bases = docs.filter(F.col("kb_id") == "src3").select("kb_id").distinct()
    gone = docs.filter(F.col("doc_id") % 10 == 0).select("doc_id")
    kept, left_chunks, left_tasks = maintenance.cascade_delete(docs, chunks, docs.select("doc_id"), bases, gone)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
    return count(kept, "documents").unionByName(count(left_chunks, "chunks")).unionByName(count(left_tasks, "tasks"))


def catalogue_differences(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue against itself with new file times everywhere and new sizes in some rows."""
    c = _catalogue(spark, d)
    other = c.withColumn("active", F.col("active").withField("mtime_ns", F.lit(9).cast("bigint")).withField(
        "size", F.col("active.size") + F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0)))
    return maintenance.catalogue_differences(c, other)


def _task_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as task events: the user is the document, a thousand events make a version."""
    kinds = {"view": "queue", "click": "claim", "purchase": "succeed", "error": "fail", "signup": "recover"}
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("event_type")]
    return I.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), (F.floor(F.col("event_id") / 1000) + 1).alias("ingest_version"),
        F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.floor(F.col("value")).cast("string"))).alias("error_code"),
    )


def task_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.latest_tasks(_task_events(spark, d))


def task_recover(spark: SparkSession, d: str) -> DataFrame:
    """Recovery of the tasks above against documents in all states."""
    tasks = maintenance.latest_tasks(_task_events(spark, d)).withColumn("candidate_path", F.lit(None).cast("string"))
    n = F.col("doc_id")
    docs = tasks.select(
        "doc_id", (F.col("ingest_version") + F.when(n % 3 == 0, 1).otherwise(0)).alias("ingest_version"),
        F.when(n % 4 == 0, "pending").when(n % 4 == 1, "ready").when(n % 4 == 2, "failed").otherwise("ready").alias("status"),
        F.when(n % 7 == 0, F.concat(F.lit("p"), n.cast("string"))).alias("pending_file_path"),
        F.when(n % 4 == 2, "BROKEN").when(n % 8 == 3, "LATE").alias("last_error_code"),
    )
    return maintenance.recover_tasks(tasks, docs)


def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    return sessions.expire_sessions(I.table(spark, d, "events"), "user_id", "ts", SESSION_GAP)


def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    c = I.table(spark, d, "conversations")
    return sessions.last_turns(c, 5, "conv_id").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


def usable_history(spark: SparkSession, d: str) -> DataFrame:
    """Turns that may be shown to the next question: answered, sources at hand, last six."""
    turns = I.table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.lit(" why? ").alias("question"), F.col("text").alias("answer"),
        F.when(F.col("role") == "system", "insufficient").otherwise("answered").alias("status"),
        F.when(F.col("turn") % 5 == 4, 1).otherwise(0).alias("unavailable_sources"),
    )
    return sessions.usable_history(turns).select("session_id", "turn", F.length("answer").cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- answers


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as answers, with citation markers set by their number."""
    answer_id = F.col("conv_id") * 1_000_000 + F.col("turn")
    m = (F.col("conv_id") * 100 + F.col("turn")) % 8
    content = (
        F.when(m == 0, F.concat("text", F.lit(" [1]"))).when(m == 1, F.concat(F.lit("[2] "), "text", F.lit(" [1][2]")))
        .when(m == 2, F.concat("text", F.lit(" [9] [1]"))).when(m == 3, F.col("text"))
        .when(m == 4, F.concat("text", F.lit(" 资料不足"))).when(m == 5, F.concat(F.lit(" 上下文不足 "), "text", F.lit(" [1]")))
        .when(m == 6, F.concat("text", F.lit(" [3]"))).otherwise(F.concat("text", F.lit(" [2]")))
    )
    first = answer_id * 10
    cite = lambda i, *needs: F.struct(
        F.lit(i).cast("bigint").alias("index"), (first + i).alias("chunk_id"),
        (F.array(*[first + n for n in needs]) if needs else F.array().cast("array<bigint>")).alias("context_chunk_ids"),
    )
    return I.table(spark, d, "conversations").select(
        answer_id.alias("answer_id"), content.alias("content"), F.lit(3).cast("bigint").alias("provided_count"),
        # 1 needs 2, 2 needs nothing, 3 needs a chunk that was not provided.
        F.array(cite(1, 2), cite(2), cite(3, 7)).alias("citations"),
    )


def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return a.select("answer_id", F.posexplode(texts.citation_numbers(F.col("content"))).alias("place", "number")).select(
        "answer_id", F.col("place").cast("bigint").alias("place"), "number"
    )


def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    audited = audit.audit_answers(_answers(spark, d))
    stale = audited.select((F.col("answer_id") * 10 + 2).alias("chunk_id")).filter(F.col("chunk_id") % 3 == 0)
    return audit.withdraw_stale(audited, stale).select(
        "answer_id", F.coalesce("reason", F.lit("none")).alias("reason"), "status",
        F.array_join(F.coalesce("cited", F.array().cast("array<bigint>")), ",").alias("cited"),
        F.array_join("out_of_range", ",").alias("out_of_range"),
    )


def citation_renumber(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as workflows: each turn is a step that cites up to three chunks."""
    step_id = F.col("conv_id") * 1_000_000 + F.col("turn")
    cite = lambda i: F.struct(
        F.lit(i).cast("bigint").alias("index"), ((step_id * 7 + i * 3) % 10).alias("chunk_id"),
        F.when(step_id % 11 == 0, F.lit(5)).otherwise(F.lit(1)).cast("bigint").alias("doc_id"),
    )
    steps = I.table(spark, d, "conversations").select(
        F.col("conv_id").alias("workflow_id"), F.col("turn").cast("int").alias("step"),
        F.when(F.col("role") == "system", "insufficient").otherwise("answered").alias("status"),
        F.when(step_id % 9 == 0, "a [4]").otherwise("see [2], then [1] and [3]").alias("conclusion"),
        F.array(cite(1), cite(2), cite(3)).alias("citations"),
    )
    return audit.synthesise(steps).select(
        "workflow_id", "step", "valid", "conclusion", F.array_join("numbers", ",").alias("numbers"),
        F.size("sources").cast("bigint").alias("n_sources"),
    )


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of all lines against an index in which some lines and documents changed."""
    now = lines.spanned_lines(I.notes(spark, d).withColumn("content_hash", F.sha2("text", 256)), "kb_id", "content_hash")
    docs = I.table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("kb_id"),
        F.sha2(F.concat("text", F.when(F.col("doc_id") % 41 == 0, "!").otherwise("")), 256).alias("content_hash"),
    )
    n = F.col("chunk_id")
    shots = now.withColumn("scope_kb", F.when(n % 53 == 0, "src1"))
    current = now.drop("content_hash").filter(n % 59 != 0).withColumn("content", F.when(n % 61 == 0, F.upper("content")).otherwise(F.col("content")))
    return audit.stale_sources(shots, current, docs)


def sources_by_document(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).select("answer_id", F.explode("citations").alias("c")).select(
        "answer_id", (F.col("c.chunk_id") % 2).alias("doc_id"), F.col("c.chunk_id").alias("chunk_id"), F.col("c.index").alias("index")
    )
    return audit.sources_by_document(a).select("answer_id", "doc_id", F.array_join("numbers", ",").alias("numbers"), "first")


def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each conversation, once each, in order of first use."""
    c = I.table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), (F.col("turn") % 3).alias("chunk_id"),
        F.concat(F.lit("a  [b] "), F.col("role")).alias("doc_title"), F.col("turn").alias("char_start"),
        F.length("text").cast("bigint").alias("char_end"),
    )
    return audit.list_sources(c)


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Recorded snapshots of lines by number: numbers recorded with two contents are withdrawn."""
    recorded = I.note_lines(spark, d).select(
        "doc_id", (F.col("doc_id") * 10 + F.col("chunk_index") % 10).alias("chunk_id"), "chunk_index", "content"
    )
    good, _ = audit.quarantine(recorded, "doc_id", "content")
    return good.select("doc_id", "chunk_id", "chunk_index")


QUERIES = {
    f.__name__: f
    for f in (
        sync_classify, sync_summary, source_changes, reupload_decide, failure_marks, stale_results, rebuild_promote,
        cascade_delete, catalogue_differences, task_latest_version, task_recover, session_ttl, last_n_turns,
        usable_history, citation_parse, citation_audit, citation_renumber, stale_sources, sources_by_document,
        source_listing, quarantine,
    )
}

# ---------------------------------------------------------------- equivalent SQL

_RELATION = """
rel AS (
  SELECT doc_id, doc_id % 6 AS n, CASE WHEN doc_id % 17 = 0 THEN 'only_index' WHEN doc_id % 6 = 4 THEN 'only_catalogue'
    WHEN doc_id % 6 = 3 THEN 'identity_mismatch' WHEN doc_id % 6 = 1 THEN 'behind' WHEN doc_id % 6 = 2 THEN 'conflict' ELSE 'aligned' END AS relation
  FROM documents WHERE NOT (doc_id % 17 = 0 AND doc_id % 6 = 4)
)"""

_TASKS = """
ev AS (
  SELECT user_id AS doc_id, event_id // 1000 + 1 AS v, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'queue' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'recover' END AS kind,
         CASE WHEN event_type = 'error' THEN 'E' || floor(value)::BIGINT END AS code
  FROM events
),
cur AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM ev QUALIFY v = max(v) OVER (PARTITION BY doc_id)),
cur2 AS (SELECT doc_id, v, kind, code, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM cur),
run AS (
  SELECT DISTINCT doc_id, v, 0::BIGINT AS r, 'queued' AS status, 0::BIGINT AS attempts, 0::BIGINT AS recoveries, NULL::VARCHAR AS error FROM cur2
  UNION ALL
  SELECT s.doc_id, s.v, e.r,
    CASE WHEN e.kind = 'recover' OR (e.kind = 'queue' AND s.status NOT IN ('queued', 'running')) THEN 'queued'
         WHEN e.kind = 'claim' AND s.status = 'queued' THEN 'running'
         WHEN e.kind = 'succeed' AND s.status IN ('queued', 'running') THEN 'succeeded'
         WHEN e.kind = 'fail' AND s.status IN ('queued', 'running') THEN 'failed' ELSE s.status END,
    s.attempts + CASE WHEN e.kind = 'claim' AND s.status = 'queued' THEN 1 ELSE 0 END,
    s.recoveries + CASE WHEN e.kind = 'recover' THEN 1 ELSE 0 END,
    CASE WHEN e.kind = 'recover' OR (e.kind = 'queue' AND s.status NOT IN ('queued', 'running')) OR (e.kind = 'claim' AND s.status = 'queued') THEN NULL
         WHEN e.kind IN ('succeed', 'fail') AND s.status IN ('queued', 'running') THEN e.code ELSE s.error END
  FROM run s JOIN cur2 e ON e.doc_id = s.doc_id AND e.r = s.r + 1
),
tasks AS (SELECT * FROM run QUALIFY r = max(r) OVER (PARTITION BY doc_id))"""

_ANSWER = """
a AS (
  SELECT conv_id * 1000000 + turn AS answer_id, (conv_id * 100 + turn) % 8 AS m, text FROM conversations
)"""

ORACLES = {
    "sync_classify": f"""WITH {_RELATION},
v AS (SELECT *, ['same', 'touched', 'changed', 'missing', 'same'][doc_id % 5 + 1] AS verdict FROM rel),
p AS (
  SELECT *, CASE WHEN relation NOT IN ('aligned', 'behind') OR verdict = 'missing' THEN 'blocked'
    WHEN verdict = 'changed' AND n = 5 THEN 'blocked' WHEN verdict = 'changed' THEN 'reindex'
    WHEN relation = 'behind' THEN 'resume' WHEN verdict = 'touched' THEN 'refresh' ELSE 'skip' END AS action FROM v
)
SELECT doc_id, relation, action, CASE WHEN action = 'reindex' THEN 3 WHEN relation = 'only_index' THEN NULL ELSE 2 END::BIGINT AS ingest_version FROM p""",
    "sync_summary": f"""WITH {_RELATION},
p AS (
  SELECT CASE WHEN relation NOT IN ('aligned', 'behind') THEN 'blocked' WHEN doc_id % 5 = 2 AND n = 5 THEN 'blocked'
    WHEN doc_id % 5 = 2 THEN 'reindex' WHEN relation = 'behind' THEN 'resume' ELSE 'refresh' END AS action FROM rel
)
SELECT count(*) AS checked, count(*) FILTER (action = 'refresh') AS refreshed, count(*) FILTER (action = 'reindex') AS reindexed,
       count(*) FILTER (action = 'resume') AS resumed, count(*) FILTER (action = 'blocked') AS blocked FROM p""",
    "source_changes": """
WITH p AS (
  SELECT doc_id, length(text) AS chars, CASE doc_id % 9 WHEN 3 THEN 'missing' WHEN 2 THEN 'touched' WHEN 4 THEN 'changed' WHEN 5 THEN 'empty'
    WHEN 6 THEN 'not_utf8' ELSE 'same' END AS verdict FROM documents WHERE doc_id % 17 <> 0
)
SELECT doc_id, verdict, CASE WHEN verdict = 'touched' THEN chars WHEN verdict = 'changed' THEN chars + 1 END AS char_count FROM p""",
    "reupload_decide": """
WITH p AS (
  SELECT doc_id, doc_id % 6 AS n, ['old ', 'new ', 'newer ', '', ''][doc_id % 5 + 1] AS up,
         CASE WHEN doc_id % 6 IN (1, 2) THEN 'old ' ELSE '' END AS have, CASE WHEN doc_id % 6 = 5 THEN 'new ' END AS waiting,
         CASE doc_id % 6 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' WHEN 4 THEN NULL ELSE 'pending' END AS status,
         CASE doc_id % 6 WHEN 1 THEN 1 WHEN 4 THEN NULL ELSE 2 END AS version FROM documents
),
o AS (
  SELECT *, CASE WHEN status IS NULL THEN 'unknown_document' WHEN up = waiting THEN 'already_queued'
    WHEN up = have AND waiting IS NOT NULL THEN 'cancel_pending' WHEN up = have AND status = 'failed' THEN 'retry'
    WHEN up = have THEN 'unchanged' ELSE 'replace' END AS outcome FROM p
)
SELECT doc_id, outcome, outcome IN ('cancel_pending', 'replace') AS content_changed,
       CASE WHEN outcome = 'cancel_pending' THEN 'ready' WHEN outcome IN ('retry', 'replace') THEN 'pending' ELSE status END AS next_status,
       (version + CASE WHEN outcome IN ('cancel_pending', 'retry', 'replace') THEN 1 ELSE 0 END)::BIGINT AS next_version FROM o""",
    "failure_marks": """
WITH p AS (
  SELECT doc_id, doc_id % 6 AS n, doc_id % 3 = 2 AND (doc_id % 2 <> 0 OR doc_id % 6 = 1) AS hit FROM documents WHERE doc_id % 6 <> 4
)
SELECT doc_id, CASE WHEN hit THEN CASE WHEN doc_id % 4 <> 0 THEN 'ready' ELSE 'failed' END
    ELSE CASE n WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'pending' END END AS status,
  CASE WHEN hit THEN 'BUILD' END AS last_error_code, n = 5 AND NOT hit AS still_pending FROM p""",
    "stale_results": """
SELECT doc_id, 1 + doc_id % 2 AS ingest_version FROM documents
WHERE doc_id % 17 <> 0 AND (doc_id % 6 = 4 OR 1 + doc_id % 2 <> CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 2 END)""",
    "rebuild_promote": """
SELECT doc_id, source || CASE WHEN doc_id % 6 = 5 THEN '/v2-' ELSE '/v1-' END || doc_id AS path,
       sha256(CASE WHEN doc_id % 6 = 5 THEN 'new ' ELSE '' END || text) AS content_hash, true AS nothing_pending
FROM documents WHERE doc_id % 17 <> 0""",
    "cascade_delete": """
WITH k AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 6 <> 4 AND source <> 'src3' AND doc_id % 10 <> 0)
SELECT 'documents' AS table_name, count(*) AS n_rows FROM k UNION ALL SELECT 'chunks', sum(n)::BIGINT FROM k UNION ALL SELECT 'tasks', count(*) FROM k""",
    "catalogue_differences": """
SELECT doc_id, unnest(['left', 'right']) AS side FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 8 = 0""",
    "task_latest_version": f"""WITH RECURSIVE {_TASKS}
SELECT doc_id, v AS ingest_version, status, attempts AS attempt_count, recoveries AS recovery_count, error AS last_error_code FROM tasks""",
    "task_recover": f"""WITH RECURSIVE {_TASKS},
j AS (
  SELECT doc_id, v AS tv, status AS ts, attempts, recoveries, v + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS dv,
         CASE WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 4 = 2 THEN 'failed' ELSE 'ready' END AS ds, doc_id % 7 = 0 AS waiting,
         CASE WHEN doc_id % 4 = 2 THEN 'BROKEN' WHEN doc_id % 8 = 3 THEN 'LATE' END AS error FROM tasks
),
k AS (SELECT *, ts IN ('queued', 'running') AS active, tv = dv AND NOT waiting AS same FROM j),
r AS (
  SELECT *, CASE WHEN ds = 'pending' THEN 'requeued' WHEN tv <> dv THEN 'superseded' WHEN waiting THEN 'none'
                 WHEN ds = 'ready' AND error IS NULL THEN 'succeeded' ELSE 'failed' END AS action FROM k WHERE active OR ds = 'pending'
)
SELECT doc_id, action, CASE action WHEN 'requeued' THEN 'queued' WHEN 'none' THEN ts ELSE action END AS status,
       CASE WHEN action = 'superseded' THEN tv ELSE dv END AS ingest_version,
       CASE WHEN action = 'requeued' AND NOT same THEN 0 ELSE attempts END AS attempt_count,
       CASE WHEN action = 'requeued' THEN CASE WHEN same THEN recoveries + 1 ELSE 1 END ELSE recoveries END AS recovery_count,
       CASE WHEN action = 'failed' THEN error END AS error_code, active AND action = 'requeued' AND tv <> dv AS settled_before_requeue FROM r""",
    "session_ttl": f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {SESSION_GAP} * 1000000::BIGINT OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS events, min(us) AS started, max(us) AS ended FROM s GROUP BY 1, 2""",
    "last_n_turns": """
SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""",
    "usable_history": r"""
WITH t AS (SELECT conv_id AS session_id, turn, trim(substring(text, 1, 1500), chr(32) || chr(10) || chr(9) || chr(13)) AS answer
           FROM conversations WHERE role <> 'system' AND turn % 5 <> 4)
SELECT session_id, turn, length(answer) AS n_chars FROM t WHERE answer <> ''
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 6""",
    "citation_parse": f"""WITH {_ANSWER},
c AS (SELECT answer_id, CASE m WHEN 0 THEN text || ' [1]' WHEN 1 THEN '[2] ' || text || ' [1][2]' WHEN 2 THEN text || ' [9] [1]'
      WHEN 5 THEN text || ' [1]' WHEN 6 THEN text || ' [3]' WHEN 7 THEN text || ' [2]' ELSE text END AS content FROM a),
n AS (SELECT answer_id, unnest(l) AS number, unnest(range(len(l))) AS i FROM (SELECT answer_id, regexp_extract_all(content, '\\[(\\d+)\\]', 1) AS l FROM c)),
f AS (SELECT answer_id, number::BIGINT AS number, min(i) AS i FROM n GROUP BY 1, 2)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS place, number FROM f""",
    "citation_audit": f"""WITH {_ANSWER},
r AS (SELECT *, CASE m WHEN 2 THEN 'invalid_citation' WHEN 3 THEN 'no_citation' WHEN 4 THEN 'generation_insufficient'
      WHEN 5 THEN 'context_incomplete' WHEN 6 THEN 'context_incomplete'
      ELSE CASE WHEN (answer_id * 10 + 2) % 3 = 0 THEN 'source_changed' ELSE 'none' END END AS reason FROM a)
SELECT answer_id, reason, CASE reason WHEN 'none' THEN 'answered' WHEN 'source_changed' THEN 'error' WHEN 'context_incomplete' THEN 'needs_review'
       WHEN 'generation_insufficient' THEN 'insufficient' ELSE 'unverified' END AS status,
       CASE WHEN reason <> 'none' THEN '' WHEN m = 7 THEN '2' ELSE '1,2' END AS cited, CASE WHEN m = 2 THEN '9' ELSE '' END AS out_of_range FROM r""",
    "citation_renumber": """
WITH s AS (
  SELECT conv_id AS w, turn AS step, conv_id * 1000000 + turn AS id, role <> 'system' AND (conv_id * 1000000 + turn) % 9 <> 0 AS maybe FROM conversations
),
c AS (SELECT w, step, id, maybe, i, (id * 7 + i * 3) % 10 AS chunk, CASE WHEN id % 11 = 0 THEN 5 ELSE 1 END AS doc FROM s, (SELECT unnest([1, 2, 3]) AS i)),
steps AS (SELECT w, row_number() OVER (PARTITION BY w ORDER BY step) AS k, step, id, maybe FROM s),
run AS (
  SELECT w, 0::BIGINT AS k, NULL::BIGINT AS step, false AS valid, []::BIGINT[] AS chunks, []::BIGINT[] AS docs FROM (SELECT DISTINCT w FROM s)
  UNION ALL
  SELECT r.w, t.k, t.step, v.ok,
         CASE WHEN v.ok THEN list_concat(r.chunks, v.fresh) ELSE r.chunks END,
         CASE WHEN v.ok THEN list_concat(r.docs, list_transform(v.fresh, lambda x: CASE WHEN t.id % 11 = 0 THEN 5 ELSE 1 END::BIGINT)) ELSE r.docs END
  FROM run r JOIN steps t ON t.w = r.w AND t.k = r.k + 1,
  LATERAL (
    SELECT list_filter([(t.id * 7 + 3) % 10, (t.id * 7 + 6) % 10, (t.id * 7 + 9) % 10], lambda x: NOT list_contains(r.chunks, x)) AS fresh,
           t.maybe AND len(list_filter(range(1, len(r.chunks) + 1), lambda p:
             list_contains([(t.id * 7 + 3) % 10, (t.id * 7 + 6) % 10, (t.id * 7 + 9) % 10], r.chunks[p])
             AND r.docs[p] <> CASE WHEN t.id % 11 = 0 THEN 5 ELSE 1 END)) = 0 AS ok
  ) v
),
last AS (SELECT w, chunks FROM run QUALIFY k = max(k) OVER (PARTITION BY w))
SELECT r.w AS workflow_id, r.step::INT AS step, r.valid,
  CASE WHEN r.valid THEN 'see [' || list_position(r.chunks, (id * 7 + 6) % 10) || '], then [' || list_position(r.chunks, (id * 7 + 3) % 10)
       || '] and [' || list_position(r.chunks, (id * 7 + 9) % 10) || ']' END AS conclusion,
  CASE WHEN r.valid THEN list_position(r.chunks, (id * 7 + 3) % 10) || ',' || list_position(r.chunks, (id * 7 + 6) % 10) || ',' || list_position(r.chunks, (id * 7 + 9) % 10) END AS numbers,
  len(l.chunks) AS n_sources
FROM run r JOIN steps t ON t.w = r.w AND t.k = r.k JOIN last l ON l.w = r.w WHERE r.k > 0""".replace("WITH s AS", "WITH RECURSIVE s AS", 1),
    "stale_sources": """
WITH l AS (
  SELECT (doc_id << 27) | i AS chunk_id, doc_id, source, CASE WHEN i < n - 1 THEN c || chr(10) ELSE c END AS content
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS i,
               len(string_split(text, chr(10))) AS n FROM documents)
)
SELECT chunk_id FROM l WHERE content <> '' AND (chunk_id % 59 = 0 OR (chunk_id % 61 = 0 AND upper(content) <> content) OR doc_id % 41 = 0
   OR (chunk_id % 53 = 0 AND source <> 'src1'))""",
    "sources_by_document": f"""WITH {_ANSWER}
SELECT answer_id, 1::BIGINT AS doc_id, '1,3' AS numbers, 1::BIGINT AS first FROM a UNION ALL SELECT answer_id, 0, '2', 2 FROM a""",
    "source_listing": """
WITH f AS (SELECT conv_id AS session_id, turn % 3 AS chunk_id, min(turn) AS position, max(turn) AS last FROM conversations GROUP BY 1, 2),
n AS (SELECT f.*, row_number() OVER (PARTITION BY session_id ORDER BY position) AS index FROM f)
SELECT session_id, index, chunk_id,
       '- a ［b］ ' || role || '，原文字符位置 ' || turn || '–' || length(text) || '。[' || index || ']' AS line
FROM n JOIN conversations c ON c.conv_id = n.session_id AND c.turn = n.last""",
    "quarantine": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents)
SELECT doc_id, doc_id * 10 + chunk_index % 10 AS chunk_id, chunk_index FROM l
QUALIFY count(DISTINCT content) OVER (PARTITION BY doc_id * 10 + chunk_index % 10) = 1""",
}
