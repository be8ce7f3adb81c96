"""Keep an index in step with its sources: relation, re-upload, failure, publish, rebuild.

The catalogue is the record of sources, the index tables hold what was built from it.
Every function returns new rows; writing them is a matter of :mod:`noteloom.sources`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom import settings as S


class ProfileMismatch(ValueError):
    """The index holds vectors of another embedding model."""


# ---------------------------------------------------------------- change detection


def suspects(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows with the file's size and time; ``verdict`` missing, same or suspect.

    Files: ``path, size, mtime_ns`` (metadata only, no content is read). A file that
    cannot be found is an error and never a deletion.
    """
    found = files.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    j = catalogue.withColumn("path", F.col("active.path")).join(found, "path", "left")
    verdict = (
        F.when(F.col("_size").isNull(), "missing")
        .when((F.col("_size") == F.col("active.size")) & (F.col("_mtime") == F.col("active.mtime_ns")), "same")
        .otherwise("suspect")
    )
    return j.withColumn("verdict", verdict)


def observe(suspected: DataFrame, contents: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES) -> DataFrame:
    """Read the suspects and decide what happened to each source.

    Contents: ``path, content`` binary. Verdicts: changed, touched (only the time differs),
    or why the file cannot be taken: missing, too_large, not_utf8, empty,
    length_mismatch. Adds ``observed``, the new source record.
    """
    # What is asked of a content is found where it is read, so that contents move only if their text is asked for.
    valid = F.decode(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")), "UTF-8")
    blank = F.octet_length(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"[ \t\n\x0B\f\r]+", "")) == 0
    read = contents.select(
        "path", valid.alias("text"), F.sha2("content", 256).alias("_digest"), F.length(valid).cast("bigint").alias("_chars"),
        F.octet_length("content").alias("_bytes"), blank.alias("_blank"))
    j = suspected.join(read, "path", "left")
    changed = F.col("_digest") != F.col("active.content_hash")
    verdict = (
        F.when(F.col("_bytes").isNull(), "missing")
        .when(F.col("_bytes") > F.greatest(F.lit(max_bytes), F.col("active.size")), "too_large")
        .when(F.col("_chars").isNull(), "not_utf8")
        .when(changed & F.col("_blank"), "empty")
        .when(~changed & (F.col("_chars") != F.col("active.char_count")), "length_mismatch")
        .when(changed, "changed")
        .otherwise("touched")
    )
    record = F.struct(
        F.col("path").alias("path"), F.col("_digest").alias("content_hash"), F.col("_chars").alias("char_count"),
        F.col("_size").alias("size"), F.col("_mtime").alias("mtime_ns"),
    )
    return j.withColumn("verdict", verdict).withColumn(
        "observed", F.when(F.col("verdict").isin("changed", "touched"), record)
    ).drop("_digest", "_chars", "_bytes", "_blank", "_size", "_mtime")


# ---------------------------------------------------------------- relation of index and catalogue


def relation(catalogue: DataFrame, documents: DataFrame) -> DataFrame:
    """How each document's index stands to the catalogue: (doc_id, relation).

    aligned, behind (an older version without a pending source), conflict, identity_mismatch,
    only_catalogue or only_index.
    """
    c = catalogue.select(F.col("doc_id"), F.struct("*").alias("c"))
    d = documents.select(F.col("doc_id"), F.struct("*").alias("d"))
    j = c.join(d, "doc_id", "full_outer")
    same = lambda a, b: F.col(f"c.{a}").eqNullSafe(F.col(f"d.{b}"))
    identity = same("kb_id", "kb_id") & same("title", "title") & same("active.path", "file_path") & same("created_at", "created_at")
    pending = (
        same("pending.path", "pending_file_path") & same("pending.content_hash", "pending_content_hash")
        & same("pending.char_count", "pending_char_count")
    )
    active = (
        same("active.content_hash", "content_hash") & same("active.char_count", "char_count")
        & same("ingest_version", "ingest_version")
    )
    nothing_pending = (
        F.col("c.pending").isNull() & F.col("d.pending_file_path").isNull()
        & F.col("d.pending_content_hash").isNull() & F.col("d.pending_char_count").isNull()
    )
    return j.select(
        "doc_id",
        F.when(F.col("d").isNull(), "only_catalogue")
        .when(F.col("c").isNull(), "only_index")
        .when(~identity, "identity_mismatch")
        .when(active & pending, "aligned")
        .when(nothing_pending & (F.col("d.ingest_version") < F.col("c.ingest_version")), "behind")
        .otherwise("conflict").alias("relation"),
    )


def plan_sync(catalogue: DataFrame, documents: DataFrame, observed: DataFrame, force: bool = False) -> DataFrame:
    """What an incremental sync does with each document: (doc_id, action, ingest_version).

    Observed: ``doc_id, verdict`` from :func:`observe` or :func:`suspects`. Actions: skip,
    refresh (record the new time), reindex, resume (catch up with the catalogue), blocked.
    A changed source gets a version above both sides; catching up takes the catalogue's.
    """
    rel = relation(catalogue, documents)
    j = (
        rel.join(observed.select("doc_id", "verdict"), "doc_id", "left")
        .join(catalogue.select("doc_id", F.col("ingest_version").alias("_c"), F.col("pending").isNotNull().alias("_waiting")), "doc_id", "left")
        .join(documents.select("doc_id", F.col("ingest_version").alias("_d"), F.col("pending_file_path").isNotNull().alias("_pending")), "doc_id", "left")
    )
    changed = F.col("verdict") == "changed"
    waiting = F.coalesce(F.col("_waiting"), F.lit(False)) | F.coalesce(F.col("_pending"), F.lit(False))
    action = (
        F.when(~F.col("relation").isin("aligned", "behind"), "blocked")
        .when(~F.col("verdict").isin("changed", "touched", "same") | F.col("verdict").isNull(), "blocked")
        .when(changed & waiting, "blocked")
        .when(changed, "reindex")
        .when(F.col("relation") == "behind", "resume")
        .when(F.lit(force), "reindex")
        .when(F.col("verdict") == "touched", "refresh")
        .otherwise("skip")
    )
    version = F.when(F.col("action") == "reindex", F.greatest("_c", "_d") + 1).otherwise(F.col("_c"))
    return j.withColumn("action", action).withColumn("ingest_version", version).drop("_c", "_d", "_waiting", "_pending")


def sync_summary(plan: DataFrame) -> DataFrame:
    """Counters of a sync: checked, refreshed, reindexed, resumed, blocked."""
    n = lambda action: F.count_if(F.col("action") == action)
    return plan.agg(
        F.count(F.lit(1)).alias("checked"), n("refresh").alias("refreshed"), n("reindex").alias("reindexed"),
        n("resume").alias("resumed"), n("blocked").alias("blocked"),
    )


# ---------------------------------------------------------------- uploads


def decide_reupload(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Six outcomes of uploading a document again.

    Incoming: ``doc_id, new_hash``. Documents: ``doc_id, status, content_hash,
    pending_content_hash, pending_file_path, chunk_count, ingest_version``. Output adds
    ``outcome, content_changed, next_status, next_version``.
    """
    j = incoming.join(documents, "doc_id", "left")
    new = F.col("new_hash")
    waiting = F.col("status").isin("pending", "processing")
    outcome = (
        F.when(F.col("status").isNull(), "unknown_document")
        .when((new == F.col("pending_content_hash")) & waiting, "already_queued")
        .when(new == F.col("pending_content_hash"), "already_pending")
        .when((new == F.col("content_hash")) & F.col("pending_file_path").isNotNull(), "cancel_pending")
        .when((new == F.col("content_hash")) & (F.col("status") == "failed"), "retry")
        .when(new == F.col("content_hash"), "unchanged")
        .otherwise("replace")
    )
    o = F.col("outcome")
    raises = o.isin("cancel_pending", "retry", "replace")
    return j.withColumn("outcome", outcome).withColumns({
        "content_changed": o.isin("cancel_pending", "replace"),
        "next_status": F.when(o == "cancel_pending", F.when(F.col("chunk_count") > 0, "ready").otherwise("failed"))
        .when(o.isin("retry", "replace"), "pending").otherwise(F.col("status")),
        "next_version": F.col("ingest_version") + F.when(raises, 1).otherwise(0),
    })


def mark_failures(failures: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents after a failed build: the old index stays in use if there is one.

    Failures: ``doc_id, ingest_version, candidate_path, code, message``. Failures of an older version, or of a
    candidate that has been replaced, are ignored.
    """
    have = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_chunks"))
    f = failures.groupBy("doc_id", "ingest_version").agg(
        F.min(F.struct(F.col("candidate_path").alias("path"), "code", "message")).alias("f")
    ).select("doc_id", "ingest_version", F.col("f.path").alias("_path"), F.col("f.code").alias("_code"), F.col("f.message").alias("_message"))
    hit = F.col("_code").isNotNull() & (F.col("_path").isNull() | F.col("_path").eqNullSafe(F.col("pending_file_path")))
    own = hit & F.col("_path").isNotNull()
    after = lambda c, value: F.when(hit, value).otherwise(F.col(c)).alias(c)
    changed = {
        "status": after("status", F.when(F.coalesce("_chunks", F.lit(0)) > 0, "ready").otherwise("failed")),
        "last_error_code": after("last_error_code", F.col("_code")),
        "last_error_message": after("last_error_message", F.col("_message")),
        **{c: F.when(~own, F.col(c)).alias(c) for c in ("pending_file_path", "pending_content_hash", "pending_char_count")},
    }
    j = documents.join(f, ["doc_id", "ingest_version"], "left").join(have, "doc_id", "left")
    return j.select(*[changed.get(c, F.col(c)) for c in documents.columns])


def split_current(results: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build results of the version that is still wanted, and the stale ones for the audit."""
    versions = documents.select("doc_id", "ingest_version")
    key = ["doc_id", "ingest_version"]
    return results.join(versions, key, "left_semi"), results.join(versions, key, "left_anti")


def replace_chunks(chunks: DataFrame, fresh: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The chunk table with all chunks of the rebuilt documents replaced.

    Rebuilt: ``doc_id`` of every document that was processed, even when it has no chunks.
    """
    return chunks.join(rebuilt.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


# ---------------------------------------------------------------- rebuild and removal


def promote_pending(catalogue: DataFrame) -> DataFrame:
    """Catalogue in which a waiting source becomes the active one."""
    return catalogue.withColumns({
        "active": F.coalesce("pending", "active"),
        "pending": F.lit(None).cast(catalogue.schema["pending"].dataType),
    })


def cascade_delete(
    documents: DataFrame, chunks: DataFrame, tasks: DataFrame, kb_ids: DataFrame | None = None, doc_ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and tasks that remain after removing bases (``kb_id``) or documents (``doc_id``)."""
    kept = documents
    if kb_ids is not None:
        kept = kept.join(kb_ids, "kb_id", "left_anti")
    if doc_ids is not None:
        kept = kept.join(doc_ids, "doc_id", "left_anti")
    gone = documents.join(kept, "doc_id", "left_anti").select("doc_id")
    return kept, chunks.join(gone, "doc_id", "left_anti"), tasks.join(gone, "doc_id", "left_anti")


def ensure_profile(metadata: DataFrame, chunks: DataFrame, model: str, dimension: int, url: str) -> None:
    """Refuse to work on an index of another embedding profile; an empty index fits any.

    Metadata: ``key, value``. At most one row and one chunk are looked at.
    """
    wanted = {"embedding_model": model, "embedding_dimension": str(dimension), "embedding_url": url.rstrip("/")}
    stored = {r["key"]: r["value"] for r in metadata.filter(F.col("key").isin(*wanted)).limit(len(wanted)).collect()}
    if stored == wanted or chunks.select("chunk_id").isEmpty():
        return
    raise ProfileMismatch(f"index profile {stored or 'unknown'} differs from {wanted}; rebuild all vectors first")


def catalogue_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents whose records differ in anything but file times: (doc_id, side)."""
    flat = lambda s: F.when(
        F.col(s).isNotNull(), F.to_json(F.struct(*[f"{s}.{f}" for f in ("path", "content_hash", "char_count", "size")]))
    ).alias(s)
    shape = lambda df: df.select("doc_id", "kb_id", "title", "ingest_version", flat("active"), flat("pending"), "created_at", "updated_at")
    a, b = shape(left), shape(right)
    return a.exceptAll(b).select("doc_id", F.lit("left").alias("side")).unionByName(
        b.exceptAll(a).select("doc_id", F.lit("right").alias("side"))
    )


# ---------------------------------------------------------------- ingest tasks


def with_task(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents with the task of their current version, if there is one."""
    t = tasks.select("doc_id", "ingest_version", F.col("status").alias("task_status"), "stage", "attempt_count", "recovery_count")
    return documents.join(t, ["doc_id", "ingest_version"], "left")


_SLICE_BITS = 16
_TERMINAL = {"succeed": "succeeded", "fail": "failed", "supersede": "superseded"}
_STARTS = ("queued", "running", "done")


def _apply_event(s: Column, e: Column) -> Column:
    """State of a task after one event."""
    queued, active = s["status"] == "queued", s["status"].isin(*S.TASK_ACTIVE)
    requeues = (e["kind"] == "recover") | ((e["kind"] == "queue") & ~active)
    claims = (e["kind"] == "claim") & queued
    ends = e["kind"].isin(*_TERMINAL) & active
    terminal = F.create_map(*[F.lit(x) for p in _TERMINAL.items() for x in p])
    return F.struct(
        F.when(requeues, "queued").when(claims, "running").when(ends, F.element_at(terminal, e["kind"])).otherwise(s["status"]).alias("status"),
        (s["attempts"] + F.when(claims, 1).otherwise(0)).alias("attempts"),
        (s["recoveries"] + F.when(e["kind"] == "recover", 1).otherwise(0)).alias("recoveries"),
        F.when(requeues | claims, F.lit(None).cast("string")).when(ends, e["error_code"]).otherwise(s["error"]).alias("error"),
        (s["moved"] | requeues | claims | ends).alias("moved"),
    )


def _start_state(status: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.lit(status).alias("status"), zero.alias("attempts"), zero.alias("recoveries"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("moved"),
    )


def _chain(before: Column, effects: Column) -> Column:
    """State after a slice whose effect is known for every state it may start in."""
    at = F.when(before["status"] == "queued", 0).when(before["status"] == "running", 1).otherwise(2)
    e = F.get(effects, at)
    return F.struct(
        F.when(e["moved"], e["status"]).otherwise(before["status"]).alias("status"),
        (before["attempts"] + e["attempts"]).alias("attempts"),
        (before["recoveries"] + e["recoveries"]).alias("recoveries"),
        F.when(e["moved"], e["error"]).otherwise(before["error"]).alias("error"),
        (before["moved"] | e["moved"]).alias("moved"),
    )


def latest_tasks(events: DataFrame, levels: int = 3) -> DataFrame:
    """State of each document's task from its whole event history.

    Events: ``doc_id, ingest_version, seq, kind, error_code`` with kinds queue, recover,
    claim, succeed, fail, supersede; ``seq`` is a unique number. Only events of the highest
    version count. A claim only works on a queued task and a result only on an active one.

    A slice of 65536 sequence numbers is reduced to its effect on each state a task may be
    in; effects are then chained slice by slice, level by level. So no task gathers more
    than one slice, even if one document has most of the events.
    """
    identity = F.array(*[_start_state(s) for s in _STARTS])
    key = ["doc_id", "ingest_version"]
    slices = events.groupBy(*key, F.shiftright("seq", _SLICE_BITS).alias("slice")).agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("seq", "kind", "error_code"))), identity,
            lambda states, e: F.transform(states, lambda s: _apply_event(s, e)),
        ).alias("effects")
    )
    # Versions are compared on slices, of which there are far fewer than events.
    newest = slices.groupBy("doc_id").agg(F.max("ingest_version").alias("ingest_version"))
    slices = slices.join(newest, key, "left_semi")
    for level in range(levels - 1):
        above = F.shiftright("slice", _SLICE_BITS) if level < levels - 2 else F.lit(0).cast("bigint")
        slices = slices.groupBy(*key, above.alias("_above")).agg(
            F.aggregate(
                F.array_sort(F.collect_list(F.struct("slice", "effects"))), identity,
                lambda states, x: F.transform(states, lambda s: _chain(s, x["effects"])),
            ).alias("effects")
        ).withColumnRenamed("_above", "slice")
    s = F.get("effects", F.lit(0))
    return slices.select(
        *key, s["status"].alias("status"), s["attempts"].alias("attempt_count"),
        s["recoveries"].alias("recovery_count"), s["error"].alias("last_error_code"),
    )


def recover_tasks(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """After a restart: settle active tasks whose document is final, requeue open documents.

    Tasks: ``doc_id, ingest_version, candidate_path, status, attempt_count, recovery_count``.
    Documents: ``doc_id, ingest_version, status, pending_file_path, last_error_code``.
    Output: one row per inspected document with ``action`` (superseded, succeeded, failed,
    requeued, none), the new task ``status``, ``ingest_version``, counters and error.
    """
    t = tasks.select(
        "doc_id", F.col("ingest_version").alias("_tv"), F.col("candidate_path").alias("_tp"), F.col("status").alias("_ts"),
        "attempt_count", "recovery_count",
    )
    j = documents.select("doc_id", "ingest_version", F.col("status").alias("_ds"), "pending_file_path", "last_error_code").join(t, "doc_id", "left")
    active = F.coalesce(F.col("_ts").isin(*S.TASK_ACTIVE), F.lit(False))
    open_document = F.col("_ds").isin("pending", "processing")
    final = F.col("_ds").isin("ready", "failed") & F.col("pending_file_path").isNull()
    same = F.coalesce((F.col("_tv") == F.col("ingest_version")) & F.col("_tp").eqNullSafe(F.col("pending_file_path")), F.lit(False))
    action = (
        F.when(open_document, "requeued")
        .when(active & (F.col("_tv") != F.col("ingest_version")), "superseded")
        .when(active & final & (F.col("_ds") == "ready") & F.coalesce(F.col("last_error_code") == "", F.lit(True)), "succeeded")
        .when(active & final, "failed")
    )
    requeued = F.col("action") == "requeued"
    return j.withColumn("action", F.coalesce(action, F.lit("none"))).filter(active | open_document).select(
        "doc_id", "action", F.when(requeued, "queued").when(F.col("action") == "none", F.col("_ts")).otherwise(F.col("action")).alias("status"),
        F.when(F.col("action") == "superseded", F.col("_tv")).otherwise(F.col("ingest_version")).alias("ingest_version"),
        F.when(requeued & ~same, F.lit(0)).otherwise(F.coalesce("attempt_count", F.lit(0))).cast("bigint").alias("attempt_count"),
        F.when(requeued, F.when(same, F.col("recovery_count") + 1).otherwise(F.lit(1))).otherwise(F.col("recovery_count")).cast("bigint").alias("recovery_count"),
        F.when(F.col("action") == "failed", F.col("last_error_code")).alias("error_code"),
        (active & (requeued & (F.col("_tv") != F.col("ingest_version")))).alias("settled_before_requeue"),
    )


def recovery_summary(recovered: DataFrame) -> DataFrame:
    """Counters of a recovery: inspected, recovered and reconciled."""
    return recovered.agg(
        F.count(F.lit(1)).alias("inspected"),
        F.count_if(F.col("action") == "requeued").alias("recovered"),
        F.count_if(F.col("action").isin("superseded", "succeeded", "failed") | F.col("settled_before_requeue")).alias("reconciled"),
    )
