"""Audit recorded answers: citations, dependencies, support and workflow numbering.

Everything about one answer is in its row (its few citations are an array), so these are
row expressions without a shuffle. Only the comparison with the current index joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions import texts as T
from noteloom.functions.binding import let
from noteloom.functions.texts import nfkc_squash
from noteloom.session import hinted

_NUL = "\0"
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _ids(citations: Column) -> Column:
    return F.transform(citations, lambda c: c["chunk_id"])


def dependency_closure(citations: Column, cited: Column) -> Column:
    """Chunk ids of the cited numbers with everything they need, directly or not.

    ``citations`` is ``array<struct<index, chunk_id, ..., context_chunk_ids>>``. Each round
    adds the needs of what is already in; there are at most as many rounds as citations.
    Ids that no citation provides are part of the result.
    """
    start = _ids(F.filter(citations, lambda c: F.array_contains(cited, c["index"])))
    grow = lambda known: F.array_union(
        known,
        F.flatten(F.transform(F.filter(citations, lambda c: F.array_contains(known, c["chunk_id"])), lambda c: c["context_chunk_ids"])),
    )
    return F.aggregate(F.sequence(F.lit(0), F.size(citations)), start, lambda known, _: grow(known))


def audit_answers(answers: DataFrame) -> DataFrame:
    """First reason why each answer cannot be published, and what it really cites.

    Answers: ``answer_id, content, provided_count, citations``. Adds ``reason`` (null when
    sound), ``status``, ``cited`` (numbers to keep, dependencies included) and
    ``out_of_range``.
    """
    text = F.trim(F.col("content"))
    with_numbers = answers.withColumns({
        "_cited": T.citation_numbers(text),
        "out_of_range": T.out_of_range_citations(text, F.col("provided_count")),
    }).withColumn("_closure", dependency_closure(F.col("citations"), F.col("_cited")))
    known = _ids(F.col("citations"))
    reason = (
        F.when(text.startswith(S.CONTEXT_INCOMPLETE_MARKER), "context_incomplete")
        .when(F.size("out_of_range") > 0, "invalid_citation")
        .when((F.size("_cited") == 0) & T.says_context_incomplete(text), "context_incomplete")
        .when((F.size("_cited") == 0) & T.says_insufficient(text), "generation_insufficient")
        .when(F.size("_cited") == 0, "no_citation")
        .when(F.size(F.array_except("_closure", known)) > 0, "context_incomplete")
    )
    kept = F.transform(
        F.filter("citations", lambda c: F.array_contains(F.col("_closure"), c["chunk_id"])), lambda c: c["index"]
    )
    return with_numbers.withColumn("reason", reason).withColumns({
        "status": T.status_of_reason(F.col("reason")),
        "cited": F.when(F.col("reason").isNull(), kept),
    }).drop("_cited", "_closure")


def source_snapshots(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Citable records of retrieved chunks, with what identifies their document now.

    Found: ``question_id, rank, chunk_id, doc_id, content, char_start, char_end``. Documents:
    ``doc_id, kb_id, title, content_hash``. Chunks whose document is gone drop out.
    """
    d = documents.join(hinted(found.select("doc_id").distinct()), "doc_id", "left_semi").select(
        "doc_id", "kb_id", F.col("title").alias("doc_title"), "content_hash"
    )
    return found.select(
        "question_id", F.col("rank").alias("index"), "chunk_id", "doc_id", "content", "char_start", "char_end"
    ).join(d, "doc_id")


_SNAPSHOT_FIELDS = ("doc_id", "kb_id", "content_print", "char_start", "char_end", "content_hash")
#: Fixed value: so many named chunks are sent to all tasks.
_FEW_SNAPSHOTS = 200_000


def _fingerprint(content: Column) -> Column:
    """SHA-256 of a content in 32 bytes, null for null."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def stale_sources(snapshots: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk ids whose snapshot differs from the current index, per scope.

    Snapshots: ``chunk_id, doc_id, kb_id, content, char_start, char_end, content_hash`` and
    ``scope_kb`` (null = all bases). Chunks and documents are the current tables; the
    document's own base has to agree as well.
    """
    # Contents are compared by their fingerprints, so no text moves.
    shots = snapshots.withColumn("content_print", _fingerprint(F.col("content"))).drop("content")
    named = chunks.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in ("doc_id", "kb_id")], _fingerprint(F.col("content")).alias("_content_print"),
                          *[F.col(c).alias(f"_{c}") for c in ("char_start", "char_end")])
    wanted = snapshots.select("chunk_id").distinct()
    if wanted.limit(_FEW_SNAPSHOTS + 1).count() <= _FEW_SNAPSHOTS:  # otherwise the join below costs no more
        named = named.join(F.broadcast(wanted), "chunk_id", "left_semi")
    current = named.join(
        documents.select(F.col("doc_id").alias("_doc_id"), F.col("kb_id").alias("_doc_kb"), F.col("content_hash").alias("_content_hash")),
        "_doc_id",
    )
    j = shots.join(current, "chunk_id", "left")
    differs = F.lit(False)
    for field in _SNAPSHOT_FIELDS:
        differs = differs | ~F.col(field).eqNullSafe(F.col(f"_{field}"))
    differs = differs | ~F.col("kb_id").eqNullSafe(F.col("_doc_kb"))
    outside = F.col("scope_kb").isNotNull() & ~F.col("_kb_id").eqNullSafe(F.col("scope_kb"))
    return j.filter(differs | outside).select("chunk_id").distinct()


def withdraw_stale(audited: DataFrame, stale: DataFrame) -> DataFrame:
    """Answers that cite a stale chunk become errors; joins on the exploded citations."""
    used = audited.filter(F.col("reason").isNull()).select(
        "answer_id", F.explode(F.filter("citations", lambda c: F.array_contains(F.col("cited"), c["index"]))).alias("c")
    ).select("answer_id", F.col("c.chunk_id").alias("chunk_id"))
    hit = used.join(stale, "chunk_id", "left_semi").select("answer_id").distinct().withColumn("_stale", F.lit(True))
    changed = F.coalesce(F.col("_stale"), F.lit(False))
    return audited.join(hit, "answer_id", "left").withColumns({
        "reason": F.when(changed, F.lit("source_changed")).otherwise(F.col("reason")),
        "status": F.when(changed, F.lit(S.ERROR)).otherwise(F.col("status")),
        "cited": F.when(~changed, F.col("cited")),
    }).drop("_stale")


# ---------------------------------------------------------------- support judgements

_JUDGEMENTS = (
    "struct<judgments:array<struct<unit_id:bigint,verdict:string,"
    "evidence:array<struct<source_index:bigint,quote:string>>>>>"
)
_JUDGEMENT_FIELDS, _EVIDENCE_FIELDS = ("evidence", "unit_id", "verdict"), ("quote", "source_index")
_VERDICTS = ("supported", "unsupported", "contradicted")


def _has_only(objects: Column, fields: tuple[str, ...]) -> Column:
    """Every object, a map, has just the given fields."""
    return F.coalesce(F.forall(objects, lambda o: F.array_sort(F.map_keys(o)) == F.array(*map(F.lit, sorted(fields)))), F.lit(False))


def answer_units(content: Column, citations: Column) -> Column:
    """Non-blank lines of an answer with the sources each may rely on.

    A line may use the sources it cites, all sources when it cites none, and the context
    those sources need.
    """
    all_numbers = F.transform(citations, lambda c: c["index"])

    def with_context(numbers: Column) -> Column:
        needed = F.flatten(F.transform(
            F.filter(citations, lambda c: F.array_contains(numbers, c["index"])), lambda c: c["context_chunk_ids"]
        ))
        extra = F.transform(F.filter(citations, lambda c: F.array_contains(needed, c["chunk_id"])), lambda c: c["index"])
        return F.array_sort(F.array_union(numbers, extra))

    lines = F.filter(F.split(content, _LINE_BREAK), lambda x: x.rlike(r"(?U)\S"))

    def unit(line: Column) -> Column:
        cited = T.citation_numbers(line)
        chosen = F.when(F.size(cited) > 0, cited).otherwise(all_numbers)
        return F.struct(line.alias("text"), let(chosen, with_context).alias("allowed"))

    return F.transform(lines, unit)


def support_audit(answers: DataFrame) -> DataFrame:
    """Check recorded support judgements: ``problem`` (null when sound) and ``supported``.

    Answers: ``answer_id, content, judgement`` (JSON) and ``citations`` with ``index,
    chunk_id, chunk_text, context_chunk_ids``. Every line is judged once, with a known
    verdict; quotes come from sources the line may use and are long enough.
    """
    parsed = answers.withColumns({
        "_units": answer_units(F.col("content"), F.col("citations")),
        "_keys": F.map_keys(F.from_json("judgement", "map<string,string>")),
        "_j": F.from_json("judgement", _JUDGEMENTS)["judgments"],
        "_objects": F.from_json("judgement", "struct<judgments:array<map<string,string>>>")["judgments"],
        "_cited": F.flatten(F.filter(F.from_json(
            "judgement", "struct<judgments:array<struct<evidence:array<map<string,string>>>>>")["judgments"]["evidence"], lambda e: e.isNotNull())),
    })
    exact = _has_only(F.col("_objects"), _JUDGEMENT_FIELDS) & _has_only(F.col("_cited"), _EVIDENCE_FIELDS)
    # One call normalises all quotes of a row, another all sources; NUL keeps them apart.
    quotes = F.flatten(F.transform("_j", lambda j: F.transform(
        F.coalesce(j["evidence"], F.array().cast("array<struct<source_index:bigint,quote:string>>")), lambda e: e["quote"])))
    squashed = parsed.withColumns({
        "_quotes": F.split(nfkc_squash(F.array_join(quotes, _NUL, "")), _NUL),
        "_sources": F.split(nfkc_squash(F.array_join(F.transform("citations", lambda c: c["chunk_text"]), _NUL, "")), _NUL),
        "_raw": quotes,
    })
    source_text = F.map_from_arrays(F.transform("citations", lambda c: c["index"]), F.col("_sources"))
    quote_text = F.map_from_entries(F.array_distinct(F.arrays_zip(F.col("_raw").alias("k"), F.col("_quotes").alias("v"))))
    ready = squashed.withColumns({
        "_source_text": source_text,
        "_quote_text": F.when(F.size("_raw") > 0, quote_text),
    })
    ids = F.transform("_j", lambda j: j["unit_id"])
    n = F.size("_units")
    unit_of = lambda j: F.get(F.col("_units"), (j["unit_id"] - 1).cast("int"))

    def bare(j: Column) -> Column:
        # Only pure separators may be supported without evidence.
        stripped = F.trim(unit_of(j)["text"])
        return F.coalesce(F.length(F.regexp_replace(stripped, r"^[#*\-_=|` ]+|[#*\-_=|` ]+$", "")) > 0, F.lit(True))

    def foreign(j: Column) -> Column:
        return F.exists(j["evidence"], lambda e: ~F.coalesce(
            F.map_contains_key(F.col("_source_text"), e["source_index"]) & F.array_contains(unit_of(j)["allowed"], e["source_index"]),
            F.lit(False)))

    def misquoted(j: Column) -> Column:
        def wrong(e: Column) -> Column:
            q = F.try_element_at(F.col("_quote_text"), e["quote"])
            source = F.try_element_at(F.col("_source_text"), e["source_index"])
            good = (q != "") & (F.length(q) >= F.least(F.lit(S.MIN_QUOTE_CHARS), F.length(source))) & F.contains(source, q)
            return ~F.coalesce(good, F.lit(False))
        return F.exists(j["evidence"], wrong)

    some = lambda test: F.coalesce(F.exists("_j", test), F.lit(False))
    problem = (
        F.when(F.col("_keys").isNull(), "not_json")
        .when((F.size("_keys") != 1) | (F.get("_keys", F.lit(0)) != "judgments") | F.col("_j").isNull() | ~exact, "bad_fields")
        .when((n == 0) | (F.size("_j") != n), "not_covered")
        .when(
            some(lambda j: ~F.coalesce(j["unit_id"].between(1, n), F.lit(False))) | (F.size(F.array_distinct(ids)) != n), "bad_unit"
        )
        .when(some(lambda j: ~F.coalesce(j["verdict"].isin(*_VERDICTS), F.lit(False)) | j["evidence"].isNull()), "bad_verdict")
        .when(some(lambda j: (j["verdict"] == "supported") & (F.size(j["evidence"]) == 0) & bare(j)), "evidence_missing")
        .when(some(foreign), "foreign_source")
        .when(some(misquoted), "bad_quote")
    )
    return ready.withColumn("problem", problem).withColumn(
        "supported", F.when(F.col("problem").isNull(), F.forall("_j", lambda j: j["verdict"] == "supported"))
    ).drop("_units", "_keys", "_j", "_objects", "_cited", "_quotes", "_sources", "_raw", "_source_text", "_quote_text")


# ---------------------------------------------------------------- source selection

_SELECTION_FIELDS = ("quote", "source_index", "subject")
_SELECTION = "struct<source_matches:array<struct<source_index:bigint,subject:string,quote:string>>>"


def selection_audit(requests: DataFrame) -> DataFrame:
    """Check recorded source selections: ``problem`` and the ``selected`` numbers.

    Requests: ``request_id, question, selection`` (JSON, possibly fenced) and ``citations``
    with ``index, chunk_id, chunk_text, context_chunk_ids``. The subject stands in the
    question and in the source or its context; the quote stands in the source.
    """
    raw = F.regexp_replace(F.trim("selection"), r"^```(?:json)?\s*|\s*```$", "")
    parsed = requests.withColumns({
        "_keys": F.map_keys(F.from_json(raw, "map<string,string>")),
        "_m": F.from_json(raw, _SELECTION)["source_matches"],
        "_objects": F.from_json(raw, "struct<source_matches:array<map<string,string>>>")["source_matches"],
        "_question": nfkc_squash(F.col("question")),
        "_sources": F.split(nfkc_squash(F.array_join(F.transform("citations", lambda c: c["chunk_text"]), _NUL, "")), _NUL),
    })
    flat = F.flatten(F.transform("_m", lambda m: F.array(F.coalesce(m["subject"], F.lit("")), F.coalesce(m["quote"], F.lit("")))))
    ready = parsed.withColumn("_said", F.split(nfkc_squash(F.array_join(flat, _NUL)), _NUL))
    n = F.size("citations")
    context = lambda c: F.filter("citations", lambda x: F.array_contains(c["context_chunk_ids"], x["chunk_id"]))

    def bad(m: Column, i: Column) -> Column:
        at = (m["source_index"] - 1).cast("int")
        subject, quote = F.get("_said", 2 * i), F.get("_said", 2 * i + 1)
        source = F.get("_sources", at)
        around = F.array_join(F.transform(
            context(F.get("citations", at)), lambda x: F.get("_sources", (x["index"] - 1).cast("int"))), "")
        good = (
            m["source_index"].between(1, n) & (subject != "") & F.contains(F.col("_question"), subject)
            & F.contains(F.concat(source, around), subject)
            & (F.length(quote) >= S.MIN_QUOTE_CHARS) & F.contains(source, quote)
        )
        return ~F.coalesce(good, F.lit(False))

    problem = (
        F.when(F.col("_keys").isNull(), "not_json")
        .when((F.size("_keys") != 1) | (F.get("_keys", F.lit(0)) != "source_matches") | F.col("_m").isNull()
              | ~_has_only(F.col("_objects"), _SELECTION_FIELDS), "bad_fields")
        .when(F.exists(F.transform("_m", bad), lambda b: b), "bad_match")
    )
    chosen = F.array_distinct(F.flatten(F.transform("_m", lambda m: F.concat(
        F.array(m["source_index"]),
        F.transform(context(F.get("citations", (m["source_index"] - 1).cast("int"))), lambda x: x["index"].cast("bigint")),
    ))))
    return ready.withColumn("problem", problem).withColumn(
        "selected", F.when(F.col("problem").isNull(), chosen)
    ).drop("_keys", "_m", "_objects", "_question", "_sources", "_said")


# ---------------------------------------------------------------- source listings


def list_sources(citations: DataFrame) -> DataFrame:
    """All sources of earlier answers, once each, renumbered and rendered as lines.

    Citations: ``session_id, position, chunk_id, doc_title, char_start, char_end``. Where a
    chunk occurs again, its last record counts; its place is the first.
    """
    once = citations.groupBy("session_id", "chunk_id").agg(
        F.min("position").alias("position"),
        F.max_by(F.struct("doc_title", "char_start", "char_end"), "position").alias("s"),
    )
    w = Window.partitionBy("session_id").orderBy("position")
    title = F.replace(
        F.replace(F.trim(F.regexp_replace("s.doc_title", r"(?U)\s+", " ")), F.lit("["), F.lit("［")), F.lit("]"), F.lit("］")
    )
    numbered = once.withColumn("index", F.row_number().over(w).cast("bigint"))
    line = F.concat(
        F.lit("- "), title, F.lit("，原文字符位置 "), F.col("s.char_start").cast("string"), F.lit("–"),
        F.col("s.char_end").cast("string"), F.lit("。["), F.col("index").cast("string"), F.lit("]"),
    )
    return numbered.select("session_id", "index", "chunk_id", line.alias("line"))


def sources_by_document(citations: DataFrame) -> DataFrame:
    """Citations of an answer grouped by document: (answer_id, doc_id, numbers, first)."""
    once = citations.groupBy("answer_id", "doc_id", "chunk_id").agg(F.min("index").alias("index"))
    return once.groupBy("answer_id", "doc_id").agg(
        F.array_sort(F.collect_list("index")).alias("numbers"), F.min("index").alias("first")
    )


# ---------------------------------------------------------------- workflows


def propagate_stale(steps: DataFrame, stale: DataFrame) -> DataFrame:
    """Steps with stale sources become errors, and so do the steps that depend on them.

    Steps: ``workflow_id, step, status, depends_on array<int>, citations``. Stale:
    ``chunk_id``. Dependencies only point back, so one pass in step order suffices; a
    workflow has a handful of steps.
    """
    used = steps.select("workflow_id", "step", F.explode_outer("citations.chunk_id").alias("chunk_id")).join(
        stale.select("chunk_id").distinct(), "chunk_id", "left_semi"
    ).select("workflow_id", "step").distinct().withColumn("_stale", F.lit(True))
    marked = steps.join(used, ["workflow_id", "step"], "left")
    own = F.coalesce(F.col("_stale"), F.lit(False))
    per_flow = marked.groupBy("workflow_id").agg(
        F.array_sort(F.collect_list(F.struct("step", own.alias("own"), "depends_on"))).alias("s")
    )
    changed = F.aggregate(
        "s", F.array().cast("array<int>"),
        lambda known, s: F.when(
            s["own"] | F.arrays_overlap(known, s["depends_on"]), F.array_append(known, s["step"].cast("int"))
        ).otherwise(known),
    )
    hit = per_flow.select("workflow_id", F.explode(changed).alias("step")).withColumn("_changed", F.lit(True))
    lost = F.coalesce(F.col("_changed"), F.lit(False))
    return marked.join(hit, ["workflow_id", "step"], "left").withColumns({
        "status": F.when(lost, F.lit(S.ERROR)).otherwise(F.col("status")),
        "reason": F.when(lost & own, "source_changed").when(lost, "dependency_unavailable"),
    }).drop("_stale", "_changed")


_SEEN = "array<struct<chunk_id:bigint,doc_id:bigint>>"
_DONE = "array<struct<step:int,valid:boolean,conclusion:string,numbers:array<bigint>>>"


def synthesise(steps: DataFrame) -> DataFrame:
    """Number the citations of each workflow across its steps and rewrite the markers.

    Steps: ``workflow_id, step int, status, conclusion, citations array<struct<index
    bigint, chunk_id bigint, doc_id bigint>>``. A chunk keeps the number of its first use.
    A step whose markers have no source, or whose number or chunk is ambiguous, becomes
    ``valid = false`` and adds nothing. Output: (workflow_id, step, valid, conclusion,
    numbers, and ``sources``, the global list of the workflow).
    """

    def step(state: Column, s: Column) -> Column:
        answered = s["status"] == S.ANSWERED
        first = F.aggregate(
            s["citations"], state["seen"],
            lambda known, c: F.when(F.exists(known, lambda k: k["chunk_id"] == c["chunk_id"]), known).otherwise(
                F.array_append(known, F.struct(c["chunk_id"].alias("chunk_id"), c["doc_id"].alias("doc_id")))
            ),
        )

        def numbered(known: Column) -> Column:
            ids = _ids(known)
            pairs = F.array_distinct(F.transform(
                s["citations"], lambda c: F.struct(c["index"].alias("k"), F.array_position(ids, c["chunk_id"]).alias("v"))
            ))
            same_doc = F.forall(s["citations"], lambda c: F.exists(
                known, lambda k: (k["chunk_id"] == c["chunk_id"]) & (k["doc_id"] == c["doc_id"])))
            unique = F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"]))) == F.size(pairs)
            mapping = F.when(unique, F.map_from_entries(pairs))
            mapped = F.coalesce(F.size(T.unmapped_citations(s["conclusion"], mapping)) == 0, F.lit(False))
            valid = answered & same_doc & unique & mapped
            done = F.struct(
                s["step"].alias("step"), valid.alias("valid"),
                F.when(valid, T.remap_citations(s["conclusion"], mapping)).alias("conclusion"),
                F.when(valid, F.array_distinct(F.transform(pairs, lambda p: p["v"]))).alias("numbers"),
            )
            return F.struct(
                F.when(valid, known).otherwise(state["seen"]).alias("seen"),
                F.array_append(state["done"], done).alias("done"),
            )

        return let(first, numbered)

    start = F.struct(F.array().cast(_SEEN).alias("seen"), F.array().cast(_DONE).alias("done"))
    flows = steps.groupBy("workflow_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "status", F.coalesce("conclusion", F.lit("")).alias("conclusion"), "citations"))).alias("s")
    )
    folded = flows.withColumn("r", F.aggregate("s", start, step))
    return folded.select("workflow_id", F.explode("r.done").alias("d"), F.col("r.seen").alias("sources")).select(
        "workflow_id", "d.step", "d.valid", "d.conclusion", "d.numbers", "sources"
    )


# How a step appears in the summary.
_NOTES = {
    S.INSUFFICIENT: "本步证据不足：", S.NEEDS_REVIEW: "找到可能相关的原文，需人工核对：", S.ERROR: "该步未完成：",
}


def summary_text(steps: DataFrame) -> DataFrame:
    """The summary of each workflow: (workflow_id, answer).

    Steps: ``workflow_id, step, goal, status, note, conclusion`` after numbering.
    """
    header = F.concat(F.lit("**"), F.col("step").cast("string"), F.lit(". "), F.col("goal"), F.lit("**\n\n"))
    lead = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in _NOTES.items() for x in p]), F.col("status")), F.lit(_NOTES[S.ERROR])
    )
    body = F.when(F.col("status") == S.ANSWERED, F.col("conclusion")).otherwise(
        F.concat(F.lit("（"), lead, F.coalesce("note", F.lit("")), F.lit("）"))
    )
    return steps.groupBy("workflow_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("step", F.concat(header, body).alias("b")))), lambda x: x["b"]), "\n\n"
        ).alias("answer")
    )


# ---------------------------------------------------------------- conflicting snapshots


def quarantine(sources: DataFrame, *fingerprint_columns: str) -> tuple[DataFrame, DataFrame]:
    """Split recorded sources into consistent ones and ones whose chunk has two contents.

    Compared by the smallest and largest fingerprint per chunk, so a chunk recorded very
    often is combined before the shuffle.
    """
    mark = F.sha2(F.to_json(F.struct(*fingerprint_columns), {"ignoreNullFields": "false"}), 256)
    bad = sources.groupBy("chunk_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).filter("a <> b").select("chunk_id")
    return sources.join(bad, "chunk_id", "left_anti"), sources.join(bad, "chunk_id", "left_semi")
