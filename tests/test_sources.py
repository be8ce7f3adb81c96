import datetime as dt
import json
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from noteloom.operators import maintenance as M, quality as Q
from noteloom.schemas import CATALOG_DOCUMENTS, KNOWLEDGE_BASES
from noteloom.sources import catalogue as K, corpus as C, reports as RP, snapshots as SN
from noteloom.sources.intake import intake


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, name, data):
    import os

    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data)


def test_notes_keep_line_ends_and_order(spark, folder):
    put(folder, "b.md", "# B\r\nx\r\n".encode())
    put(folder, "sub/A.md", "é\n".encode())
    put(folder, "c.txt", b"no")
    rows = C.read_notes(spark, folder).collect()
    assert [(r.path, r.title, r.text, r.char_count) for r in rows] == [("sub/A.md", "A.md", "é\n", 2), ("b.md", "b.md", "# B\r\nx\r\n", 8)]
    assert C.file_manifest(spark, folder).count() == 3


def test_intake_reasons(spark):
    big = b"x" * 50
    files = [
        ("in/a.md", b"ok\r\n", None), ("in/a.pdf", b"ok", "unsupported_type"), ("in/e.txt", b" \n", "empty"), ("in/u.md", b"a\xff", "not_utf8"),
        ("in/n.md", b"a\x00", "nul"), ("in/b.md", big, "too_large"), ("in/" + "l" * 260 + ".md", b"x", "name_too_long"), ("C:\\fake\\w.TXT", b"w", None), ("in/x\x01.md", b"x", "bad_name"),
    ]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c, _ in files], "path string, content binary")
    rows = {r.path: r for r in intake(df, 40).collect()}
    assert [rows[p].reason for p, _, _ in files] == [r for _, _, r in files]
    assert rows["in/a.md"].text == "ok\r\n" and rows["C:\\fake\\w.TXT"].title == "w.TXT" and rows["in/u.md"].text is None


def test_question_manifest(spark, folder):
    data = {"version": 2, "description": "d", "libraries": [{"key": "a", "name": "A", "notes_dir": "n"}],
            "items": [{"question": "q", "expected_doc": "x.md", "expected_keywords": ["k"], "in_kb": True, "library": "a", "difficulty": "basic"}]}
    put(folder, "set.json", json.dumps(data).encode())
    libs, items = C.read_question_manifest(spark, f"{folder}/set.json")
    assert libs.first().key == "a" and items.first().expected_keywords == ["k"]
    put(folder, "old.json", json.dumps({**data, "version": 1}).encode())
    with pytest.raises(Exception):
        C.read_question_manifest(spark, f"{folder}/old.json")[1].collect()


def test_snapshots_publish_or_keep_the_old(spark, folder):
    table = f"{folder}/chunks"
    with pytest.raises(FileNotFoundError):
        SN.read_current(spark, table)
    first = spark.range(5).withColumnRenamed("id", "k")
    SN.replace_table(first, table)
    assert SN.read_current(spark, table).count() == 5
    with pytest.raises(SN.SnapshotRejected):
        SN.replace_table(spark.range(9).withColumnRenamed("id", "k"), table, check=lambda d: d.filter("k = 7"))
    assert SN.read_current(spark, table).count() == 5
    SN.replace_table(SN.read_current(spark, table).filter("k < 3"), table, check=lambda d: d.filter("k = 7"))
    assert SN.read_current(spark, table).count() == 3
    SN.copy_verified(first, f"{folder}/copy", "k", "chunks")
    assert SN.read_current(spark, f"{folder}/copy").count() == 5


def test_catalogue_round_trip_and_damage(spark, folder):
    now = dt.datetime(2024, 5, 1, 12, 0, 0, 123456)
    bases = spark.createDataFrame([(1, "a", None, now, now)], KNOWLEDGE_BASES)
    rec = lambda p: (p, "h" * 64, 1, 1, 1)
    docs = spark.createDataFrame([(1, 1, "t", 1, rec("p"), None, now, now), (2, 1, "u", 2, rec("q"), rec("r"), now, now)], CATALOG_DOCUMENTS)
    K.write_catalogue(bases, docs, f"{folder}/cat")
    b, d = K.read_catalogue(spark, f"{folder}/cat")
    assert b.collect() == bases.collect() and sorted(d.collect()) == sorted(docs.collect())
    assert M.catalogue_differences(d, docs).count() == 0
    sealed = SN.read_current(spark, f"{folder}/cat").withColumn("payload", F.replace("payload", F.lit("\"u\""), F.lit("\"x\"")))
    SN.replace_table(sealed, f"{folder}/cat")
    with pytest.raises(K.CatalogueDamaged):
        K.read_catalogue(spark, f"{folder}/cat")


def test_reports_and_trees(spark, folder):
    head = spark.createDataFrame([("top_k", "8")], "field string, value string")
    rows = spark.createDataFrame([("overall", "all", "mrr", 0.987)], RP.METRICS)
    RP.write_report(head, rows, f"{folder}/r")
    h, m = RP.read_report(spark, f"{folder}/r")
    assert h.collect() == head.collect() and m.collect() == rows.collect()
    a = spark.createDataFrame([("x", 1, "s"), ("y", 1, "s"), ("z", 1, "s")], "path string, length bigint, sha256 string")
    b = spark.createDataFrame([("x", 1, "s"), ("y", 1, "t"), ("w", 1, "s")], "path string, length bigint, sha256 string")
    assert sorted(tuple(r) for r in RP.tree_differences(a, b).collect()) == [("w", "extra"), ("y", "different"), ("z", "missing")]
    assert Q.tree_digest(a).first() == Q.tree_digest(a.repartition(3)).first() != Q.tree_digest(b).first()


def test_profile_guard(spark):
    meta = spark.createDataFrame([("embedding_model", "m"), ("embedding_dimension", "3"), ("embedding_url", "u")], "key string, value string")
    chunks = spark.createDataFrame([(1,)], "chunk_id bigint")
    M.ensure_profile(meta, chunks, "m", 3, "u/")
    M.ensure_profile(meta, chunks.limit(0), "other", 3, "u")
    for model, dim in (("other", 3), ("m", 4)):
        with pytest.raises(M.ProfileMismatch):
            M.ensure_profile(meta, chunks, model, dim, "u")


def test_failed_build_keeps_the_old_index(spark):
    cols = ("doc_id bigint, ingest_version bigint, status string, last_error_code string, last_error_message string, "
            "pending_file_path string, pending_content_hash string, pending_char_count bigint")
    docs = spark.createDataFrame([(1, 2, "processing", None, None, "c1", "h", 5), (2, 2, "processing", None, None, "c2", "h", 5), (3, 3, "processing", None, None, "c3", "h", 5)], cols)
    chunks = spark.createDataFrame([(1, 1)], "doc_id bigint, chunk_id bigint")
    failed = spark.createDataFrame([(1, 2, "c1", "E", "m"), (2, 2, "c2", "E", "m"), (3, 2, "c3", "E", "m"), (3, 3, "other", "E", "m")],
                                   "doc_id bigint, ingest_version bigint, candidate_path string, code string, message string")
    rows = {r.doc_id: (r.status, r.last_error_code, r.pending_file_path) for r in M.mark_failures(failed, docs, chunks).collect()}
    assert rows == {1: ("ready", "E", None), 2: ("failed", "E", None), 3: ("processing", None, "c3")}


def test_incremental_sync_of_files(spark, folder):
    """A change on disk is noticed, planned, rebuilt and replaced; nothing else is touched."""
    from noteloom.operators.chunking import chunk_rows, split_documents

    for name, text in (("a.md", "old text."), ("b.md", "same text.")):
        put(folder, name, text.encode())
    files = C.read_files(spark, folder)
    record = F.struct("path", F.sha2("content", 256).alias("content_hash"), F.length(F.decode("content", "UTF-8")).cast("bigint").alias("char_count"), "size", "mtime_ns")
    none = F.lit(None).cast("struct<path:string,content_hash:string,char_count:bigint,size:bigint,mtime_ns:bigint>")
    catalogue = files.select(F.ascii("path").cast("bigint").alias("doc_id"), F.lit(1).alias("kb_id"), F.col("path").alias("title"),
                             F.lit(1).cast("bigint").alias("ingest_version"), record.alias("active"), none.alias("pending"), F.lit(0).alias("created_at")).cache()
    assert catalogue.count() == 2
    docs = catalogue.select("doc_id", "kb_id", "title", "ingest_version", F.col("active.path").alias("file_path"), F.col("active.content_hash").alias("content_hash"),
                            F.col("active.char_count").alias("char_count"), *[F.lit(None).cast(t).alias(c) for c, t in (("pending_file_path", "string"), ("pending_content_hash", "string"), ("pending_char_count", "bigint"))], "created_at")
    old = chunk_rows(split_documents(files.select(F.ascii("path").cast("bigint").alias("doc_id"), F.decode("content", "UTF-8").alias("text")))).cache()
    assert old.count() == 2
    put(folder, "a.md", "a new and longer text.".encode())
    now = C.read_files(spark, folder)
    seen = M.suspects(now.select("path", "size", "mtime_ns"), catalogue)
    assert {r.title: r.verdict for r in seen.collect()} == {"a.md": "suspect", "b.md": "same"}
    observed = M.observe(seen.filter("verdict = 'suspect'"), now)
    plan = M.plan_sync(catalogue, docs, observed.select("doc_id", "verdict").unionByName(seen.filter("verdict = 'same'").select("doc_id", "verdict")))
    assert {chr(r.doc_id): (r.action, r.ingest_version) for r in plan.collect()} == {"a": ("reindex", 2), "b": ("skip", 1)}
    assert M.sync_summary(plan).first().reindexed == 1
    todo = plan.filter("action IN ('reindex', 'resume')").select("doc_id")
    fresh = chunk_rows(split_documents(observed.join(todo, "doc_id", "left_semi").select("doc_id", "text")))
    after = M.replace_chunks(old, fresh, todo)
    assert sorted(r.content for r in after.collect()) == ["a new and longer text.", "same text."]


def test_contents_do_not_move_to_be_compared(spark):
    active = "struct<path:string,content_hash:string,char_count:bigint,size:bigint,mtime_ns:bigint>"
    catalogue = spark.createDataFrame([(1, ("a", "x", 1, 1, 1)), (2, ("b", "x", 1, 1, 1))], f"doc_id long, active {active}")
    files = spark.createDataFrame([("a", bytearray(b"text"), 4, 2)], "path string, content binary, size long, mtime_ns long")
    seen = M.suspects(files.select("path", "size", "mtime_ns"), catalogue)
    looked = M.observe(seen, files).select("doc_id", "verdict", "observed")
    assert {r.doc_id: (r.verdict, r.observed and r.observed.char_count) for r in looked.collect()} == {1: ("changed", 4), 2: ("missing", None)}
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", looked._jdf.queryExecution().explainString(mode))
    assert moved and not any(re.search(r"\b(content|text)#", columns) for columns in moved)
