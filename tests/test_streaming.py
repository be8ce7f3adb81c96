import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from noteloom.operators import maintenance as M
from noteloom.sources import snapshots as SN
from noteloom.streaming import sessions as SS, tasks as ST, uploads as SU


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


EVENTS = "doc_id bigint, ingest_version bigint, seq bigint, kind string, error_code string"


def run(df, folder, mode="append"):
    """All output of a stream over what is there now."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_stream_of_tasks_equals_the_batch_result(spark, folder):
    rows = [(d, v, i, k, "E" if k == "fail" else None) for i, (d, v, k) in enumerate([
        (1, 1, "queue"), (1, 1, "claim"), (1, 1, "claim"), (1, 2, "queue"), (1, 1, "succeed"), (1, 2, "claim"), (1, 2, "fail"),
        (2, 1, "claim"), (2, 1, "recover"), (2, 1, "claim"), (2, 1, "succeed"), (2, 1, "queue"), (3, 5, "queue"), (3, 4, "claim")])]
    df = spark.createDataFrame(rows, EVENTS).coalesce(1)
    for key, value in ST.state_store_conf().items():
        spark.conf.set(key, value)
    df.filter("seq < 7").write.parquet(f"{folder}/in")
    stream = lambda: ST.track_tasks(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"))
    run(stream(), folder)
    df.filter("seq >= 7").write.mode("append").parquet(f"{folder}/in")
    out = run(stream(), folder)
    last = {r.doc_id: r for r in out.groupBy("doc_id").agg(F.max_by(F.struct("ingest_version", "status", "attempt_count", "recovery_count", "last_error_code"), "seq").alias("s")).select("doc_id", "s.*").collect()}
    batch = {r.doc_id: r for r in M.latest_tasks(df).collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in batch.items()}
    assert (last[1].status, last[1].last_error_code, last[3].status) == ("failed", "E", "queued")
    assert [r.seq for r in out.filter("NOT applied AND doc_id = 1").orderBy("seq").collect()] == [2, 4]


def test_sessions_close_and_keep_their_last_turns(spark, folder):
    for key, value in ST.state_store_conf().items():
        spark.conf.set(key, value)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s), i, f"q{i}", f"a{i}") for i, s in enumerate([0, 600, 1200, 3000, 3001, 3002, 3003])]
    rows += [("b", t0, 0, "q", "a"), ("b", t0 + dt.timedelta(seconds=1801), 1, "q", "a"), ("z", t0 + dt.timedelta(days=2), 0, "q", "a")]
    schema = "session_id string, ts timestamp, turn int, question string, answer string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    out = run(SS.close_sessions(spark.readStream.schema(schema).parquet(f"{folder}/in")), folder).orderBy("session_id", "started").collect()
    assert [(r.session_id, r.turns, [h.turn for h in r.history]) for r in out] == [("a", 7, [2, 3, 4, 5, 6]), ("b", 1, [0]), ("b", 1, [1])]


def test_uploads_are_applied_once(spark, folder):
    import hashlib
    import os

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame(
        [(1, "a.md", "ready", "f1", sha("old"), 1, 3, None, None, None), (2, "b.md", "failed", "f2", sha("bb"), 4, 0, None, None, None), (3, "c.md", "ready", "f3", sha("cc"), 1, 2, None, None, None)],
        "doc_id bigint, title string, status string, file_path string, content_hash string, ingest_version bigint, chunk_count bigint, "
        "pending_file_path string, pending_content_hash string, pending_char_count bigint")
    SN.replace_table(docs, f"{folder}/docs")
    os.makedirs(f"{folder}/in")
    def put(name, text):
        with open(f"{folder}/in/{name}", "w") as handle:
            handle.write(text)
    put("a.md", "new text"), put("b.md", "bb"), put("c.md", "cc"), put("x.md", "unknown")
    def go():
        SU.run_uploads(SU.file_stream(spark, f"{folder}/in"), f"{folder}/docs", f"{folder}/cp").awaitTermination(120)
        return {r.doc_id: (r.status, r.ingest_version, r.pending_file_path, r.pending_content_hash) for r in SN.read_current(spark, f"{folder}/docs").collect()}
    want = {1: ("pending", 2, "candidates/1-v2", sha("new text")), 2: ("pending", 5, "f2", sha("bb")), 3: ("ready", 1, None, None), 4: ("pending", 1, "candidates/4-v1", sha("unknown"))}
    put("empty.md", "  "), put("y.exe", "no")
    assert go() == want
    assert go() == want
    for _ in range(2):
        SU.run_rejects(SU.file_stream(spark, f"{folder}/in", "*"), f"{folder}/rejects", f"{folder}/cp2").awaitTermination(120)
    assert sorted((r.title, r.reason) for r in spark.read.parquet(f"{folder}/rejects").collect()) == [("empty.md", "empty"), ("y.exe", "unsupported_type")]
    uploads = spark.createDataFrame([("a.md", sha("new text"), 8, dt.datetime(2024, 1, 1))], "title string, content_hash string, char_count bigint, modificationTime timestamp")
    again = SU.apply_uploads(SN.read_current(spark, f"{folder}/docs"), uploads)
    assert {r.doc_id: r.ingest_version for r in again.collect()} == {1: 2, 2: 5, 3: 1, 4: 1}
