import pytest
from pyspark.sql import functions as F

from noteloom.operators import syncing
from noteloom.plans import syncing as plans
from noteloom.sources import table_set
from noteloom.sources.snapshots import SnapshotRejected
from noteloom.sources.table_set import content_digest, copy_tables, create_set, open_set


def tables(spark, n=200):
    documents = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("title"))
    chunks = documents.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("chunk_index"))
    return {"documents": documents, "chunks": chunks}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_change_writes_and_reads_only_the_buckets_it_touches(spark, tmp_path):
    first = create_set(str(tmp_path / "set"), tables(spark), buckets=16)
    keys = spark.createDataFrame([(3,), (77,)], "doc_id bigint")
    touched = first.touched(keys)
    fresh = {"chunks": spark.createDataFrame([(3, 90), (3, 91)], "doc_id bigint, chunk_index int")}
    second = first.replace(keys, fresh)
    want = sorted([(d, c) for d in range(200) if d not in (3, 77) for c in range(d % 3 + 1)] + [(3, 90), (3, 91)])
    assert rows(second.table("chunks")) == want
    assert rows(second.table("documents")) == rows(first.table("documents"))
    assert second.folders["documents"] == first.folders["documents"]  # not named in the change
    moved = {b for b in range(16) if second.folders["chunks"].get(b) != first.folders["chunks"].get(b)}
    assert moved == set(touched)
    files = first.table("chunks", touched).inputFiles()
    assert all(any(f"bucket={b}/" in f for b in touched) for f in files)
    assert rows(open_set(spark, str(tmp_path / "set")).table("chunks")) == want
    assert rows(first.table("chunks")) != want  # a reader of the old version is not disturbed
    assert second.replace(keys.limit(0), {}) is second


def test_a_failed_check_leaves_all_tables_as_they_were(spark, tmp_path):
    root = str(tmp_path / "set")
    first = create_set(root, tables(spark), buckets=4)
    keys = spark.createDataFrame([(5,)], "doc_id bigint")
    bad = {"documents": spark.createDataFrame([(5, "new")], "doc_id bigint, title string"), "chunks": first.table("chunks").limit(0)}

    def check(staged):
        return staged["documents"].join(staged["chunks"], "doc_id", "left_anti")

    with pytest.raises(SnapshotRejected):
        first.replace(keys, bad, check)
    now = open_set(spark, root)
    assert now.folders == first.folders and rows(now.table("documents")) == rows(first.table("documents"))


def test_copies_are_published_only_with_equal_digests(spark, tmp_path, monkeypatch):
    source = tables(spark, 50)
    copy = copy_tables(source, str(tmp_path / "copy"), buckets=4)
    assert all(rows(copy.table(n)) == rows(df) for n, df in source.items())
    write = table_set._write
    monkeypatch.setattr(table_set, "_write", lambda place, name, df: write(place, name, df.filter("doc_id <> 7")))  # a lost row
    with pytest.raises(SnapshotRejected):
        copy_tables(source, str(tmp_path / "copy"))
    assert open_set(spark, str(tmp_path / "copy")).folders == copy.folders
    with pytest.raises(FileNotFoundError):
        open_set(spark, str(tmp_path / "none"))


def test_digest_sees_rows_and_not_their_order(spark):
    digest = lambda data: tuple(content_digest(spark.createDataFrame(data, "a bigint, b string")).first())
    assert digest([(1, "x"), (2, None)]) == digest([(2, None), (1, "x")])
    assert digest([(1, "x"), (1, "x")]) != digest([(1, "x")])
    assert digest([(1, None)]) != digest([(1, "")]) != digest([(1, "null")])


def test_sync_changes_only_what_it_should_and_can_be_repeated(spark, sf_dir):
    index = plans.published(spark, sf_dir)
    files = plans.source_files(spark, sf_dir)
    after, plan, summary = syncing.sync_index(index, files, plans.chunker)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    assert summary.first().asDict() == {
        "checked": sum(counts.values()), "refreshed": counts["refresh"], "reindexed": counts["reindex"], "resumed": counts["resume"],
        "blocked": counts["blocked"]}
    _, again, _ = syncing.sync_index(after, files, plans.chunker)
    actions = {r.action for r in again.join(plan.filter("action <> 'blocked'").select("doc_id"), "doc_id", "left_semi").collect()}
    assert actions == {"skip"}
    still = after.table("documents").join(plan.filter("action in ('skip', 'blocked')").select("doc_id"), "doc_id", "left_semi")
    assert still.exceptAll(index.table("documents")).isEmpty()


def test_a_rebuild_with_a_missing_source_changes_nothing(spark, sf_dir):
    index = plans.published(spark, sf_dir)
    with pytest.raises(SnapshotRejected, match="source_missing"):
        syncing.rebuild_index(index, plans.source_files(spark, sf_dir), plans.chunker)
    assert open_set(spark, index.root).folders == index.folders
