import re

import pytest
from pyspark.sql import functions as F

from noteloom.operators import postings as P
from noteloom.operators import retrieval as R
from noteloom.plans import inputs as I, search

CHUNK = "chunk_id bigint, kb_id bigint, content string"
ASK = "question_id bigint, kb_id bigint, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, i % 3, f"common words and number {i} {'rare' * (i % 17 == 0)}") for i in range(300)]
    return spark.createDataFrame([*rows, (900, 1, None), (901, 1, ""), (902, 2, "ab")], CHUNK)


def test_rows_and_totals_equal_plain_counts(spark, chunks):
    index = P.build_postings(chunks, "text", buckets=3, folders=5)
    texts = {r.chunk_id: (r.content or "").lower() for r in chunks.collect()}
    want = {}
    for c, t in texts.items():
        for i in range(len(t) - 2):
            want[c, t[i : i + 3]] = want.get((c, t[i : i + 3]), 0) + 1
    rows = index.rows.collect()
    assert {(r.chunk_id, r.gram): r.tf for r in rows} == want and len(rows) == len(want)
    heads = [r for r in index.blocks.collect() if r.gram == ""]
    assert {c: n for r in heads for c, n in zip(r.chunk_ids, r.lengths)} == {c: max(0, len(t) - 2) for c, t in texts.items()}
    assert (index.chunks, index.tokens) == (len(texts), sum(max(0, len(t) - 2) for t in texts.values()))
    df = {r.gram: r.df for r in index.grams.collect()}
    assert all(df[g] == sum(g in t for t in texts.values()) for _, g in list(want)[:50])


def test_an_index_can_be_opened_again_and_finds_the_same(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    index = P.build_postings(chunks, "text", path=path, buckets=3, folders=5)
    ask = spark.createDataFrame([(1, None, "rare number 34"), (2, 1, "COMMON words"), (3, 9, "rare")], ASK)
    again = P.open_postings(spark, path)
    assert (again.chunks, again.tokens, again.kind) == (index.chunks, index.tokens, "text")
    assert sorted(P.bm25_hits(ask, again).collect()) == sorted(P.bm25_hits(ask, index).collect())
    with pytest.raises(ValueError):
        P.word_hits(ask, index)
    with pytest.raises(ValueError):
        P.build_postings(chunks, "letters")


def test_search_opens_only_the_folders_asked_and_sums_without_exchange(spark, chunks):
    index = P.build_postings(chunks, "text", buckets=3, folders=64)
    ask = spark.createDataFrame([(1, None, "rare")], ASK)
    physical = plan(P.bm25_hits(ask, index))
    folders = re.search(r"PartitionFilters: \[[^\]]*folder#\d+ IN \(([\d,]+)\)", physical)[1].split(",")
    assert len(folders) <= 3  # of rar and are, and of the rows with the chunks
    assert "Bucketed: true" in physical
    scored = physical[physical.index("FlatMapGroupsInArrow"):]
    assert "Exchange hashpartitioning(block" not in scored


def test_search_of_an_index_reads_no_text(spark, sf_dir):
    asked = I.questions(spark, sf_dir)
    physical = plan(P.bm25_hits(asked, I.line_postings(spark, sf_dir)))
    assert "content" not in physical and "ReadSchema: struct<text:string>" not in physical
    found = plan(search.hybrid_retrieve(spark, sf_dir))
    reads = re.findall(r"ReadSchema: struct<([^\n]*)>", found)
    assert sum("content:string" in r for r in reads) == 1  # at rehydration


def test_letters_that_grow_in_lower_case_are_found(spark):
    table = spark.createDataFrame([(1, 1, "DİYARBAKIR"), (2, 1, "other text")], CHUNK)
    ask = spark.createDataFrame([(1, None, "DİYAR"), (2, None, "di̇yar")], ASK)
    assert {(r.question_id, r.chunk_id) for r in R.search_bm25(ask, table).collect()} == {(1, 1), (2, 1)}
    grams = spark.createDataFrame([("abAB abab",)], "t string").select(P.folded_grams(F.col("t")).alias("g")).first().g
    assert {g.gram: g.times for g in grams}["aba"] == 2  # asked as abA and as aba


def test_empty_tables_and_questions(spark, chunks):
    ask = spark.createDataFrame([(1, None, "rare number")], ASK)
    assert R.search_bm25(ask, chunks.limit(0)).count() == 0
    assert R.search_bm25(ask.limit(0), chunks).count() == 0
    assert R.search_trgm(ask, chunks.limit(0)).count() == 0
    assert R.search_bm25(spark.createDataFrame([(1, None, None), (2, None, "   ")], ASK), chunks).count() == 0
