import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.functions.grams import query_grams, trgm_similarity
from noteloom.functions.vectors import cosine
from noteloom.operators import ann, retrieval as R
from noteloom.operators.embedding import EmbeddingContractError, TransientEmbeddingError, embed, embed_distinct, letter_profile

CHUNK = "chunk_id bigint, doc_id bigint, kb_id bigint, content string, embedding array<double>"
ASK = "question_id bigint, kb_id bigint, text string, embedding array<double>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, 1, 1, "transport control protocol", [1.0, 0.0, 0.0]),
        (2, 1, 1, "100% of_it \"quoted\"", [0.9, 0.1, 0.0]),
        (3, 2, 2, "transport control protocol", [1.0, 0.0, 0.0]),
        (4, 2, 2, "数据库事务隔离级别", [0.0, 0.0, 1.0]),
        (5, 2, 2, "", [0.0, 0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, CHUNK).cache()


def hits(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("question_id", columns[-1]).collect()]


def test_vector_search_scopes_ties_and_zero_vectors(spark, chunks):
    ask = spark.createDataFrame(
        [(1, None, "", [1.0, 0.0, 0.0]), (2, 1, "", [1.0, 0.0, 0.0]), (3, 9, "", [1.0, 0.0, 0.0])], ASK
    )
    found = hits(R.search_vector(ask, chunks, 4), "question_id", "chunk_id", "similarity", "vector_rank")
    assert [f[:2] for f in found] == [(1, 1), (1, 3), (1, 2), (1, 4), (2, 1), (2, 2)]
    assert found[0][2] == 1.0 and found[3][2] == 0.0


def test_vector_dimension_mismatch_fails(spark, chunks):
    ask = spark.createDataFrame([(1, None, "", [1.0, 0.0])], ASK)
    with pytest.raises(Exception, match="dimension"):
        R.search_vector(ask, chunks).collect()


def test_kernel_agrees_with_the_expression_and_both_plans_agree(spark):
    r = random.Random(3)
    rows = [(i, i % 7, i % 3, f"word{i % 11} text {i % 5}", [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    table = spark.createDataFrame(rows, CHUNK)
    ask = table.filter("chunk_id < 40").select(
        F.col("chunk_id").alias("question_id"), F.when(F.col("chunk_id") % 2 == 0, F.col("kb_id")).alias("kb_id"),
        F.col("content").alias("text"), "embedding",
    )
    found = R.search_vector(ask, table, 5)
    striped = R.search_vector(ask, table, 5, max_questions=7, stripe_rows=50)
    assert sorted(found.collect()) == sorted(striped.collect())
    q, c = ask.alias("q"), table.alias("c")
    slow = q.join(c, F.col("q.kb_id").isNull() | (F.col("q.kb_id") == F.col("c.kb_id"))).select(
        "question_id", "chunk_id", F.round(cosine(F.col("q.embedding"), F.col("c.embedding")), 9).alias("s")
    ).collect()
    want = {}
    for row in sorted(slow, key=lambda x: (x.question_id, -x.s, x.chunk_id)):
        want.setdefault(row.question_id, []).append(row.chunk_id)
    got = {}
    for row in found.orderBy("question_id", "vector_rank").collect():
        got.setdefault(row.question_id, []).append(row.chunk_id)
    assert got == {k: v[:5] for k, v in want.items()}
    for search in (R.search_bm25, R.search_trgm):
        assert sorted(search(ask, table, 5).collect()) == sorted(search(ask, table, 5, max_questions=7, stripe_rows=50).collect())


def test_short_questions_match_literally(spark, chunks):
    ask = spark.createDataFrame(
        [(1, None, "%", None), (2, None, "f_", None), (3, None, "\"q", None), (4, None, "TR", None), (5, None, "  ", None), (6, 1, "事务", None), (7, None, "事务", None)], ASK
    )
    assert hits(R.search_bm25(ask, chunks), "question_id", "chunk_id", "keyword_rank") == [
        (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (4, 3, 2), (7, 4, 1)
    ]


def test_bm25_equals_the_formula_over_the_whole_index(spark):
    texts = ["the cat sat", "the dog sat on the mat", "a cat", "cats and cats and cats", "", "no"]
    table = spark.createDataFrame([(i, i, i % 2, t, None) for i, t in enumerate(texts)], CHUNK)
    question = "The cats sat"
    ask = spark.createDataFrame([(1, 1, question, None)], ASK)
    grams = [question[i : i + 3] for i in range(len(question) - 2)]
    docs = [[t.lower()[i : i + 3] for i in range(len(t) - 2)] for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    want = {}
    for i, d in enumerate(docs):
        score = 0.0
        for g in dict.fromkeys(grams):
            df = sum(g.lower() in x for x in docs)
            tf = d.count(g.lower())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
            idf = 1e-6 if df and math.log((len(docs) - df + 0.5) / (df + 0.5)) <= 0 else idf
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
        if score and i % 2 == 1:
            want[i] = score
    got = {r.chunk_id: r.score for r in R.search_bm25(ask, table).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-7 for i in got)


def test_trgm_kernel_agrees_with_the_expression(spark):
    texts = ["Hello, big World", "hello_world", "WORLD peace", "naïve café", "数据 库", "x", ""]
    table = spark.createDataFrame([(i, i, 1, t, None) for i, t in enumerate(texts)], CHUNK)
    ask = spark.createDataFrame([(i, None, t, None) for i, t in enumerate(texts)], ASK)
    got = {(r.question_id, r.chunk_id): r.score for r in R.search_trgm(ask, table, 10, 0.1).collect()}
    pairs = ask.select("question_id", "text").join(table.select("chunk_id", "content"), F.lit(True))
    want = {
        (r.question_id, r.chunk_id): r.s
        for r in pairs.withColumn("s", trgm_similarity(F.col("content"), F.col("text"))).collect() if r.s >= 0.1
    }
    assert got == want and got[(0, 0)] == 1.0


def test_query_grams_are_sampled_evenly(spark):
    long = "".join(chr(0x4E00 + i) for i in range(150))
    texts = ["ab", "abcabc", "a   b", long, "a\0bcd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(query_grams(F.col("t"), 64).alias("g"), query_grams(F.col("t")).alias("all")).collect()
    assert rows[0].g == [] and rows[1].g == ["abc", "bca", "cab"]
    assert rows[2].g == ["a  ", "  b"] and rows[4].g == ["bcd"]
    all_grams = [long[i : i + 3] for i in range(148)]
    assert rows[3].g == [all_grams[round(i * 147 / 63)] for i in range(64)]
    assert rows[3].all == all_grams and all(r.all == r.g for r in rows[:3])


@pytest.mark.parametrize(
    "vector, keyword, want",
    [
        ([], [44, 41], [(44, None, 1), (41, None, 2)]),
        ([61, 17, 52], [17, 90, 61], [(17, 2, 1), (61, 1, 3), (90, None, 2), (52, 3, None)]),
        ([300, 8], [12], [(300, 1, None), (12, None, 1), (8, 2, None)]),
    ],
)
def test_fusion_order(spark, vector, keyword, want):
    v = spark.createDataFrame([(1, c, i, 0.5) for i, c in enumerate(vector, 1)], "question_id bigint, chunk_id bigint, vector_rank int, similarity double")
    k = spark.createDataFrame([(1, c, i) for i, c in enumerate(keyword, 1)], "question_id bigint, chunk_id bigint, keyword_rank int")
    rows = R.fuse_rrf(v, k).orderBy("rank").collect()
    assert [(r.chunk_id, r.vector_rank, r.keyword_rank) for r in rows] == want
    assert rows[0].rrf_score == sum(1 / (60 + x) for x in (rows[0].vector_rank, rows[0].keyword_rank) if x)


def test_retrieve_drops_ids_that_are_gone(spark, chunks):
    fused = spark.createDataFrame([(1, 1, 1), (1, 99, 2)], "question_id bigint, chunk_id bigint, rank int")
    assert [r.chunk_id for r in R.rehydrate(fused, chunks).collect()] == [1]
    ask = spark.createDataFrame([(1, 1, "transport protocol", [1.0, 0.0, 0.0])], ASK)
    for channel in ("bm25", "trgm"):
        found = R.retrieve(ask, chunks, 2, keyword_channel=channel).orderBy("rank").collect()
        assert [(r.chunk_id, r.vector_rank, r.keyword_rank) for r in found] == [(1, 1, 1), (2, 2, None)]
    with pytest.raises(ValueError):
        R.retrieve(ask, chunks, keyword_channel="other")


def test_cells_find_most_neighbours(spark, sf_dir, tmp_path):
    from noteloom.plans import inputs as I

    table = I.vectors(spark, sf_dir)
    ask = table.select(F.col("chunk_id").alias("question_id"), "embedding")
    exact = R.search_vector(ask, table, 5)
    found = ann.search_cells(ask, ann.build_cells(table, ann.CellShape(64, 4)), ann.CellShape(64, 4), 5, probes=8)
    assert ann.recall(found, exact).first().recall > 0.75
    shape, place = ann.CellShape(64, 5), str(tmp_path / "cells")
    ann.build_cells(table, shape).write.partitionBy("cell").parquet(place)
    everything = ann.search_cells(ask, spark.read.parquet(place), shape, 5, probes=32)
    assert sorted(everything.collect()) == sorted(exact.collect())
    one = ann.search_cells(ask.limit(1), spark.read.parquet(place), shape, 5, probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", one._jdf.queryExecution().toString())


def test_probes_visit_every_cell_once_nearest_first():
    projection = np.random.default_rng(1).standard_normal(8)
    cells = ann.probed_cells(projection, 1000)
    assert sorted(cells) == list(range(256))
    margin = [sum(abs(p) for i, p in enumerate(projection) if (c >> i & 1) != (p > 0)) for c in cells]
    assert margin == pytest.approx(sorted(margin))


def test_embedding_contract(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "id bigint, text string").coalesce(1)
    rows = embed(df, "text", letter_profile, 26).orderBy("id").collect()
    assert [r.embedding for r in rows] == [list(v) for v in letter_profile([r.text for r in rows])]
    with pytest.raises(Exception, match="components"):
        embed(df, "text", letter_profile, 25).collect()
    with pytest.raises(Exception, match="expected 32 vectors"):
        embed(df, "text", lambda t: letter_profile(t)[:-1], 26).collect()
    with pytest.raises(Exception, match="finite"):
        embed(df, "text", lambda t: [[float("nan")]] * len(t), 1).collect()
    state = {"left": 2}

    def flaky(texts):
        if state["left"]:
            state["left"] -= 1
            raise TransientEmbeddingError("busy")
        return letter_profile(texts)

    assert embed(df, "text", flaky, 26, pause_seconds=0.0).count() == 70
    twice = df.unionByName(df)
    assert embed_distinct(twice, "text", letter_profile, 26).count() == 140
    assert issubclass(EmbeddingContractError, ValueError)
