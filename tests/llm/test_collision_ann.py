import numpy as np
import pandas as pd
import pytest

from noteloom.llm.collision_ann import CollisionIndex, Search, nearest, recall

QUERY = lambda vec_id: vec_id % 20 == 0


def exact(ids, vectors, k):
    for i, q in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            score = vectors @ q
            order = [n for n in np.lexsort((ids, -score)) if ids[n] != i][:k]
            yield from ((int(i), r + 1, int(ids[n]), float(score[n])) for r, n in enumerate(order))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    ids = np.arange(1500)
    rows = spark.createDataFrame([(int(i), v.tolist(), 3) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, rank int")
    best = spark.createDataFrame(list(exact(ids, vectors, 20)), "query_id long, rank int, vec_id long, score double")
    for search in (Search(), Search(block_rows=400, slice_rows=16)):
        found = nearest(rows, QUERY, search)
        got = found.collect()
        assert len(got) == 75 * 20
        assert recall(found, best) >= 0.9
        for r in got:
            assert abs(r.score - vectors[r.vec_id] @ vectors[r.query_id]) < 1e-9 and r.vec_id != r.query_id
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
        assert all([x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by.values())


def test_windows_widen_until_all_rows_collide():
    vectors = np.random.default_rng(2).standard_normal((50, 8))
    index = CollisionIndex(vectors, 10.0, Search(k=50, spare=10))
    assert [len(c) for c in index.candidates(vectors[:3], together=2)] == [50] * 3


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (2, [1.0, 0.0]), (40, [float("nan"), 1.0]), (41, None), (42, [0.0, 0.0]),
        (None, [1.0, 1.0]), (43, [1.0, 2.0, 3.0]), (60, [1.0, 1.0, 1.0]), (80, []), (44, [0.5, None]), (45, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, QUERY).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (60, 1, 43, 6.0)]
    assert nearest(df.limit(0), QUERY).count() == 0


def test_components_of_any_size(spark):
    rows = [(20, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e100, 5.0]), (3, [-1e200, 1.0]), (4, [1e-320, 0.0]), (5, [1e308, 1e308]), (40, [1e308, -1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, QUERY).orderBy("query_id", "rank").collect()]
    inf = float("inf")
    assert [r[2] for r in got[:6]] == [1, 5, 40, 2, 4, 3] and [r[3] for r in got[:3]] == [inf] * 3 and got[5][3] == -inf
    assert abs(got[3][3] / 1e300 - 1) < 1e-12 and 0 < got[4][3] < 1e-100
    asked_40 = {r[2]: r[3] for r in got[6:]}
    assert asked_40[5] == 0.0 and asked_40[20] == inf and asked_40[3] == -inf and len(got) == 12


@pytest.mark.parametrize("case", ["unit", "outlier", "lognormal"])
def test_recall_with_varied_norms(spark, case):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((8000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if case == "outlier":
        vectors[17] *= 3
    elif case == "lognormal":
        vectors *= rng.lognormal(0, 0.5, (8000, 1))
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(8000), "embedding": list(vectors)}), "vec_id long, embedding array<double>")
    asked = lambda vec_id: vec_id % 200 == 0
    got = {(r.query_id, r.vec_id) for r in nearest(rows, asked).collect()}
    best = {(q, v) for q, _, v, _ in exact(np.arange(8000), vectors, 20) if q % 200 == 0}
    assert len(got & best) / len(best) >= 0.9


def test_windows_cover_the_kth_candidate():
    vectors = np.random.default_rng(4).standard_normal((2000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index = CollisionIndex(vectors, 1.0, Search(spare=1, enough=0.0))
    hits = [len(set(np.argsort(-(vectors @ q))[:21]) & set(found)) for q, found in zip(vectors[:50], index.candidates(vectors[:50]), strict=True)]
    assert sum(hits) / (21 * 50) >= 0.75
