import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.functions.nearest import SCORE_DIGITS, NearestVectors
from noteloom.operators.scoring import score_all


def brute(query, vectors, ids, k, inside):
    norms = np.sqrt((query * query).sum(axis=1)[:, None] * (vectors * vectors).sum(axis=1)[None, :])
    score = np.round(np.clip(np.divide(query @ vectors.T, norms, out=np.zeros(norms.shape), where=norms > 0), -1, 1), SCORE_DIGITS)
    rows = [sorted((-score[q, r], ids[r]) for r in np.flatnonzero(inside[q]))[:k] for q in range(len(query))]
    return [(q, i, -s) for q, best in enumerate(rows) for s, i in best]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_vectors_equal_brute_force(k):
    rng = np.random.default_rng(k)
    vectors = rng.standard_normal((9000, 6)) * np.exp(rng.normal(0, 20, (9000, 1)))
    vectors[100:400] = vectors[5] * 3.0  # ties go to the smaller id
    vectors[7], vectors[8000:8100] = 0.0, 0.0
    ids = rng.permutation(9000)
    query = np.concatenate([vectors[:60], np.zeros((1, 6))])
    inside = rng.random((61, 9000)) < rng.choice([0.001, 0.3, 1.0], (61, 1))
    best = NearestVectors(query, k)
    for a, b in ((0, 30), (30, 5000), (5000, 5000), (5000, 9000)):
        best.update(vectors[a:b], ids[a:b], allowed=lambda q, rows, a=a, b=b: inside[q][:, a:b][:, rows])
    got = [(int(q), int(i), float(s)) for q, i, s in zip(*best.rows(), strict=True)]
    assert got == [(q, int(i), float(s)) for q, i, s in brute(query, vectors, ids, k, inside)]


def test_few_pairs_are_computed_twice(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((40_000, 32))
    best, seen = NearestVectors(vectors[:50], 10), []
    merge = best.best.merge
    monkeypatch.setattr(best.best, "merge", lambda q, i, s: (seen.append(len(q)), merge(q, i, s)))
    best.update(vectors, np.arange(len(vectors)))
    assert sum(seen) < 50 * 10 * 12


def test_a_chunk_is_sent_to_few_slices(spark):
    def kernel(questions, batches):
        yield [0], [sum(b.num_rows for b in batches)], [0.0]

    asked = spark.range(1600).withColumnRenamed("id", "question_id")
    chunks = spark.range(1000).withColumnRenamed("id", "chunk_id")
    sent = score_all(asked, chunks, kernel, max_questions=100, stripe_rows=200).agg(F.sum("chunk_id")).first()[0]
    assert sent == 1000  # one slice of 16 batches; a slice a batch sent every chunk 16 times
