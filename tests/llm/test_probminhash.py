import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from noteloom.llm.probminhash import (
    Settings, cell_pairs, drop_near_duplicates, may_reach, near_duplicates, parity_sketches, rare_pairs, rare_shingles, signatures,
    similarities, sketches_may_reach, text_bands, text_shingles, weighted_shingles)


def shingles(text, width=5):
    words = (text or "").lower().split()
    if not words:
        return {}
    found = Counter(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))
    return {k: 1 + math.log(v) for k, v in found.items()}


def similarity(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    out = ["", "  ", None, "a b", "A b", "a  b", "a b c d e", *(" ".join(["x"] * n) for n in (5, 9, 50))]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 3) if copy else 0):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy + copy[:10] * rng.choice([0, 0, 0, 2, 5])))
    return out


def test_similarities_and_signatures(texts):
    sets = [shingles(t) for t in texts]
    rng = random.Random(5)
    left = [rng.randrange(len(texts)) for _ in range(1500)]
    right = [min(len(texts) - 1, i // 5 * 5 + rng.randrange(5)) for i in left]
    exact = np.array([similarity(sets[i], sets[j]) for i, j in zip(left, right, strict=True)])
    got = similarities(pa.array([texts[i] for i in left]), pa.array([texts[j] for j in right]), 5)
    assert np.abs(got - exact).max() < 1e-12
    doc, value, weight = weighted_shingles(pa.array(texts), 5)
    assert [int((doc == i).sum()) for i in range(len(texts))] == [len(s) for s in sets]
    registers = 512
    signed = signatures(doc, value, weight, len(texts), registers)
    share = np.array([(signed[i] == signed[j]).mean() for i, j in zip(left, right, strict=True)])
    some = (exact > 0) & (np.array(left) != np.array(right))
    error = (share - exact)[some]
    assert abs(error.mean()) < 0.01 and np.sqrt((error**2).mean()) < 1.3 * np.sqrt((exact * (1 - exact) / registers)[some].mean())


def test_classes_against_brute_force(spark, texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or similarity(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = [*enumerate(texts), (3, texts[3]), (None, "z")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, class_id string")
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == {i: root(i) for i in range(len(texts))} | {None: None}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({root(i) for i in range(len(texts))})
    assert kept.where("doc_id is null").count() == 1
    assert near_duplicates(docs.limit(0)).count() == 0


def crowd(rng, count, pairs):
    """Texts of 0.75 to 0.79 with each other, and ``pairs`` planted pairs of more than 0.8."""
    shared = [f"c{i}" for i in range(180)]
    tail = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    out = [shared + tail(25 + i % 3) for i in range(count)]
    near = rng.sample(range(count), 2 * pairs)
    for i, j in zip(near[::2], near[1::2], strict=True):
        out[j] = out[i][:-6] + tail(6)
    return [" ".join(t) for t in out], {tuple(sorted(p)) for p in zip(near[::2], near[1::2], strict=True)}


@pytest.mark.parametrize("block_rows", [512, 40])
def test_crowded_bucket_against_brute_force(spark, block_rows):
    texts, planted = crowd(random.Random(6), 240, 40)
    i, j = np.triu_indices(len(texts), 1)
    value = similarities(pa.array([texts[x] for x in i]), pa.array([texts[x] for x in j]), 5)
    near = {(a, b) for a, b, v in zip(i.tolist(), j.tolist(), value.tolist(), strict=True) if v >= 0.8}
    assert near == planted and 0.75 <= value[value < 0.8].min() and np.quantile(value, 0.9) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs, Settings(block_rows=block_rows)).collect()}
    assert got == {x: x for x in range(len(texts))} | {b: a for a, b in planted}


def test_rare_shingles_bring_similar_texts_together(spark, texts):
    """Every pair that reaches the threshold shares a rare shingle that is short for one of the two."""
    crowded, _ = crowd(random.Random(8), 60, 12)
    some = [t for t in [*texts, *crowded] if t and t.split()]
    rows = rare_shingles(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), Settings()).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, {})[r.shingle] = r.short
    i, j = np.triu_indices(len(some), 1)
    exact = similarities(pa.array([some[x] for x in i]), pa.array([some[x] for x in j]), 5)
    near = [(a, b) for a, b, v in zip(i.tolist(), j.tolist(), exact.tolist(), strict=True) if v >= 0.8 and some[a] != some[b]]
    assert len(near) >= 12
    for a, b in near:
        x, y = of[a], of[b]
        assert any(x[s] or y[s] for s in x.keys() & y.keys()), (a, b)
    met = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a >= len(some) - 60
           and any(of[a][s] or of[b][s] for s in of.get(a, {}).keys() & of.get(b, {}).keys())}
    assert len(met) < 60 * 59 / 8  # the passage that all of the crowd share brings few of them together


def test_size_bound_is_above_the_similarity(spark, texts):
    some = [t for t in texts if t and t.split()]
    bands = text_bands(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), Settings())
    one = bands.select(F.struct("many", "total", "top").alias("x"), F.col("doc_id").alias("a"))
    two = one.withColumnsRenamed({"x": "y", "a": "b"})
    got = one.join(two, F.col("a") < F.col("b")).select("a", "b", may_reach(F.col("x"), F.col("y"), Settings()).alias("may")).collect()
    exact = similarities(pa.array([some[r.a] for r in got]), pa.array([some[r.b] for r in got]), 5)
    assert all(r.may for r, v in zip(got, exact.tolist(), strict=True) if v >= 0.8) and not all(r.may for r in got)


def test_cell_pairs():
    rng = np.random.default_rng(3)
    ids = np.arange(40)
    classes, short = rng.integers(0, 5, 40), rng.random(40) < 0.5
    for block in (ids * 0, ids % 2):
        got = {tuple(sorted(p)) for p in cell_pairs(ids, classes, short, block).tolist()}
        assert got == {(i, j) for i in range(40) for j in range(i + 1, 40)
                       if classes[i] != classes[j] and (short[i] or short[j]) and (block.max() == 0 or block[i] != block[j])}


def edited_copies(rng, count, edits, plants):
    """Copies of one text, each with its own edits, and ``plants`` pairs that differ in one word."""
    base = [f"b{i}" for i in range(200)]
    out = [[w if rng.random() > edits / 200 else f"e{rng.getrandbits(60)}" for w in base] for _ in range(count)]
    near = [(2 * i, 2 * i + 1) for i in range(plants)]
    for i, j in near:
        out[j] = [*out[i][:-1], "other"]
    return [" ".join(t) for t in out], set(near)


def test_sketches_refuse_no_similar_pair(texts):
    edited, _ = edited_copies(random.Random(9), 60, 4, 10)
    some = [t for t in [*texts, *edited, " ".join(str(i % 900) for i in range(9000))] if t and t.split()]
    doc, value, weight = weighted_shingles(pa.array(some), 5)
    many, total = np.bincount(doc), np.bincount(doc, weights=weight)
    i, j = np.triu_indices(len(some), 1)
    exact = similarities(pa.array([some[x] for x in i]), pa.array([some[x] for x in j]), 5)
    for t in (0.8, 0.5, 0.95):
        may = sketches_may_reach(parity_sketches(doc, value, len(some)), many, total, i, j, t)
        assert may[exact >= t - 1e-9].all() and may.mean() < 0.3
        once = (total == many)[i] & (total == many)[j] & (many[i] < 500) & (many[j] < 500)
        assert (exact[may & once] >= t - 0.1).all()  # a close bound where no shingle repeats and few share a bit


def test_near_copies_below_the_threshold_do_not_leave_their_cell(spark):
    """A crowd whose texts meet by rare shingles, but are not similar enough, makes no pairs to verify."""
    texts, planted = edited_copies(random.Random(10), 150, 6, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingled = text_shingles(docs, Settings()).cache()
    rare = rare_shingles(docs, Settings())
    members = docs.select("doc_id", F.col("doc_id").alias("class_id"))
    found = {(r.a, r.b) for r in rare_pairs(members, rare, shingled.select("doc_id", "many", "total", "sketch"), Settings(block_rows=40)).collect()}
    i, j = np.triu_indices(len(texts), 1)
    exact = similarities(pa.array([texts[x] for x in i]), pa.array([texts[x] for x in j]), 5)
    near = {(a, b) for a, b, v in zip(i.tolist(), j.tolist(), exact.tolist(), strict=True) if v >= 0.8}
    assert planted <= near <= found and len(found) < len(near) + 20
    of = {x: {} for x in range(len(texts))}
    for r in rare.collect():
        of[r.doc_id][r.shingle] = r.short
    met = sum(any(of[a][s] or of[b][s] for s in of[a].keys() & of[b].keys()) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert met > 2000
    want = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == dict(enumerate(want))
