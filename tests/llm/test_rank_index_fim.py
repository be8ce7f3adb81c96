import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from noteloom.llm.rank_index_fim import (
    MAX_ERROR, boundaries, boundary_offset, fill_in_middle, fill_in_middle_digests, fit, rank_indexes, restore, restored, transform)


def plain(doc_id, text, seed=7):
    """The same example by splitting the text into its lines."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def as_tuple(e):
    return e.n, e.form, e.prefix_chars, e.middle_chars, e.output


def random_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["a\n", "ab\n<", "<PSM>\n", "é😀\nx", "\n", "abcdefgh \n\r"])
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))


def test_examples_equal_those_of_split_lines_and_can_be_undone():
    forms = set()
    for i, text in enumerate(random_texts(20_000, 1)):
        made = transform(i, text)
        assert as_tuple(made) == plain(i, text), text
        assert restore(made.output, made.form) == text
        forms.add(made.form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("seed", range(6))
def test_index_is_exact_and_its_error_bounded(seed):
    rng = random.Random(seed)
    widths = [[1], [80], [1, 5000], range(1, 400), [3, 3, 3, 100_000], range(1, 30)][seed]
    offsets = [0]
    for _ in range(20_000):
        offsets.append(offsets[-1] + rng.choice(widths))
    index = fit(offsets)
    assert [index.offset(i) for i in range(len(offsets))] == offsets
    assert max(abs(index.predict(i) - o) for i, o in enumerate(offsets)) <= MAX_ERROR + 1
    assert index.residuals.dtype.itemsize == 1
    if len(set(widths)) == 1:
        assert len(index.ranks) == 1  # equal lines need one segment


def test_index_of_few_boundaries():
    assert [fit([0]).offset(0), fit([0, 9]).offset(1)] == [0, 9]
    assert boundaries("") == [0] and boundaries("\n") == [0, 1] and boundaries("a\n\nb") == [0, 2, 3, 4]


def test_forms_follow_their_shares():
    text = "a\nb\nc"
    assert {transform(i, text, spm_percent=0).form for i in range(200)} == {"psm"}
    assert {transform(i, text, spm_percent=100).form for i in range(200)} == {"spm"}
    assert {transform(i, text, fim_percent=0).form for i in range(200)} == {"plain"}
    share = sum(transform(i, text, fim_percent=30).form == "plain" for i in range(4000)) / 4000
    assert 0.66 < share < 0.74


def test_query_on_odd_rows(spark):
    long = "zeile mit wörtern 😀\n" * 200_000
    rows = [(1, "a\nb\nc", "x"), (1, "a\nb\nc", "y"), (2, None, "x"), (3, "", None), (None, "q\nr", "x"), (4, long, "x"), (5, "a<P>\nb", "x"),
            (6, "\n" * 1000, "x"), (7, "<S\n<P\n<M", "x"), (8, "no line feed", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    got = fill_in_middle(docs).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *plain(i, t or ""))) for i, t, _ in rows)
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_in_middle_digests(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digests == {(i, sha(plain(i, t or "")[4]), sha(t or "")) for i, t, _ in rows}
    again = {(r.doc_id, r.text) for r in restored(fill_in_middle(docs)).collect()}
    assert again == {(i, t or "") for i, t, _ in rows}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_stored_index_gives_every_boundary(spark):
    texts = [(i, t) for i, t in enumerate(random_texts(60, 5))] + [(100, ("x" * 300 + "\n") * 50 + "y\n" * 5000)]
    index = rank_indexes(spark.createDataFrame(texts, "doc_id long, text string"))
    ranks = index.select("doc_id", "segments", "residuals", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("rank"))
    found = {}
    for r in ranks.select("doc_id", "rank", boundary_offset(F.col("segments"), F.col("residuals"), F.col("rank")).alias("offset")).collect():
        found.setdefault(r.doc_id, {})[r.rank] = r.offset
    assert {i: [found[i][k] for k in sorted(found[i])] for i in found} == {i: boundaries(t) for i, t in texts}


def test_query_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fill_in_middle(docs).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id])
