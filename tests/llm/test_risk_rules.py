import math
import random
import re
from collections import Counter

import pytest

from noteloom.llm import risk_rules
from noteloom.llm.risk_rules import BASE_COLUMNS, Risk, apply_rules, binomial_below, choose_cutoff, keep_documents, measure


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if found[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("bits", [21, 4])
def test_statistics_against_plain_counts(spark, monkeypatch, bits):
    """With few place bits, long lists and collisions take the way that compares words."""
    monkeypatch.setattr(risk_rules, "_POSITION_BITS", bits)
    rng = random.Random(3)
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", " \t a\x0bb\x0c c d \n a"]
    texts += ["".join(rng.choice(["a", "b", "ab", "c", " ", " ", "\n", "|", "\x85"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in measure(df, stratum_col=None).select("doc_id", *BASE_COLUMNS).collect():
        assert tuple(r)[1:] == plain(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_tail_against_the_sum():
    for n, k, p in ((10, 2, 0.3), (200, 0, 0.02), (500, 4, 0.02)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert binomial_below(k, n, p) == pytest.approx(exact, rel=1e-10)
    assert binomial_below(10, 10, 0.5) == 1.0


def test_cutoff_is_certified_or_absent():
    counts = [(100, 30, 50), (200, 0, 50), (300, 0, 50), (400, 0, 10)]
    assert choose_cutoff(counts, 2000, 60, 0.01, 1e-3) == 300  # as good as 200, and looser
    assert choose_cutoff(counts, 300, 60, 0.01, 1e-3) is None  # too few good ones to prove anything
    assert choose_cutoff([(100, 0, 0)], 5000, 60, 0.01, 1e-3) is None


def test_verdicts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {i}", "en") for i in range(900)] + [(1000 + i, f"{words} {i} " + "%$#" * 60, "en") for i in range(40)]
    rows += [(5000, None, None), (5001, "", "en"), (5002, f"{words} " + "%$#" * 60, "xx"), (0, f"{words} 0", "en")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    labels = spark.createDataFrame(
        [(r[0], int(r[0] < 1000)) for r in rows[:-4]] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    risk = Risk(share=0.08)
    got = {r.doc_id: (r.base_failed, r.kept) for r in apply_rules(docs, labels, risk).collect()}
    assert got[5000] == got[5001] == (True, False)
    assert all(got[i] == (False, True) for i in range(900)) and all(got[1000 + i] == (False, False) for i in range(40))
    assert got[5002] == (False, True)  # a stratum without labels has no cutoffs
    assert apply_rules(docs, labels, risk).count() == len(rows)
    kept = keep_documents(docs, labels, risk)
    assert kept.columns == docs.columns and kept.count() == 900 + 1 + 1
    assert keep_documents(docs, labels.limit(0), risk).count() == len(rows) - 2
    assert apply_rules(docs.limit(0), labels, risk).count() == 0


def test_repeated_labels_and_rows_prove_nothing_more(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {i}", "en") for i in range(90)] + [(1000 + i, f"{words} {i} " + "%$#" * 60, "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows], "doc_id long, quality int")
    many = spark.range(30).select()
    measured = measure(docs)
    once = risk_rules.fit_cutoffs(measured, labels, Risk(share=0.08))
    assert risk_rules.fit_cutoffs(measured, labels.crossJoin(many), Risk(share=0.08)) == once
    assert risk_rules.fit_cutoffs(measured.crossJoin(many), labels, Risk(share=0.08)) == once
    assert not any(c for cutoffs in once.values() for c in cutoffs.values())
