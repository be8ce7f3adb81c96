import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import evaluation as E, gate as G, graph as GR

ITEM = "question_id bigint, library string, difficulty string, in_kb boolean, expected_doc string, expected_keywords array<string>, question string"
CAND = "question_id bigint, rank bigint, doc_title string, content string, vector_similarity double"


def test_gate_edges(spark):
    q = spark.createDataFrame([(i,) for i in range(10)], "question_id bigint")
    c = spark.createDataFrame(
        [(1, 0.449999), (2, 0.45), (3, 0.549999), (4, 0.55), (5, None), (6, float("nan")), (7, float("inf")), (8, 1.01), (9, -1.01), (9, 0.6)],
        "question_id bigint, vector_similarity double",
    )
    bands = {r.question_id: r.band for r in G.gate(G.similarity_samples(q, c)).collect()}
    assert bands == {
        0: "insufficient", 1: "insufficient", 2: "borderline", 3: "borderline", 4: "sufficient", 5: "borderline",
        6: "borderline", 7: "borderline", 8: "borderline", 9: "sufficient",
    }


@pytest.mark.parametrize("pair", [(0.5, 0.5), (0.6, 0.5), (float("nan"), 0.5), (0.1, float("inf")), (True, 2.0), (0.1, False)])
def test_bad_thresholds(spark, pair):
    with pytest.raises(ValueError):
        G.gate(spark.range(1), *pair)


def test_retrieval_metrics_count_misses(spark):
    items = spark.createDataFrame(
        [(1, "alpha", "basic", True, "A.md", ["Straße"], "a"), (2, "alpha", "hard", True, "B.md", ["key"], "b"),
         (3, "beta", "basic", True, "c.md", ["key"], "c"), (4, "beta", "basic", False, None, [], "d")], ITEM)
    cands = spark.createDataFrame(
        [(1, 1, "x.md", "STRASSE", 0.5), (1, 2, "a.MD", "die STRASSE", 0.5), (2, 1, "B.md", "nothing", 0.5), (3, 1, "C.md", "KEY", 0.5)], CAND)
    m = {(r.level, r.grp): r for r in E.retrieval_metrics(E.first_hit_ranks(items, cands)).collect()}
    assert (m["overall", "all"].total, m["overall", "all"].hits) == (3, 2)
    assert m["overall", "all"].recall_at_k == pytest.approx(2 / 3) and m["overall", "all"].mrr == pytest.approx(0.5)
    assert m["library", "alpha"].recall_at_k == 0.5 and m["library", "alpha"].mrr == 0.25
    assert m["difficulty", "hard"].mrr == 0.0 and len(m) == 5


def test_refusal_rates_and_sweep(spark):
    out = spark.createDataFrame(
        [("l", "basic", True, "answered", None), ("l", "basic", True, "needs_review", "borderline_relevance"),
         ("l", "hard", True, "unverified", "no_citation"), ("l", "hard", False, "insufficient", "low_relevance")],
        "library string, difficulty string, in_kb boolean, status string, reason string")
    r = E.refusal_metrics(out).filter("level = 'overall'").first()
    assert (r.in_kb_answer_rate, r.in_kb_review_rate, r.in_kb_hard_refusal_rate) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    assert (r.out_of_kb_answer_rate, r.out_of_kb_hard_refusal_rate) == (0.0, 1.0)
    counts = {x.kind: x.counts for x in E.outcome_counts(out).filter("level = 'overall'").collect()}
    assert counts["in_kb"] == {"answered": 1, "needs_review": 1, "unverified": 1}
    assert counts["reason"] == {"borderline_relevance": 1, "no_citation": 1, "low_relevance": 1}
    assert len(E.threshold_grid()) == 11
    samples = spark.createDataFrame([("l", "basic", True, 8, 0.52), ("l", "basic", False, 0, None)],
                                    "library string, difficulty string, in_kb boolean, candidate_count bigint, max_vector_similarity double")
    sweep = {(x.refuse_below, x.answer_from): x for x in E.threshold_sweep(samples).filter("level = 'overall'").collect()}
    assert len(sweep) == 11 and sweep[0.45, 0.5].in_kb_answer_rate == 1.0 and sweep[0.45, 0.55].in_kb_review_rate == 1.0
    assert sweep[0.45, 0.55].out_of_kb_hard_refusal_rate == 1.0


def report(spark, **values):
    base = {"recall_at_k": 1.0, "mrr": 0.9, "out_of_kb_answer_rate": 0.1, "in_kb_hard_refusal_rate": 0.1, "group_mrr": 0.9, **values}
    rows = [("overall", "all", k, float(v)) for k, v in base.items() if k != "group_mrr"]
    return spark.createDataFrame([*rows, ("library", "a", "mrr", float(base["group_mrr"]))], "level string, grp string, metric string, value double")


@pytest.mark.parametrize(
    "change, verdict",
    [({}, None), ({"mrr": 0.89}, None), ({"mrr": 0.889}, "mrr_drop"), ({"recall_at_k": 0.999}, "recall_drop"),
     ({"out_of_kb_answer_rate": 0.11}, "out_of_kb_answers_rise"), ({"in_kb_hard_refusal_rate": 0.2}, "hard_refusals_rise"),
     ({"group_mrr": 0.85}, None), ({"group_mrr": 0.84}, "mrr_drop"), ({"mrr": 1.2}, "invalid_value")],
)
def test_regression_gate(spark, change, verdict):
    bad = [r.verdict for r in E.regression_gate(report(spark), report(spark, **change)).collect() if r.verdict != "ok"]
    assert bad == ([verdict] if verdict else [])


def test_gate_needs_the_same_groups_and_headers(spark):
    smaller = report(spark).filter("level = 'overall'")
    assert [r.verdict for r in E.regression_gate(report(spark), smaller).collect()].count("group_mismatch") == 1
    with pytest.raises(ValueError):
        E.regression_gate(smaller, smaller, -0.1)
    head = lambda v: spark.createDataFrame([(f, "1") for f in E.S.COMPARABLE_FIELDS[1:]] + [("schema_version", v)], "field string, value string")
    assert E.comparability(head("1"), head("1")).count() == 0
    assert [tuple(r)[0] for r in E.comparability(head("1"), head("2")).collect()] == ["schema_version"]


def test_manifest_problems(spark):
    libs = spark.createDataFrame([("a",), ("b",)], "key string")
    items = spark.createDataFrame(
        [(1, "a", "basic", True, "One.md", ["alpha"], "q1"), (2, "a", "basic", False, None, [], "q2"), (3, "a", "odd", True, "ONE.md", ["gone"], "Q1"),
         (4, "zz", "basic", True, "none.md", ["k"], "q4"), (5, "a", "basic", False, "x", [], "q5"), (6, "a", "basic", True, None, [], "q6")], ITEM)
    docs = spark.createDataFrame([("a", "one.md", "ALPHA beta"), ("a", "two.md", "x"), ("a", "TWO.md", "y")], "library string, title string, text string")
    codes = sorted(r.code for r in E.manifest_problems(libs, items, docs).collect())
    assert codes == sorted(["unknown_library", "unknown_difficulty", "label_missing", "label_unexpected", "document_missing", "keyword_missing",
                            "document_not_covered", "document_not_covered", "one_sided_library", "duplicate_question", "duplicate_title"])
    assert {r.code for r in E.scale_problems(libs, items).collect()} == {"items", "libraries", "difficulties"}


def pool_counts(spark, sizes, limit):
    rows, n = [], 0
    for doc, size in enumerate(sizes, 1):
        for i in range(size):
            rows.append((n, doc, 1, i * 3, [1.0, float(n % 5)]))
            n += 1
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, kb_id bigint, chunk_index bigint, embedding array<double>")
    return chunks, tuple(r.n for r in GR.chunk_pool(chunks, limit).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect())


def test_pool_takes_turns(spark):
    assert pool_counts(spark, (410, 2, 1), 400)[1] == (397, 2, 1)
    assert pool_counts(spark, (8, 3, 2), 5)[1] == (2, 2, 1)
    assert pool_counts(spark, (3, 3, 3), 2)[1] == (1, 1)
    with pytest.raises(ValueError):
        GR.chunk_pool(spark.range(1), 0)


@pytest.mark.parametrize("sizes, flag", [((), None), ((401,), True), ((200, 201), True), ((200, 200), False)])
def test_truncation_flag(spark, sizes, flag):
    docs = spark.createDataFrame([(i + 1, 1, f"d{i}", 10) for i in range(len(sizes))] or [], "doc_id bigint, kb_id bigint, title string, char_count bigint")
    chunks, _ = pool_counts(spark, sizes, 400)
    for limit, want in ((400, flag), (401, flag and False), (None, flag and False)):
        rows = GR.graph_nodes(docs, chunks, limit).collect()
        assert {r.truncated for r in rows} == (set() if flag is None else {want})


def test_pairs_do_not_depend_on_the_blocks(spark):
    rng = random.Random(2)
    rows = [(i, i // 3, i % 2, i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, kb_id bigint, chunk_index bigint, embedding array<double>")
    whole = sorted(map(tuple, GR.graph_pairs(chunks, 3, 0.2).collect()))
    assert whole and whole == sorted(map(tuple, GR.graph_pairs(chunks, 3, 0.2, block_rows=7).collect()))


def test_edges(spark):
    v = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0], 4: [1.0, 0.05]}
    rows = [(c, d, 1, i, v[c]) for c, d, i in ((1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 1, 1))] + [(9, 9, 2, 0, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, kb_id bigint, chunk_index bigint, embedding array<double>")
    docs = spark.createDataFrame([(d, 1 if d < 9 else 2, f"d{d}", 5) for d in (1, 2, 3, 9)], "doc_id bigint, kb_id bigint, title string, char_count bigint")
    nodes, edges = GR.build_graph(docs, chunks, top_k=1, min_similarity=0.5)
    found = edges.collect()
    assert [(e.kb_id, e.source, e.target, e.links, e.weight) for e in found] == [(1, 1, 2, 3, 1.0)]
    assert nodes.count() == 4
    falling = GR.edge_counts(chunks, (0.1, 0.5, 0.9999)).filter("kb_id = 1").orderBy("threshold").collect()
    assert [(r.edges, r.strictly_fewer) for r in falling] == [(2, True), (1, True), (0, True)]


def test_first_document_with_short_and_long_passages(spark):
    from noteloom.operators.labels import first_document_with

    words = [f"w{i}" for i in range(40)]
    docs = [(5, "x " + " ".join(words[:20])), (3, "pre" + " ".join(words[:20]) + "post"), (9, " ".join(words[20:])), (1, "a\tb c")]
    asked = [(1, " ".join(words[:20])), (2, " ".join(words[21:30])), (3, "b c"), (4, "not there at all in any of these texts"), (5, " ".join(words[20:28]) + "x")]
    found = first_document_with(
        spark.createDataFrame(asked, "question_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.question_id: r.doc_id for r in found.collect()} == {1: 3, 2: 9, 3: 1}
