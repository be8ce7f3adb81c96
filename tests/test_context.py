import pytest

from noteloom.operators import context as X

CHUNK = "chunk_id bigint, doc_id bigint, kb_id bigint, content string, char_start bigint, char_end bigint"


def expand(spark, text, cuts, anchors, **options):
    """Expand anchors over one document cut at the given offsets; chunk ids count from 1."""
    edges = [0, *cuts, len(text)]
    rows = [(i, 1, 1, text[a:b], a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]), 1)]
    return expand_rows(spark, text, rows, anchors, **options)


def expand_rows(spark, text, rows, anchors, **options):
    chunks = spark.createDataFrame(rows, CHUNK)
    docs = spark.createDataFrame([(1, 1, len(text))], "doc_id bigint, kb_id bigint, char_count bigint")
    ask = spark.createDataFrame([(1, r, c) for r, c in enumerate(anchors, 1)], "question_id bigint, rank bigint, chunk_id bigint")
    out = X.expand_evidence(ask, chunks, docs, **options).orderBy("place").collect()
    return [r.problem for r in out if r.problem] or [(r.chunk_id, r.is_anchor, list(r.context_chunk_ids)) for r in out]


TEXT = "事务必须保持一致。它要求隔离。后面另起一句。"


def test_pronoun_pulls_its_predecessor(spark):
    assert expand(spark, TEXT, (9, 15), [2], neighbour_units=0) == [(2, True, [1]), (1, False, [2])]


def test_following_dependent_sentence_is_required(spark):
    assert expand(spark, TEXT, (9, 15), [1], neighbour_units=0) == [(1, True, [2]), (2, False, [1])]


def test_neighbours_are_added_but_not_required(spark):
    text = "第一句在此。第二句在此。第三句在此。"
    assert expand(spark, text, (6, 12), [2]) == [(2, True, []), (1, False, []), (3, False, [])]
    assert expand(spark, text, (6, 12), [2], neighbour_units=0) == [(2, True, [])]


def test_cut_inside_a_sentence_is_healed(spark):
    text = "这个结论不是总是成立的。完全独立的句子。"
    found = expand(spark, "结论并不是总是成立。独立句子在此。", (4,), [2], neighbour_units=0)
    assert found == [(2, True, [1]), (1, False, [2])]
    assert expand(spark, text, (4,), [1], neighbour_units=0) == ["dependency_missing"]


def test_dependency_does_not_cross_a_heading(spark):
    text = "前一节内容。\n\n# 标题\n它缺少主语。"
    assert expand(spark, text, (8, 13), [3], neighbour_units=0) == ["dependency_missing"]


def test_gaps_conflicts_and_budgets(spark):
    text = "第一句在此。第二句在此。第三句在此。"
    rows = [(1, 1, 1, text[0:6], 0, 6), (3, 1, 1, text[12:], 12, 18)]
    assert expand_rows(spark, text, rows, [1]) == ["gap"]
    rows = [(1, 1, 1, text[0:8], 0, 8), (2, 1, 1, "错误" + text[8:], 6, 18)]
    assert expand_rows(spark, text, rows, [1]) == ["conflict"]
    assert expand_rows(spark, text + "多", [(1, 1, 1, text, 0, 18)], [1]) == ["length_mismatch"]
    assert expand(spark, text, (6, 12), [2], neighbour_chars=11) == ["neighbour_budget"]
    assert expand(spark, text, (6, 12), [2], max_chars=17) == ["total_budget"]
    assert expand(spark, text, (6, 12), [9]) == ["anchor_missing"]
    assert expand(spark, "# 甲\n句子。\n# 乙\n句子。", (2,), [2]) == ["crosses_sections"]


def test_chosen_tiles_come_first_then_the_longest(spark):
    text = "第一句在此。第二句在此。第三句在此。"
    rows = [(1, 1, 1, text[0:6], 0, 6), (2, 1, 1, text[6:12], 6, 12), (3, 1, 1, text[6:18], 6, 18), (4, 1, 1, text[12:18], 12, 18)]
    assert expand_rows(spark, text, rows, [1, 2]) == [(1, True, []), (2, True, [3]), (3, False, [2])]
    found = expand_rows(spark, text, rows, [1])
    assert found == [(1, True, []), (3, False, [])]


def test_islands(spark):
    flags = [(False, False), (False, True), (True, False), (False, True), (False, False), (False, True), (False, True)]
    units = spark.createDataFrame([(1, 0, i, h, d) for i, (h, d) in enumerate(flags)], "doc_id int, section int, unit bigint, heading boolean, dependent boolean")
    rows = [(r.head, r.tail, r.headless) for r in X.dependency_islands(units).orderBy("unit").collect()]
    assert rows == [(0, 1, False), (0, 1, False), (2, 3, False), (3, 3, True), (4, 6, False), (4, 6, False), (4, 6, False)]


def test_source_context(spark):
    rows = [(1, 1, 11, 5, "b.md", " two ", 10, 15, [12]), (1, 2, 12, 5, "b.md", "one", 0, 3, [11]), (2, 1, 13, 7, "c.md", "x", 0, 1, [])]
    df = spark.createDataFrame(rows, "question_id bigint, number bigint, chunk_id bigint, doc_id bigint, doc_title string, content string, char_start bigint, char_end bigint, context_chunk_ids array<bigint>")
    out = {r.question_id: r for r in X.source_context(df, 70).collect()}
    assert out[2].context == "[1] 文档名称：c.md\n原文字符位置：0–1\n原文：\nx" and out[2].fits
    assert out[1].context.startswith("[2] ") and "须结合上下文来源：[1]；" in out[1].context and out[1].context.endswith("\ntwo")
    assert not out[1].fits
    assert pytest.approx(out[1].length) == len(out[1].context)
