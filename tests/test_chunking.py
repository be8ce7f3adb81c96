import random

import pytest

from noteloom.functions import markup as M
from noteloom.operators import chunking as C


def chunks_of(spark, texts, **options):
    """Chunks per text, as (content, start, end)."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    split = C.split_documents(docs, **options)
    out = {i: [] for i in range(len(texts))}
    for r in C.chunk_rows(split).orderBy("doc_id", "chunk_index").collect():
        out[r.doc_id].append((r.content, r.char_start, r.char_end))
    rejects = [(r.doc_id, r.char_start, r.char_end) for r in C.reject_rows(split).collect()]
    return out, rejects


def assert_covers(text, chunks):
    end, last_start = 0, -1
    for content, a, b in chunks:
        assert content == text[a:b]
        assert last_start < a <= end < b
        end, last_start = b, a
    assert end == len(text)


PIECES = [
    "# Title\n", "## Part two\r\n", "\n", "\r\n\r\n", "A plain sentence stands here. ", "它说明了这一点。", "Is it 3.14 or not? ",
    "He said \"wait. now\" and left. ", "（括号里。还有）后面。", "- item one\n", "2) item two\n  continued\n",
    "```py\n# not a heading\nx = 1.\n```\n", "$$\na = b.\n$$\n", "a | b\n---|---\n1 | 2. x\n\n", "see [link. text](http://x.y/z. w) ok. ",
    "`code. inside` then more. ", "😀 emoji! ", "tail without stop ", "\\[\nq.\n\\]\n", "~~~\nopen fence. forever\n",
]


def random_text(seed):
    r = random.Random(seed)
    return "".join(r.choice(PIECES) for _ in range(r.randint(1, 60)))


def test_random_documents_are_covered_exactly(spark):
    texts = [random_text(i) for i in range(60)]
    for target, overlap in ((40, 0), (120, 30), (800, 80)):
        found, rejects = chunks_of(spark, texts, target=target, overlap=overlap, limit=5000)
        assert not rejects
        for i, text in enumerate(texts):
            if text.strip():
                assert_covers(text, found[i])
            else:
                assert not found[i]


def test_protected_runs_and_sentences_are_never_cut(spark):
    texts = [random_text(1000 + i) for i in range(30)]
    found, _ = chunks_of(spark, texts, target=50, overlap=10, limit=5000)
    for i, text in enumerate(texts):
        guard = M.Guard(text)
        for _, a, _ in found[i]:
            assert a == 0 or not guard.splits(a) or any(s == a for s, _ in M.section_spans(text, guard))


def test_sections_and_leading_blank(spark):
    text = "\n\n# One\nbody\n# Two\nmore"
    found, _ = chunks_of(spark, [text])
    assert [c[1:] for c in found[0]] == [(0, 13), (13, len(text))]


def test_heading_is_glued_to_a_long_next_unit(spark):
    text = "# Head\n" + "字" * 100
    found, _ = chunks_of(spark, [text], target=60, overlap=0, limit=200)
    assert [c[1:] for c in found[0]] == [(0, len(text))]


def test_overlap_repeats_one_whole_sentence(spark):
    first, second, third = "甲" * 30 + "。", "乙" * 10 + "。", "丙" * 30 + "。"
    text = first + second + third
    found, _ = chunks_of(spark, [text], target=45, overlap=15, limit=100)
    assert [c[1:] for c in found[0]] == [(0, 42), (31, 73)]
    found, _ = chunks_of(spark, [text], target=45, overlap=10, limit=100)
    assert [c[1:] for c in found[0]] == [(0, 42), (42, 73)]


def test_soft_newline_and_unclosed_bracket_hold_a_sentence(spark):
    soft = "甲" * 150 + "\n" + "乙" * 300
    open_bracket = "（" + "句子。" * 60
    found, _ = chunks_of(spark, [soft, open_bracket], target=100, overlap=0, limit=1000)
    assert len(found[0]) == 1 and len(found[1]) == 1


def test_oversized_unit_rejects_the_document(spark):
    text = "短句。\n\n" + "长" * 50
    found, rejects = chunks_of(spark, [text], target=20, overlap=0, limit=30)
    assert not found[0] and rejects == [(0, 5, 55)]
    kept, rejects = chunks_of(spark, [text], target=20, overlap=0, limit=30, on_oversize="keep")
    assert not rejects
    assert_covers(text, kept[0])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("One stops here. Two goes on! Three?", ["One stops here. ", "Two goes on! ", "Three?"]),
        ("Value is 3.14 exact. Done.", ["Value is 3.14 exact. ", "Done."]),
        ("See http://a.b/c. Still here. End", ["See http://a.b/c. Still here. ", "End"]),
        ("“你好。”他说。再见", ["“你好。”", "他说。", "再见"]),
        ("Use e.g. this form. Next", ["Use e.g. this form. ", "Next"]),
        ("no stop, only; commas\nand lines", ["no stop, only; commas\nand lines"]),
    ],
)
def test_sentences(text, expected):
    units = M.sentence_units(text, 0, len(text), M.Guard(text))
    assert [text[u.start : u.end] for u in units] == expected


def test_prose_bars_are_not_a_table():
    text = "where |a|<b holds\nand more"
    assert not M.Guard(text).flags.any()


def test_given_spans_stay_whole_and_bad_ones_fail(spark):
    text = "开头" * 8 + "![说明。说明。](a.png)" + "结尾。" * 20
    start = text.index("![")
    docs = spark.createDataFrame([(1, text, [(start, start + 14)])], "doc_id bigint, text string, keep array<struct<start:bigint,end:bigint>>")
    rows = C.chunk_rows(C.split_documents(docs, 30, 5, 1600, protected="keep")).collect()
    assert not any(start < r.char_start < start + 14 for r in rows)
    with pytest.raises(ValueError):
        M.check_spans("abc", [(0, 2), (1, 3)])
    with pytest.raises(ValueError):
        C.split_documents(docs, 0, 0, 10)
    with pytest.raises(ValueError):
        C.split_documents(docs, 10, 10, 10)


def test_sql_function(spark):
    C.register_functions(spark)
    row = spark.sql("SELECT note_units('# A\nbody one.') AS u, casefold('STRASSE ß') AS c, nfkc_squash('ａ b') AS s").first()
    assert len(row.u) == 2 and row.c == "strasse ss" and row.s == "ab"
