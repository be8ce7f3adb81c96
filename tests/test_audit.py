import json
import re

from pyspark.sql import functions as F

from noteloom.operators import audit as A, maintenance as M, sessions as SE
from noteloom.streaming.tasks import advance

CITE = "array<struct<index:bigint,chunk_id:bigint,chunk_text:string,context_chunk_ids:array<bigint>>>"


def test_closure_follows_chains(spark):
    cites = [(1, 11, "", [12]), (2, 12, "", [13]), (3, 13, "", []), (4, 14, "", [])]
    df = spark.createDataFrame([(1, "x [1]", 4, cites), (2, "x [4][4]", 4, cites), (3, "x", 4, cites)], f"answer_id bigint, content string, provided_count bigint, citations {CITE}")
    rows = {r.answer_id: (r.reason, r.status, r.cited) for r in A.audit_answers(df).collect()}
    assert rows == {1: (None, "answered", [1, 2, 3]), 2: (None, "answered", [4]), 3: ("no_citation", "unverified", None)}


def judge(*judgments):
    return json.dumps({"judgments": list(judgments)})


def j(unit, verdict="supported", *evidence):
    return {"unit_id": unit, "verdict": verdict, "evidence": [{"source_index": i, "quote": q} for i, q in evidence]}


def test_support_audit(spark):
    cites = [(1, 11, "第一条 原文内容在这里说明。", [12]), (2, 12, "补充的上下文内容说明。", []), (3, 13, "短文", [])]
    content = "结论甲。[1]\n\n---\n结论乙。[3]"
    ok1, ok3 = (1, "原文内容在这里"), (3, "短 文")
    def more(where):
        """A sound judgement with a field too many."""
        sound = json.loads(judge(j(1, "supported", (1, "第一条原文内容在这里")), j(2), j(3, "supported", ok3)))
        (sound["judgments"][0] if where == "judgments" else sound["judgments"][2]["evidence"][0])["note"] = "x"
        return json.dumps(sound)

    cases = [
        (judge(j(1, "supported", (1, "第一条原文内容在这里")), j(2), j(3, "supported", ok3)), None, True),
        (judge(j(1, "supported", (2, "补充的上下文内容")), j(2), j(3, "unsupported")), None, False),
        ("no json", "not_json", None),
        (more("judgments"), "bad_fields", None),
        (more("evidence"), "bad_fields", None),
        (json.dumps({"judgments": [], "more": 1}), "bad_fields", None),
        (judge(j(1, "supported", (1, "第一条原文内容在这里"))), "not_covered", None),
        (judge(j(1, "unsupported"), j(1, "unsupported"), j(3, "unsupported")), "bad_unit", None),
        (judge(j(1, "maybe"), j(2), j(3, "unsupported")), "bad_verdict", None),
        (judge(j(1, "supported"), j(2), j(3, "unsupported")), "evidence_missing", None),
        (judge(j(1, "supported", ok3), j(2), j(3, "unsupported")), "foreign_source", None),
        (judge(j(1, "supported", ok1), j(2), j(3, "unsupported")), "bad_quote", None),
        (judge(j(1, "supported", (1, "没有这样一句原文内容")), j(2), j(3, "unsupported")), "bad_quote", None),
    ]
    df = spark.createDataFrame([(i, content, c[0], cites) for i, c in enumerate(cases)], f"answer_id bigint, content string, judgement string, citations {CITE}")
    rows = {r.answer_id: (r.problem, r.supported) for r in A.support_audit(df).collect()}
    assert rows == {i: c[1:] for i, c in enumerate(cases)}


def test_selection_audit(spark):
    cites = [(1, 11, "函数极限的定义如下所述，完整给出。", []), (2, 12, "判别依据写在这里，供核对使用。", [11])]
    pick = lambda *m: json.dumps({"source_matches": [{"source_index": i, "subject": s, "quote": q} for i, s, q in m]})
    cases = [
        ("```json\n" + pick((2, "函数极限", "判别依据写在这里")) + "\n```", None, [2, 1]),
        (pick(), None, []),
        (pick((3, "函数极限", "判别依据写在这里")), "bad_match", None),
        (pick((1, "数列", "函数极限的定义如下")), "bad_match", None),
        (pick((1, "函数极限", "函数极限")), "bad_match", None),
        ("[]", "not_json", None),
        (json.dumps({"other": 1}), "bad_fields", None),
        (pick((2, "函数极限", "判别依据写在这里")).replace('"subject"', '"extra": 1, "subject"'), "bad_fields", None),
    ]
    df = spark.createDataFrame([(i, "请给出函 数极限的出处", c[0], cites) for i, c in enumerate(cases)], f"request_id bigint, question string, selection string, citations {CITE}")
    rows = {r.request_id: (r.problem, r.selected) for r in A.selection_audit(df).collect()}
    assert rows == {i: c[1:] for i, c in enumerate(cases)}


def test_stale_steps_take_their_dependents_along(spark):
    steps = spark.createDataFrame(
        [(1, 1, "answered", [], [(1, 10, 1)]), (1, 2, "answered", [1], [(1, 20, 1)]), (1, 3, "answered", [2], []), (1, 4, "answered", [], [(1, 30, 1)])],
        "workflow_id bigint, step int, status string, depends_on array<int>, citations array<struct<index:bigint,chunk_id:bigint,doc_id:bigint>>")
    stale = spark.createDataFrame([(10,)], "chunk_id bigint")
    rows = {r.step: (r.status, r.reason) for r in A.propagate_stale(steps, stale).collect()}
    assert rows == {1: ("error", "source_changed"), 2: ("error", "dependency_unavailable"), 3: ("error", "dependency_unavailable"), 4: ("answered", None)}


def test_synthesis_and_summary(spark):
    steps = spark.createDataFrame(
        [(1, 1, "answered", "a [1] b [2]", [(1, 10, 1), (2, 20, 1)]), (1, 2, "answered", "c [1] [2]", [(1, 20, 1), (2, 30, 1)]),
         (1, 3, "answered", "d [5]", [(1, 40, 1)]), (1, 4, "answered", "e [1]", [(1, 10, 9)]), (1, 5, "answered", "f [1]", [(1, 50, 1), (1, 60, 1)]), (1, 6, "insufficient", None, [])],
        "workflow_id bigint, step int, status string, conclusion string, citations array<struct<index:bigint,chunk_id:bigint,doc_id:bigint>>")
    rows = {r.step: (r.valid, r.conclusion) for r in A.synthesise(steps).collect()}
    assert rows == {1: (True, "a [1] b [2]"), 2: (True, "c [2] [3]"), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None)}
    shown = spark.createDataFrame([(1, 1, "g", "answered", None, "c [1]"), (1, 2, "h", "insufficient", "n", None)], "workflow_id bigint, step int, goal string, status string, note string, conclusion string")
    assert A.summary_text(shown).first().answer == "**1. g**\n\nc [1]\n\n**2. h**\n\n（本步证据不足：n）"


def test_task_slices_equal_a_plain_fold(spark):
    import random

    r = random.Random(5)
    kinds = ["queue", "claim", "succeed", "fail", "recover", "supersede"]
    rows = [(r.randint(1, 4), 1 + i // 400, i * 997, r.choice(kinds), f"E{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, ingest_version bigint, seq bigint, kind string, error_code string")
    want = {}
    for doc, version, _, kind, error in sorted(rows, key=lambda x: x[2]):
        want[doc] = advance(want.get(doc), version, kind, error) or want.get(doc)
    got = {x.doc_id: (x.ingest_version, x.status, x.attempt_count, x.recovery_count, x.last_error_code) for x in M.latest_tasks(df).collect()}
    # Errors only come with failures; other endings carry the text they were given.
    assert got == want


def test_sessions_expire_strictly_after_the_ttl(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 23, 59, 30)
    offsets = [0, 1800, 3600, 3600 + 1801, 90000]
    df = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=s)) for s in offsets] + [("b", t0)], "u string, ts timestamp")
    rows = SE.expire_sessions(df, "u", "ts", 1800).orderBy("u", "session").collect()
    assert [(r.u, r.session, r.events) for r in rows] == [("a", 1, 3), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1)]


def test_history(spark):
    rows = [("s", i, "q", "x" * 2000 if i == 9 else f"a{i}", "answered" if i != 8 else "error", 1 if i == 7 else 0) for i in range(10)]
    df = spark.createDataFrame(rows, "session_id string, turn bigint, question string, answer string, status string, unavailable_sources bigint")
    kept = SE.usable_history(df).orderBy("turn").collect()
    assert [r.turn for r in kept] == [2, 3, 4, 5, 6, 9] and len(kept[-1].answer) == 1500
    assert [len(r.answer) for r in SE.rewrite_history(df).orderBy("turn").collect()] == [2, 2, 200]


def test_endless_citation_numbers_are_out_of_range(spark):
    from noteloom.functions import texts as T

    rows = spark.createDataFrame([(f"a [2] [{'9' * 20}] [{'1' * 40}] [2]",)], "t string").select(
        T.citation_numbers(F.col("t")).alias("n"), T.out_of_range_citations(F.col("t"), F.lit(3)).alias("bad")).first()
    assert rows.n == [2, 2**63 - 1] and rows.bad == [2**63 - 1]


def test_no_content_moves_to_find_stale_sources(spark):
    fields = "chunk_id long, doc_id long, kb_id string, content string, char_start long, char_end long, content_hash string, scope_kb string"
    shots = spark.createDataFrame(
        [(1, 1, "k", "same", 0, 4, "h", None), (2, 1, "k", None, 4, 8, "h", None), (3, 1, "k", "old", 8, 9, "h", None),
         (4, 1, "k", None, 9, 9, "h", "k"), (5, 1, "k", "gone", 9, 13, "h", None), (6, 1, "k", "", 13, 13, "h", "other")], fields)
    chunks = spark.createDataFrame(
        [(1, 1, "k", "same", 0, 4), (2, 1, "k", None, 4, 8), (3, 1, "k", "new", 8, 9), (4, 1, "k", "", 9, 9), (6, 1, "k", "", 13, 13)],
        ", ".join(fields.split(", ")[:6]))
    documents = spark.createDataFrame([(1, "k", "h")], "doc_id long, kb_id string, content_hash string")
    stale = A.stale_sources(shots, chunks, documents)
    assert sorted(r.chunk_id for r in stale.collect()) == [3, 4, 5, 6]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", stale._jdf.queryExecution().explainString(mode))
    assert moved and not any(re.search(r"\b_?content#", columns) for columns in moved)
