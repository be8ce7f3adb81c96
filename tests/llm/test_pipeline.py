import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from noteloom.llm.common import stored
from noteloom.llm.pii import masked
from noteloom.llm.probminhash import near_duplicates
from noteloom.llm.risk_rules import apply_rules
from noteloom.llm.rule_ensemble import score_documents


def test_stages_against_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    kept = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), name)
        before, after = docs.toPandas(), out.toPandas()
        if name == "quality_classifier":
            want = {r.doc_id for r in score_documents(docs, labels).where("predicted = 1").collect()}
        elif name == "quality_rules":
            want = {r.doc_id for r in apply_rules(docs, labels).where("kept").collect()}
        elif name == "near_dedup":
            want = {r.class_id for r in near_duplicates(docs).collect()}
        else:
            want = set(before.doc_id)
        assert set(after.doc_id) == want and (name == "best_fit_packing" or list(out.columns) == columns)
        if name == "mask_personal_data":
            assert dict(zip(after.doc_id, after.text, strict=True)) == {i: masked(t) for i, t in zip(before.doc_id, before.text, strict=True)}
            assert (after.n_chars == after.text.str.len()).all()
            texts = dict(zip(after.doc_id, after.text, strict=True))
        kept[name], docs = after, out
    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), kept["best_fit_packing"]
    used = defaultdict(int)
    for i, rows in pieces.groupby("doc_id"):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert rows.length.sum() == len(ids)
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_empty_and_null_rows(spark, sf_dir, tmp_path):
    rows = [(1, None, None, None, None), (None, "word " * 60, "en", "s", 300), (2, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        corpus_pipeline.run(spark, str(folder)).collect()
