from pyspark.sql import functions as F

from noteloom.functions import canonical, texts
from noteloom.operators import images as IM, quality as Q
from noteloom.schemas import ASSET, OCCURRENCE, PACKAGE_MANIFEST, SchemaMismatch, require_schema


def test_reconstruct_overlaps(spark):
    text = "0123456789"
    parts = [(0, 4), (2, 6), (6, 10), (3, 5)]
    chunks = spark.createDataFrame([(i, 1, text[a:b], a, b) for i, (a, b) in enumerate(parts)], "chunk_id bigint, doc_id bigint, content string, char_start bigint, char_end bigint")
    docs = spark.createDataFrame([(1, 10), (2, 0)], "doc_id bigint, char_count bigint")
    rows = {r.doc_id: (r.text, r.code) for r in Q.reconstruct(chunks, docs).collect()}
    assert rows == {1: (text, None), 2: ("", None)}


def test_digest_sees_every_change(spark):
    df = spark.range(0, 10000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    digest = lambda d: Q.table_digest(d, "k", "t").first()
    base = digest(df)
    assert base.n_rows == 10000 and digest(df.repartition(3)) == base
    assert digest(df.withColumn("v", F.when(F.col("k") == 7777, 0).otherwise(F.col("v")))).sha256 != base.sha256
    assert digest(df.filter("k <> 5")).sha256 != base.sha256
    both = Q.combined_digest(Q.table_digest(df, "k", "a").unionByName(Q.table_digest(df, "k", "b"))).first()
    assert both.n_tables == 2


def test_levels_follow_the_keys(spark):
    assert Q.key_levels("id", spark.range(0)) == Q.key_levels("id", spark.range(4096)) == 1
    assert Q.key_levels("id", spark.range(4097)) == 2 and Q.key_levels("id", spark.range(-1, 4096)) == 2
    ends = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,)], "id bigint")
    assert Q.key_levels("id", ends) == 6
    packed = spark.range(9000).select(F.shiftleft("id", 27).alias("k"), F.col("id").alias("v"))
    assert Q.key_levels("k", packed) == 4
    digest = Q.table_digest(packed, "k", "t").first()
    assert digest.n_rows == 9000 and digest == Q.table_digest(packed.repartition(5), "k", "t").first()
    assert digest.sha256 != Q.table_digest(packed.where("v <> 8999"), "k", "t").first().sha256


def test_differing_ranges(spark):
    left = spark.range(-5000, 60000).select(F.shiftleft("id", 3).alias("k"), (F.col("id") % 7).alias("v"))
    changed = (-5000, 3, 8, 511, 512, 40000)
    right = left.where(~F.col("k").isin([8 * 9000, 8 * 59999])).withColumn("v", F.when(F.col("k").isin([8 * c for c in changed]), -1).otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(1 << 40, 1)], left.schema))
    got = sorted(tuple(r) for r in Q.table_differences(left, right, "k").collect())
    a, b = ({r.k: r.v for r in t.collect()} for t in (left, right))
    bad = {k >> 12 for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    want = [(g << 12, (g << 12) + 4095, sum(k >> 12 == g for k in a), sum(k >> 12 == g for k in b)) for g in sorted(bad)]
    assert got == want
    assert Q.table_differences(left, left.repartition(3), "k").count() == 0
    empty = left.limit(0)
    assert Q.table_differences(empty, empty, "k").count() == 0
    assert Q.table_differences(empty, left.where("k = 8"), "k").collect() == [(0, 4095, 0, 1)]


def test_packages_of_any_size(spark):
    files = spark.range(20000).select(
        F.when(F.col("id") < 19000, 1).otherwise(F.col("id") % 3 + 2).alias("package"), F.concat(F.lit("p"), "id").alias("path"),
        F.col("id").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    of = lambda df, **k: {r.package: r.package_hash for r in Q.package_hash(df, **k).collect()}
    base = of(files)
    assert len(base) == 4 and base == of(files.repartition(7))
    for rows in (4, 4096):  # two levels, one level
        once, other = of(files, list_rows=rows), of(files.where("path <> 'p77'"), list_rows=rows)
        assert {p for p in once if once[p] != other[p]} == {1}
    flat = of(files, list_rows=1 << 20)
    assert {p: h for p, h in flat.items() if p != 1} == {p: h for p, h in base.items() if p != 1} and flat[1] != base[1]
    tree = lambda df, **k: Q.tree_digest(df, **k).first()
    for rows in (1000, 1 << 22):
        assert tree(files, list_rows=rows) == tree(files.repartition(5), list_rows=rows) != tree(files.where("path <> 'p77'"), list_rows=rows)
        assert tree(files, list_rows=rows)[:2] == (20000, 19999 * 10000)


def test_catalogue_problems(spark):
    rec = "struct<path:string,content_hash:string,char_count:bigint,size:bigint,mtime_ns:bigint>"
    bases = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "kb_id bigint, name string")
    r = lambda p, h="h": (p, h, 1, 1, 1)
    docs = spark.createDataFrame(
        [(1, 1, "t", r("p1"), None), (2, 1, "t", r("p1"), None), (3, 9, "u", r("p3"), r("p3", "x")), (3, 1, "v", r("p5"), r("p6"))],
        f"doc_id bigint, kb_id bigint, title string, active {rec}, pending {rec}")
    codes = sorted(x.code for x in Q.catalogue_problems(bases, docs).collect())
    assert codes == sorted(["duplicate_kb_id", "duplicate_kb_name", "duplicate_doc_id", "duplicate_title", "unknown_kb", "path_of_two_documents", "path_with_two_contents"])


GOOD = "ab" * 32


def manifest(**change):
    asset = {"source_path": "img/a.png", "stored_path": f"kb/1/assets/{GOOD}.png", "content_hash": GOOD, "mime_type": "image/png", "file_size": 1, "width": 1, "height": 1}
    occ = [{"ordinal": 1, "source_reference": "img/a.png", "asset_source_path": "img/a.png", "alt_text": "", "char_start": 0, "char_end": 5},
           {"ordinal": 2, "source_reference": "img/a.png", "asset_source_path": "img/a.png", "alt_text": "", "char_start": 5, "char_end": 9}]
    asset.update(change.get("asset", {}))
    occ[1].update(change.get("occ", {}))
    order = lambda s, d: tuple(d[f.name] for f in s)
    return (1, change.get("doc_id", 1), 1, GOOD, "kb/1/source.md", "n.md", GOOD, 10, [order(ASSET, asset)] * change.get("times", 1), [order(OCCURRENCE, o) for o in occ])


def test_manifest_problems(spark):
    cases = [
        ({}, None), ({"asset": {"source_path": "../a.png"}}, "asset_path"), ({"asset": {"content_hash": "x"}}, "asset_hash"),
        ({"asset": {"mime_type": "image/gif"}}, "asset_type"), ({"asset": {"stored_path": "kb/other"}}, "asset_stored_path"),
        ({"asset": {"width": 0}}, "asset_size"), ({"times": 2}, "asset_repeated"), ({"occ": {"ordinal": 3}}, "occurrence_ordinal"),
        ({"occ": {"asset_source_path": "no.png"}}, "occurrence_asset"), ({"occ": {"alt_text": None}}, "occurrence_text"),
        ({"occ": {"char_start": 4}}, "occurrence_span"), ({"occ": {"char_end": 11}}, "occurrence_span"), ({"occ": {"char_end": 5}}, "occurrence_span"),
    ]
    rows = [manifest(doc_id=i, **c) for i, (c, _) in enumerate(cases)]
    found = {}
    for r in Q.manifest_problems(spark.createDataFrame(rows, PACKAGE_MANIFEST)).collect():
        found.setdefault(r.doc_id, set()).add(r.code)
    for i, (_, code) in enumerate(cases):
        assert (code in found[i]) if code else i not in found, cases[i]


def test_image_forms(spark):
    text = (
        "![one](a.png \"t\") ![two][ref] ![ref][] ![ref] \\![no](x.png) `![no](y.png)`\n"
        "~~~\n![no](z.png)\n~~~\n![p(a)](<with space.png>) ![q](b\\ c.png)\n\n[ref]: <r.png>\n"
    )
    df = spark.createDataFrame([(1, text), (2, "<img src=x>"), (3, "![open"), (4, "![x][none]"), (5, "`<img>` ok")], "doc_id bigint, text string")
    rows = IM.occurrence_table(df).orderBy("ordinal").collect()
    assert [(r.source_reference, r.alt_text) for r in rows] == [
        ("a.png", "one"), ("r.png", "two"), ("r.png", "ref"), ("r.png", "ref"), ("with space.png", "p(a)"), ("b c.png", "q")]
    assert all(text[r.char_start : r.char_end].startswith("![") for r in rows)
    errors = {r.doc_id: r.e for r in df.select("doc_id", IM.scan_images(F.col("text"))["error"].alias("e")).collect()}
    assert errors == {1: None, 2: "html_image", 3: "image_not_closed", 4: "image_target_unknown", 5: None}


def test_resolving_and_assets(spark):
    refs = ["../i/a.png", "a%20b.png", "../../x.png", "http://x/a.png", "/a.png", "a.png?x", "a\\b.png", "%FF.png", ""]
    df = spark.createDataFrame([("notes/n.md", r) for r in refs], "base string, ref string")
    out = {r.ref: (r.asset_source_path, r.problem) for r in IM.resolve_references(df, "base", "ref").collect()}
    assert out["../i/a.png"] == ("i/a.png", None) and out["a%20b.png"] == ("notes/a b.png", None)
    assert [out[r][1] for r in refs[2:]] == ["escapes_root", "not_relative", "not_relative", "query_or_fragment", "bad_path", "not_utf8", "bad_path"]
    occ = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "package string, asset_source_path string")
    assets = spark.createDataFrame([("p", "a"), ("p", "c")], "package string, source_path string")
    assert sorted((r.source_path, r.code) for r in IM.asset_problems(occ, assets).collect()) == [("b", "asset_missing"), ("c", "asset_unused")]


def test_package_drift(spark):
    import hashlib

    text = "![a](i.png) x"
    sha = hashlib.sha256(text.encode()).hexdigest()
    occ = [(1, "i.png", "i.png", "a", 0, 11)]
    row = lambda doc, s=sha, n=len(text), o=occ: (1, doc, 1, "", "p/source.md", "n.md", s, n, [], o)
    manifests = spark.createDataFrame(
        [row(1), row(2, s="0"), row(3, n=1), row(4, o=[(1, "i.png", "i.png", "a", 1, 11)])], PACKAGE_MANIFEST)
    texts_ = spark.createDataFrame([(i, text) for i in range(1, 5)], "doc_id bigint, text string")
    assert {r.doc_id: r.code for r in IM.package_drift(manifests, texts_).collect()} == {2: "hash_mismatch", 3: "length_mismatch", 4: "occurrence_mismatch"}


def test_redaction_paths_and_schema(spark):
    samples = {
        "Authorization: Bearer abc.def": "Authorization: [REDACTED] [REDACTED]",
        "x Basic QWxhZGRpbg==": "x Basic [REDACTED]",
        "{\"api_key\": \"k-1\", a": "{\"api_key\": \"[REDACTED]\", a",
        "http://u:p@host/x": "http://[REDACTED]@host/x",
        "my s3cret-long and s3cret": "my [REDACTED] and [REDACTED]",
    }
    df = spark.createDataFrame([(k,) for k in samples], "t string")
    out = {r.t: r.x for r in df.select("t", texts.redact(F.col("t"), ["s3cret", "s3cret-long"]).alias("x")).collect()}
    assert out == samples
    paths = {"a/b.md": True, "/a": False, "a//b": False, "a/../b": False, "a\\b": False, "c:b": False, "": False, "a/./b": False}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", canonical.is_relative_source_path(F.col("p")).alias("ok")).collect()} == paths
    try:
        require_schema(df, PACKAGE_MANIFEST)
        raise AssertionError
    except SchemaMismatch as error:
        assert "extra=['p']" in str(error)


def test_chunk_problems_with_vectors(spark):
    docs = spark.createDataFrame([(1, 1, "héllo wörld")], "doc_id bigint, kb_id bigint, text string")
    good = [0.5, 1.0]
    rows = [(1, 1, 1, "héllo", 0, 5, good), (2, 1, 1, "wörld", 6, 11, [1.0]), (3, 1, 2, "h", 0, 1, good), (4, 9, 1, "h", 0, 1, good),
            (5, 1, 1, "xx", 0, 2, good), (6, 1, 1, "h", 0, 2, good), (7, 1, 1, "d", 11, 12, good), (8, 1, 1, "h", 0, 1, [float("nan"), 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, kb_id bigint, content string, char_start bigint, char_end bigint, embedding array<double>")
    found = {r.chunk_id: r.code for r in Q.chunk_problems(chunks, docs, 2).collect()}
    assert found == {2: "bad_vector", 3: "kb_mismatch", 4: "document_missing", 5: "content_mismatch", 6: "length_mismatch", 7: "span_out_of_bounds", 8: "bad_vector"}
