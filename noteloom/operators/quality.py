"""Integrity checks and digests of tables, chunk indexes and image packages.

Each check returns the offending rows with a code, so an empty result means sound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.canonical import fingerprint, is_archive_path, is_sha256
from noteloom.functions.texts import nfc
from noteloom.functions.vectors import is_valid_vector


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- chunks


def chunk_problems(chunks: DataFrame, documents: DataFrame, dimension: int | None = None) -> DataFrame:
    """Chunks that do not fit their document: (chunk_id, doc_id, code).

    Documents: ``doc_id, kb_id, text``. The chunks of a document meet its text in one row, so
    a long text is not repeated for each of them. The first broken rule of a chunk counts.
    """
    fields = ["chunk_id", "kb_id", "content", "char_start", "char_end"] + (["embedding"] if dimension is not None else [])
    held = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("_chunks"))
    known = documents.select("doc_id", F.col("kb_id").alias("_kb"), F.col("text").alias("_text"), F.lit(True).alias("_known"))
    joined = held.join(known, "doc_id", "left").withColumn("_length", F.length("_text"))

    def judged(c: Column) -> Column:
        start, end = c["char_start"], c["char_end"]
        code = (
            F.when(F.col("_known").isNull(), "document_missing")
            .when(~c["kb_id"].eqNullSafe(F.col("_kb")), "kb_mismatch")
            .when((start < 0) | (end <= start) | (end > F.col("_length")), "span_out_of_bounds")
            .when(F.length(c["content"]) != end - start, "length_mismatch")
            .when(F.substring(F.col("_text"), start + 1, end - start) != c["content"], "content_mismatch")
        )
        if dimension is not None:
            code = code.when(~is_valid_vector(c["embedding"], dimension), "bad_vector")
        return F.struct(c["chunk_id"].alias("chunk_id"), code.alias("code"))

    broken = F.filter(F.transform("_chunks", judged), lambda x: x["code"].isNotNull())
    return joined.select("doc_id", F.explode_outer(broken).alias("x")).filter(F.col("x").isNotNull()).select(
        "x.chunk_id", "doc_id", "x.code"
    )


def index_problems(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose chunk numbers have gaps or differ from the stored count.

    Documents: ``doc_id, status, chunk_count``. Output: (doc_id, chunks, code).
    """
    n, index = F.count(F.lit(1)), F.col("chunk_index")
    per_doc = chunks.groupBy("doc_id").agg(
        n.alias("chunks"), F.min(index).alias("_low"), F.max(index).alias("_high"),
        F.count_distinct(index).alias("_distinct"),
    )
    j = documents.join(per_doc, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("bigint"))
    code = (
        F.when(F.col("chunks") != F.col("chunk_count"), "count_mismatch")
        .when((F.col("status") == "ready") & (F.col("chunks") == 0), "ready_without_chunks")
        .when(
            (F.col("chunks") > 0)
            & ((F.col("_low") != 0) | (F.col("_high") != F.col("chunks") - 1) | (F.col("_distinct") != F.col("chunks"))),
            "index_not_contiguous",
        )
    )
    return j.withColumn("code", code).filter(F.col("code").isNotNull()).select("doc_id", "chunks", "code")


def reconstruct(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Rebuild each document from overlapping chunks: (doc_id, text, code).

    ``code`` is null when the text is whole; otherwise ``gap``, ``conflict`` (chunks that
    overlap disagree) or ``length_mismatch``, and ``text`` is null. Documents: ``doc_id,
    char_count``. A group is one document, whose size the intake gate bounds.
    """
    w = Window.partitionBy("doc_id").orderBy("char_start", "char_end", "chunk_id")
    before = F.coalesce(F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    start, end = F.col("char_start"), F.col("char_end")
    placed = chunks.withColumn("_seen", before).withColumns({
        "_gap": (start < 0) | (start > F.col("_seen")) | (end - start != F.length("content")),
        "_new": F.when(end > F.col("_seen"), F.expr("substring(content, _seen - char_start + 1)")),
    })
    joined = placed.groupBy("doc_id").agg(
        F.bool_or("_gap").alias("gap"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_new").isNotNull(), F.struct("char_start", "char_end", "_new")))),
                lambda p: p["_new"],
            ), "",
        ).alias("text"),
        F.collect_list(F.struct("char_start", "content")).alias("_parts"),
    )
    checked = documents.select("doc_id", "char_count").join(joined, "doc_id", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    agrees = F.forall(
        F.coalesce("_parts", F.array().cast("array<struct<char_start:bigint,content:string>>")),
        lambda p: F.substring(F.col("text"), p["char_start"] + 1, F.length(p["content"])) == p["content"],
    )
    code = (
        F.when(F.coalesce("gap", F.lit(False)), "gap")
        .when(F.length("text") != F.col("char_count"), "length_mismatch")
        .when(~agrees, "conflict")
    )
    return checked.withColumn("code", code).select(
        "doc_id", F.when(F.col("code").isNull(), F.col("text")).alias("text"), "code"
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(key), key, "left_anti")


def unreferenced(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored files that neither the active nor the pending source of a document names."""
    used = documents.select(F.explode(F.array("file_path", "pending_file_path")).alias("path")).dropna()
    return files.join(used, "path", "left_anti")


# ---------------------------------------------------------------- keys


def duplicates(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def catalogue_problems(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Broken uniqueness in a catalogue: (code, detail).

    Bases: ``kb_id, name``. Documents: ``doc_id, kb_id, title, active, pending``.
    """
    owner = documents.select(
        "doc_id", F.explode(F.array_compact(F.array("active.path", "pending.path"))).alias("path")
    )
    shared = owner.groupBy("path").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b")
    conflict = documents.filter(
        F.col("pending").isNotNull() & (F.col("pending.path") == F.col("active.path"))
        & ~F.col("pending").eqNullSafe(F.col("active"))
    )
    row = lambda df, code, detail: df.select(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    return _union([
        row(duplicates(bases, "kb_id"), "duplicate_kb_id", F.col("kb_id")),
        row(duplicates(bases, "name"), "duplicate_kb_name", F.col("name")),
        row(duplicates(documents, "doc_id"), "duplicate_doc_id", F.col("doc_id")),
        row(duplicates(documents, "kb_id", "title"), "duplicate_title", F.col("title")),
        row(documents.join(bases, "kb_id", "left_anti"), "unknown_kb", F.col("doc_id")),
        row(shared, "path_of_two_documents", F.col("path")),
        row(conflict, "path_with_two_contents", F.col("doc_id")),
    ])


# ---------------------------------------------------------------- digests

_RANGE_BITS = 12


def row_hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, hash): SHA-256 of each row's canonical JSON."""
    return df.select(F.col(key).cast("bigint").alias("key"), fingerprint(**{c: F.col(c) for c in df.columns}).alias("hash"))


def key_levels(key: str, *tables: DataFrame) -> int:
    """How many levels of ranges lead from the keys of the tables to one root with at most 4096 members.

    Only the smallest and largest key are read. Six levels suffice for any 64-bit keys.
    """
    ends = reduce(DataFrame.unionByName, [t.agg(F.min(key).cast("bigint").alias("a"), F.max(key).cast("bigint").alias("b")) for t in tables]).agg(
        F.min("a"), F.max("b")).first()
    first, last = (0, 0) if ends[0] is None else ends
    levels = 1
    while (last >> _RANGE_BITS * (levels - 1)) - (first >> _RANGE_BITS * (levels - 1)) >= 1 << _RANGE_BITS:
        levels += 1
    return levels


def _hashed_members(members: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(members), lambda m: m["hash"]), "\n"), 256)


def _ranges_above(level: DataFrame, bucket: Column) -> DataFrame:
    """(key, n, hash) of the next level: one row per bucket, with the hash of its members in key order."""
    return level.groupBy(bucket.alias("bucket")).agg(
        F.sum("n").alias("n"), _hashed_members(F.collect_list(F.struct("key", "hash"))).alias("hash")).withColumnRenamed("bucket", "key")


def table_digest(df: DataFrame, key: str, name: str, levels: int | None = None) -> DataFrame:
    """(table_name, n_rows, sha256): equal exactly when the rows are equal.

    Rows are hashed, then the hashes of each fixed range of 4096 keys, then ranges of
    ranges. ``key`` is a unique integer, so no group has more than 4096 members: the number
    of levels follows from the span of the keys, be they dense, sparse or packed, and is
    three at least. Digests to be compared over time can fix ``levels`` (six hold for all keys).
    """
    levels = levels or max(3, key_levels(key, df))
    level = row_hashes(df, key).withColumn("n", F.lit(1).cast("bigint"))
    for depth in range(levels):
        level = _ranges_above(level, F.shiftright("key", _RANGE_BITS) if depth < levels - 1 else F.lit(0).cast("bigint"))
    return level.select(F.lit(name).alias("table_name"), F.col("n").alias("n_rows"), F.col("hash").alias("sha256"))


def digest_tree(df: DataFrame, key: str, levels: int = 6) -> DataFrame:
    """(level, key, n, hash): every range of the digest, from ranges of 4096 keys (level 1) to the top.

    Keys of a level are the table's keys without their last ``12 * level`` bits. Written once, a
    tree lets later versions of the table be compared without its rows.
    """
    level = row_hashes(df, key).withColumn("n", F.lit(1).cast("bigint"))
    found = []
    for depth in range(1, levels + 1):
        level = _ranges_above(level, F.shiftright("key", _RANGE_BITS))
        if depth == 1:  # rows are hashed once, whatever the number of levels
            level = level.checkpoint()
        found.append(level.select(F.lit(depth).alias("level"), "key", "n", "hash"))
    return _union(found)


def differing_ranges(left: DataFrame, right: DataFrame, levels: int = 6) -> DataFrame:
    """(first_key, last_key, left_rows, right_rows): ranges of 4096 keys whose rows differ in two digest trees.

    Ranges are compared from the top; below a range that is equal on both sides nothing is.
    """
    open_ = None
    for depth in range(levels, 0, -1):
        sides = [t.where(F.col("level") == depth).select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "hash")]) for side, t in (("left", left), ("right", right))]
        if open_ is not None:
            sides = [s.join(open_, F.shiftright(s["key"], _RANGE_BITS) == open_["above"], "left_semi") for s in sides]
        differs = sides[0].join(sides[1], "key", "full_outer").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        open_ = differs.select(F.col("key").alias("above"))
    rows = lambda side: F.coalesce(f"{side}_n", F.lit(0)).cast("bigint").alias(f"{side}_rows")
    first = F.shiftleft("key", _RANGE_BITS)
    return differs.select(first.alias("first_key"), (first + ((1 << _RANGE_BITS) - 1)).alias("last_key"), rows("left"), rows("right"))


def table_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """:func:`differing_ranges` of two tables, with as many levels as their keys need."""
    levels = key_levels(key, left, right)
    return differing_ranges(digest_tree(left, key, levels), digest_tree(right, key, levels), levels)


def combined_digest(digests: DataFrame) -> DataFrame:
    """One digest over all tables: (n_tables, sha256). One row per table goes in."""
    line = F.concat_ws("\0", "table_name", F.col("n_rows").cast("string"), "sha256")
    return digests.agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"),
    )


def _slot_digests(entries: DataFrame, group: list[str], line: Column, levels: Column, sums: dict[str, Column], passes: int) -> DataFrame:
    """``group``, the sums and ``hash``: entries in path order, hashed by slots of their path's hash, level by level.

    ``levels`` (of a group) says how many levels of 4096 slots lie above the lists; a group
    with none is one list.
    """
    slots = F.call_function("shiftleft", F.lit(1).cast("bigint"), levels * _RANGE_BITS)
    members = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    level = entries.withColumn("levels", levels).groupBy(*group, "levels", F.pmod(F.xxhash64("path"), slots).alias("key")).agg(
        *[v.alias(k) for k, v in sums.items()], F.sha2(F.array_join(F.transform(members, lambda m: m["line"]), "\n"), 256).alias("hash"))
    for depth in range(1, passes + 1):
        counts = F.col("levels") >= depth
        level = level.groupBy(*group, "levels", F.when(counts, F.shiftright("key", _RANGE_BITS)).otherwise(F.col("key")).alias("up")).agg(
            *[F.sum(k).alias(k) for k in sums],
            F.when(counts, _hashed_members(F.collect_list(F.struct("key", "hash")))).otherwise(F.max("hash")).alias("hash")).withColumnRenamed("up", "key")
    return level.select(*group, *sums, "hash")


#: A list of this many entries gets a level of slots above it, and one with 4096 times as many the next.
_LIST_ROWS = 1 << 22
_PACKAGE_ROWS = 1 << _RANGE_BITS


def tree_digest(files: DataFrame, list_rows: int = _LIST_ROWS) -> DataFrame:
    """(n_files, n_bytes, sha256) of files (path, length, sha256), in path order.

    Paths are spread over 4096 slots by their hash, over 4096 times as many for each 4096-fold of
    ``list_rows`` files, and each slot is hashed in path order; slots are hashed level by level.
    """
    n, levels = files.count(), 1
    while n > list_rows << _RANGE_BITS * (levels - 1):
        levels += 1
    line = F.concat_ws("\0", "path", F.col("length").cast("string"), "sha256")
    return _slot_digests(
        files, [], line, F.lit(levels), {"n_files": F.count(F.lit(1)), "n_bytes": F.sum("length")}, levels,
    ).select("n_files", "n_bytes", F.col("hash").alias("sha256"))


def package_hash(entries: DataFrame, list_rows: int = _PACKAGE_ROWS) -> DataFrame:
    """Logical hash of each package from its entries (package, path, length, sha256).

    Independent of archive order, compression and time stamps. A package of up to
    ``list_rows`` entries is one list; a larger one is hashed by slots, in one level up to
    1024 entries a slot and in two beyond, so its entries are dealt out whatever their number.
    """
    line = F.concat_ws("\0", F.octet_length("path").cast("string"), "path", F.col("length").cast("string"), "sha256")
    n = F.col("n_entries")
    large = entries.groupBy("package").agg(F.count(F.lit(1)).alias("n_entries")).where(n > list_rows).select(
        "package", F.when(n <= list_rows << 10, 1).otherwise(2).alias("above"))
    known = entries.join(large, "package", "left")
    return _slot_digests(known, ["package"], line, F.coalesce("above", F.lit(0)), {}, 2).withColumnRenamed("hash", "package_hash")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, counted with multiplicity: columns plus ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


# ---------------------------------------------------------------- image package manifests

# Stored extension of each accepted image type.
MIME_EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/webp": ".webp"}


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Broken rules in image package manifests: (doc_id, code, ordinal)."""
    extension = F.create_map(*[F.lit(x) for p in MIME_EXTENSIONS.items() for x in p])
    folder = F.regexp_replace("source_path", r"/[^/]*$", "")
    asset = manifests.select("doc_id", folder.alias("_folder"), F.posexplode("assets").alias("_i", "a")).withColumn(
        "_nfc", nfc(F.col("a.source_path"))
    )
    stored = F.concat("_folder", F.lit("/assets/"), "a.content_hash", F.try_element_at(extension, F.col("a.mime_type")))
    positive = (F.col("a.file_size") > 0) & (F.col("a.width") > 0) & (F.col("a.height") > 0)
    asset_code = (
        F.when(~is_archive_path(F.col("a.source_path"), F.col("_nfc")), "asset_path")
        .when(~is_sha256(F.col("a.content_hash")), "asset_hash")
        .when(F.try_element_at(extension, F.col("a.mime_type")).isNull(), "asset_type")
        .when(~stored.eqNullSafe(F.col("a.stored_path")), "asset_stored_path")
        .when(~F.coalesce(positive, F.lit(False)), "asset_size")
    )
    assets = asset.select("doc_id", asset_code.alias("code"), (F.col("_i") + 1).cast("bigint").alias("ordinal"))
    repeated = asset.groupBy("doc_id", F.col("a.source_path").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("_i") + 1).cast("bigint").alias("ordinal")
    ).filter("n > 1").select("doc_id", F.lit("asset_repeated").alias("code"), "ordinal")

    # Occurrences are judged inside the row: order and neighbours are array positions.
    def judged(o: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("occurrences"), i - 1)["char_end"], F.lit(-1))
        inside = (o["char_start"] >= F.greatest(before, F.lit(0))) & (o["char_end"] > o["char_start"]) & (
            o["char_end"] <= F.col("source_char_count")
        )
        known = F.exists(F.col("assets"), lambda a: a["source_path"] == o["asset_source_path"])
        return (
            F.when(~F.coalesce(o["ordinal"] == i + 1, F.lit(False)), "occurrence_ordinal")
            .when(~F.coalesce(known, F.lit(False)), "occurrence_asset")
            .when(o["source_reference"].isNull() | o["alt_text"].isNull(), "occurrence_text")
            .when(~F.coalesce(inside, F.lit(False)), "occurrence_span")
        )

    occurrences = manifests.select("doc_id", F.posexplode(F.transform("occurrences", judged)).alias("_i", "code")).select(
        "doc_id", "code", (F.col("_i") + 1).cast("bigint").alias("ordinal")
    )
    return _union([assets, repeated, occurrences]).filter(F.col("code").isNotNull())
