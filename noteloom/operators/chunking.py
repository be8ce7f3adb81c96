"""Documents to chunks: exact source spans that never cut a sentence or a structure.

Finding the units is per-document text work and runs in an Arrow function; packing
them into chunks is a fold inside the row. Neither needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from noteloom import settings as S
from noteloom.functions import markup as M
from noteloom.functions.texts import casefold, depends_on_previous, nfkc_squash

_UNITS_ARROW = pa.list_(pa.struct([
    ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("prose", pa.bool_()),
    ("heading", pa.bool_()), ("tail_start", pa.int64()), ("tail_heading", pa.bool_()),
]))
_READING_ARROW = pa.list_(pa.struct([
    ("section", pa.int32()), ("section_start", pa.int64()), ("section_end", pa.int64()),
    ("start", pa.int64()), ("end", pa.int64()), ("heading", pa.bool_()),
]))


_UNITS = from_arrow_type(_UNITS_ARROW)
_READING = from_arrow_type(_READING_ARROW)


def _packable(text: str, spans, target: int) -> Iterator[dict]:
    """Units of a text with what packing needs to know about each."""
    guard = M.Guard(text, M.check_spans(text, spans))
    for section, (a, b) in enumerate(M.section_spans(text, guard)):
        units = M.pack_units(text, a, b, guard, target)
        for i, u in enumerate(units):
            tail = M.sentence_units(text, u.start, u.end, guard)[-1].start if u.prose else u.start
            following = units[i + 1].end if i + 1 < len(units) else u.end
            yield {
                "section": section, "start": u.start, "end": u.end, "prose": u.prose,
                "heading": bool(M.HEADING.match(text[u.start : u.end].lstrip())),
                "tail_start": tail, "tail_heading": bool(M.HEADING.match(text[tail:following].lstrip())),
            }


def note_units(text: Column, target: int = S.CHUNK_TARGET_CHARS, protected: Column | None = None) -> Column:
    """Units of a document in order: array of section, span, kind and last sentence.

    ``protected`` holds extra spans, ``array<struct<start,end>>``, that stay whole.
    """

    @F.arrow_udf(_UNITS)
    def units(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            blank = t is None or not t.strip()
            out.append([] if blank else list(_packable(t, [(x["start"], x["end"]) for x in s or ()], target)))
        return pa.array(out, _UNITS_ARROW)

    # Marked as not repeatable, so that no pushed-down test evaluates it a second time.
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    return units.asNondeterministic()(text, none if protected is None else protected)


@F.arrow_udf(_READING)
def reading_units(texts: pa.Array) -> pa.Array:
    """Sentences and structures of a document with their sections, for context recovery."""
    out = []
    for t in texts.to_pylist():
        guard = M.Guard(t or "")
        out.append([
            {
                "section": n, "section_start": a, "section_end": b, "start": u.start, "end": u.end,
                "heading": bool(M.HEADING.match(t[u.start : u.end])),
            }
            for n, (a, b) in enumerate(M.section_spans(t or "", guard))
            for u in M.reading_units(t, a, b, guard)
        ])
    return pa.array(out, _READING_ARROW)


def pack(units: Column, target: int, overlap: int, limit: int) -> Column:
    """Fold units into chunk spans: ``array<struct<start,end>>``.

    A chunk takes units while it stays within ``target``. A lone heading takes its next
    unit up to ``limit``. The last sentence of a chunk is repeated in the next one when
    it has at most ``overlap`` characters and the next unit still fits.
    """
    big = lambda x: F.lit(x).cast("bigint")
    zero = F.struct(
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"),
        big(0).alias("first"), big(0).alias("end"), big(0).alias("n"), F.lit(-1).alias("section"),
        F.lit(False).alias("heading"), F.lit(False).alias("full"), F.lit(False).alias("prose"),
        big(0).alias("tail_start"), F.lit(False).alias("tail_heading"),
    )
    closed = lambda s: F.when(
        s["n"] > 0, F.array_append(s["done"], F.struct(s["first"].alias("start"), s["end"].alias("end")))
    ).otherwise(s["done"])

    def step(s: Column, u: Column) -> Column:
        size = u["end"] - s["first"]
        same = (s["n"] > 0) & (s["section"] == u["section"])
        fits = same & ~s["full"] & (size <= target)
        glued = same & ~fits & (s["n"] == 1) & s["heading"] & (size <= limit)
        joins = fits | glued
        repeats = (
            same & s["prose"] & (s["end"] - s["tail_start"] <= overlap) & (u["end"] - s["tail_start"] <= target)
        )
        fresh = lambda kept, repeated, new: F.when(joins, kept).when(repeats, repeated).otherwise(new)
        return F.struct(
            F.when(joins, s["done"]).otherwise(closed(s)).alias("done"),
            fresh(s["first"], s["tail_start"], u["start"]).alias("first"),
            u["end"].alias("end"),
            F.when(joins, s["n"] + 1).otherwise(big(1)).alias("n"),
            u["section"].alias("section"),
            fresh(s["heading"], s["tail_heading"], u["heading"]).alias("heading"),
            glued.alias("full"), u["prose"].alias("prose"),
            u["tail_start"].alias("tail_start"), u["tail_heading"].alias("tail_heading"),
        )

    return F.aggregate(units, zero, step, closed)


def _check_sizes(target: int, overlap: int, limit: int) -> None:
    if target <= 0 or limit < target:
        raise ValueError("the unit limit must be at least the target, which must be positive")
    if not 0 <= overlap < target:
        raise ValueError("the overlap must be between zero and target - 1")


def with_units(documents: DataFrame, target: int = S.CHUNK_TARGET_CHARS, protected: str | None = None) -> DataFrame:
    return documents.withColumn(
        "units", note_units(F.col("text"), target, F.col(protected) if protected else None)
    )


def split_documents(
    documents: DataFrame, target: int = S.CHUNK_TARGET_CHARS, overlap: int = S.CHUNK_OVERLAP_CHARS,
    limit: int = S.CHUNK_UNIT_LIMIT_CHARS, protected: str | None = None, on_oversize: str = "reject",
) -> DataFrame:
    """Documents with ``spans`` (null when rejected) and ``oversized`` units.

    Documents: ``doc_id, text`` and any other columns. With ``on_oversize="keep"`` an
    oversized unit becomes a chunk of its own.
    """
    _check_sizes(target, overlap, limit)
    if on_oversize not in ("reject", "keep"):
        raise ValueError("on_oversize must be 'reject' or 'keep'")
    analysed = with_units(documents, target, protected).withColumn(
        "oversized", F.filter("units", lambda u: u["end"] - u["start"] > limit)
    )
    spans = pack(F.col("units"), target, overlap, limit)
    if on_oversize == "reject":
        spans = F.when(F.size("oversized") == 0, spans)
    return analysed.withColumn("spans", spans).drop("units")


def chunk_rows(split: DataFrame, *carry: str) -> DataFrame:
    """Chunks of the accepted documents: (doc_id, carry..., chunk_index, content, char_start, char_end)."""
    # The outer form keeps the optimizer from testing the array, and so building it, twice.
    rows = split.select("doc_id", *carry, "text", F.posexplode_outer("spans").alias("chunk_index", "s"))
    return rows.filter(F.col("chunk_index").isNotNull()).select(
        "doc_id", *carry, F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("content"),
        F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"),
    )


def reject_rows(split: DataFrame, *carry: str) -> DataFrame:
    """Units that made a document unacceptable: (doc_id, carry..., char_start, char_end, code)."""
    return split.filter(F.col("spans").isNull()).select(
        "doc_id", *carry, F.explode_outer("oversized").alias("u")
    ).filter(F.col("u").isNotNull()).select(
        "doc_id", *carry, F.col("u.start").alias("char_start"), F.col("u.end").alias("char_end"),
        F.lit("unit_too_long").alias("code"),
    )


def pack_lines(spans: Column, target: int, limit: int) -> Column:
    """Pack line spans (see :func:`noteloom.operators.lines.line_spans`) without overlap."""
    units = F.transform(
        spans,
        lambda s: F.struct(
            F.lit(0).alias("section"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("prose"),
            F.lit(False).alias("heading"), s["start"].alias("tail_start"), F.lit(False).alias("tail_heading"),
        ),
    )
    return pack(units, target, 0, limit)


def unit_table(documents: DataFrame) -> DataFrame:
    """One row per sentence or structure, with its dependency on the unit before it.

    (doc_id, section, section_start, section_end, unit, char_start, char_end, heading, dependent)
    """
    return (
        documents.select("doc_id", "text", reading_units(F.col("text")).alias("units"))
        .select("doc_id", "text", F.posexplode_outer("units").alias("unit", "u"))
        .filter(F.col("unit").isNotNull())
        .select(
            "doc_id", "u.section", "u.section_start", "u.section_end", F.col("unit").cast("bigint").alias("unit"),
            F.col("u.start").alias("char_start"), F.col("u.end").alias("char_end"), "u.heading",
            depends_on_previous(
                F.substring("text", F.col("u.start") + 1, F.col("u.end") - F.col("u.start"))
            ).alias("dependent"),
        )
    )


def register_functions(spark: SparkSession, target: int = S.CHUNK_TARGET_CHARS) -> None:
    """Make the Arrow functions callable from SQL."""

    @F.arrow_udf(_UNITS)
    def sql_units(texts: pa.Array) -> pa.Array:
        return pa.array(
            [list(_packable(t, (), target)) if t and t.strip() else [] for t in texts.to_pylist()], _UNITS_ARROW
        )

    spark.udf.register("note_units", sql_units)
    spark.udf.register("casefold", casefold)
    spark.udf.register("nfkc_squash", nfkc_squash)


