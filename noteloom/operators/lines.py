"""Lines of a document as chunks: the simplest split that keeps source offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.binding import let

#: A line id holds the document id above so many bits of the line number.
LINE_ID_BITS = 27


def line_id(doc_id: Column, line: Column) -> Column:
    """One number for a document and a line; an error, never a collision, where they do not fit.

    Ids below 2^36 and lines below 2^27 fit; a text of the intake limit has fewer lines.
    """
    fits = doc_id.between(0, (1 << 63 - LINE_ID_BITS) - 1) & line.between(0, (1 << LINE_ID_BITS) - 1)
    packed = F.shiftleft(doc_id.cast("bigint"), LINE_ID_BITS).bitwiseOR(line.cast("bigint"))
    return F.when(doc_id.isNull() | fits, packed).otherwise(F.raise_error(F.lit("document id or line number too large for a line id")))


def line_chunks(documents: DataFrame, *carry: str) -> DataFrame:
    """One row per line: (doc_id, carry..., chunk_id, chunk_index, content).

    ``chunk_id`` joins the document id and the line number, so it needs no shuffle.
    """
    # The outer form keeps the optimizer from splitting every text twice.
    return documents.filter(F.col("text").isNotNull()).select(
        "doc_id", *carry, F.posexplode_outer(F.split("text", "\n")).alias("chunk_index", "content")
    ).select(
        line_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", *carry, F.col("chunk_index").cast("bigint").alias("chunk_index"), "content",
    )


def line_spans(text: Column) -> Column:
    """Lines with their code point offsets, newline included: array of (start, end, content).

    The spans cover the text without gaps.
    """
    pieces = let(
        F.split(text, "\n"),
        lambda lines: F.transform(
            lines, lambda line, i: F.when(i < F.size(lines) - 1, F.concat(line, F.lit("\n"))).otherwise(line)
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,content:string>>")
    start = F.struct(empty.alias("spans"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("start"), end.alias("end"), piece.alias("content"))
        return F.struct(F.array_append(state["spans"], span).alias("spans"), end.alias("at"))

    return F.filter(F.aggregate(pieces, start, step)["spans"], lambda s: s["end"] > s["start"])


def spanned_lines(documents: DataFrame, *carry: str) -> DataFrame:
    """Lines with offsets: (chunk_id, doc_id, carry..., chunk_index, content, char_start, char_end)."""
    return documents.select(
        "doc_id", *carry, F.posexplode_outer(line_spans(F.col("text"))).alias("chunk_index", "s")
    ).filter(F.col("chunk_index").isNotNull()).select(
        line_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", *carry, F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("s.content").alias("content"),
        F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"),
    )
