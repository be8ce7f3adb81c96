"""The intake gate: which files become documents, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions.texts import nfc

PLAIN_EXTENSIONS = ("md", "txt")


def base_name(path: Column) -> Column:
    """The last part of a path in either slash style."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)


def reject_reason(
    title: Column, content: Column, max_bytes: int = S.MAX_UPLOAD_BYTES,
    extensions: tuple[str, ...] = PLAIN_EXTENSIONS,
) -> Column:
    """The first rule a file breaks, or null. ``content`` is binary."""
    suffix = F.lower(F.regexp_extract(title, r"(?s).\.([^.]*)$", 1))
    blank = F.octet_length(F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[ \t\n\x0B\f\r]+", "")) == 0
    text = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    return (
        F.when((title == "") | title.isin(".", "..") | title.rlike(r"[\x00-\x1f]"), "bad_name")
        .when(F.length(title) > S.MAX_TITLE_CHARS, "name_too_long")
        .when(~suffix.isin(*extensions), "unsupported_type")
        .when(F.octet_length(content) > max_bytes, "too_large")
        .when(blank, "empty")
        .when(~F.is_valid_utf8(content.cast("string")), "not_utf8")
        .when(text.contains("\0"), "nul")
    )


def intake(files: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES) -> DataFrame:
    """Files (path, content binary, ...) with title, reason, text, hash and length.

    ``reason`` is null for accepted files; ``text`` is null for rejected ones. No newline
    is translated: offsets in the text are offsets in the file.
    """
    named = files.withColumn("title", nfc(base_name(F.col("path"))))
    judged = named.withColumn("reason", reject_reason(F.col("title"), F.col("content"), max_bytes))
    text = F.when(F.col("reason").isNull(), F.decode(F.col("content"), "UTF-8"))
    return judged.withColumns({
        "text": text,
        "content_hash": F.when(F.col("reason").isNull(), F.sha2("content", 256)),
        "char_count": F.length(text).cast("bigint"),
    })
