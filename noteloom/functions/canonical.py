"""Canonical JSON, fingerprints and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with the keys in alphabetical order; null values are kept."""
    fields = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def fingerprint(**columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the given columns."""
    return F.sha2(canonical_json(**columns), 256)


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def _clean_parts(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))


def is_relative_source_path(path: Column, max_chars: int = 500) -> Column:
    """Canonical relative path of a source: no drive, no back slash, no dot parts."""
    ok = (
        F.length(path).between(1, max_chars)
        & ~path.contains("\\") & ~path.contains(":") & ~path.contains("\0")
        & _clean_parts(path)
    )
    return F.coalesce(ok, F.lit(False))


def is_archive_path(path: Column, composed: Column, max_bytes: int = 1024) -> Column:
    """Canonical relative path inside a package.

    ``composed`` is the NFC form of ``path`` (see :func:`noteloom.functions.texts.nfc`).
    """
    ok = (
        (path != "") & ~path.contains("\0") & ~path.contains("\\") & path.eqNullSafe(composed)
        & (F.octet_length(path) <= max_bytes)
        & ~path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
        & _clean_parts(path)
    )
    return F.coalesce(ok, F.lit(False))


def normalised_join(base_file: Column, reference: Column) -> Column:
    """Resolve ``reference`` against the folder of ``base_file``; null when it escapes the root."""
    folder = F.regexp_replace(base_file, r"[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, reference), "/"), lambda p: ~p.isin("", "."))
    # Each step keeps the resolved parts so far and whether the root was left.
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("outside"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        empty = F.size(state["kept"]) == 0
        kept = (
            F.when(up & empty, state["kept"])
            .when(up, F.slice(state["kept"], F.lit(1), F.greatest(F.size(state["kept"]) - 1, F.lit(0))))
            .otherwise(F.array_append(state["kept"], part))
        )
        return F.struct(kept.alias("kept"), (state["outside"] | (up & empty)).alias("outside"))

    end = F.aggregate(parts, start, step)
    return F.when(~end["outside"] & (F.size(end["kept"]) > 0), F.array_join(end["kept"], "/"))
