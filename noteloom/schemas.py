"""Table schemas as ``StructType`` constants, and the check that a table keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_L, _I, _S, _D, _B, _TS = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
_VECTOR = T.ArrayType(_D, False)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


APP_METADATA = _struct(("key", _S, False), ("value", _S, False))

KNOWLEDGE_BASES = _struct(
    ("kb_id", _L, False), ("name", _S, False), ("description", _S, True),
    ("created_at", _TS, False), ("updated_at", _TS, False),
)

SOURCE_RECORD = _struct(
    ("path", _S, False), ("content_hash", _S, False), ("char_count", _L, False),
    ("size", _L, False), ("mtime_ns", _L, False),
)

DOCUMENTS = _struct(
    ("doc_id", _L, False), ("kb_id", _L, False), ("title", _S, False), ("file_path", _S, False),
    ("content_hash", _S, False), ("ingest_version", _L, False), ("pending_file_path", _S, True),
    ("pending_content_hash", _S, True), ("pending_char_count", _L, True), ("status", _S, False),
    ("last_error_code", _S, True), ("last_error_message", _S, True), ("char_count", _L, False),
    ("chunk_count", _L, False), ("processed_at", _TS, True), ("created_at", _TS, False),
    ("updated_at", _TS, False),
)

INGEST_TASKS = _struct(
    ("doc_id", _L, False), ("ingest_version", _L, False), ("candidate_path", _S, True),
    ("status", _S, False), ("stage", _S, False), ("attempt_count", _L, False),
    ("recovery_count", _L, False), ("last_error_code", _S, True), ("started_at", _TS, True),
    ("finished_at", _TS, True), ("created_at", _TS, False), ("updated_at", _TS, False),
)

CHUNKS = _struct(
    ("chunk_id", _L, False), ("doc_id", _L, False), ("kb_id", _L, False), ("chunk_index", _L, False),
    ("content", _S, False), ("char_start", _L, False), ("char_end", _L, False),
    ("embedding", _VECTOR, True), ("created_at", _TS, True),
)

CATALOG_DOCUMENTS = _struct(
    ("doc_id", _L, False), ("kb_id", _L, False), ("title", _S, False), ("ingest_version", _L, False),
    ("active", SOURCE_RECORD, False), ("pending", SOURCE_RECORD, True),
    ("created_at", _TS, False), ("updated_at", _TS, False),
)

QUESTION_MANIFEST = _struct(
    ("version", _I, False),
    ("description", _S, True),
    ("libraries", T.ArrayType(_struct(("key", _S, True), ("name", _S, True), ("notes_dir", _S, True))), True),
    ("items", T.ArrayType(_struct(
        ("question", _S, True), ("expected_doc", _S, True), ("expected_keywords", T.ArrayType(_S), True),
        ("in_kb", _B, True), ("library", _S, True), ("difficulty", _S, True),
    )), True),
)

ASSET = _struct(
    ("source_path", _S, True), ("stored_path", _S, True), ("content_hash", _S, True),
    ("mime_type", _S, True), ("file_size", _L, True), ("width", _L, True), ("height", _L, True),
)
OCCURRENCE = _struct(
    ("ordinal", _L, True), ("source_reference", _S, True), ("asset_source_path", _S, True),
    ("alt_text", _S, True), ("char_start", _L, True), ("char_end", _L, True),
)
PACKAGE_MANIFEST = _struct(
    ("kb_id", _L, True), ("doc_id", _L, True), ("version", _L, True), ("package_hash", _S, True),
    ("source_path", _S, True), ("source_archive_path", _S, True), ("source_sha256", _S, True),
    ("source_char_count", _L, True), ("assets", T.ArrayType(ASSET), True),
    ("occurrences", T.ArrayType(OCCURRENCE), True),
)

TABLES = {
    "app_metadata": APP_METADATA,
    "knowledge_bases": KNOWLEDGE_BASES,
    "documents": DOCUMENTS,
    "ingest_tasks": INGEST_TASKS,
    "chunks": CHUNKS,
}


class SchemaMismatch(ValueError):
    """A table does not have exactly the registered columns."""


def require_schema(df: DataFrame, expected: T.StructType, name: str = "table") -> DataFrame:
    """Return ``df`` if it has the registered columns and types, and no others."""
    want = {f.name: f.dataType.simpleString() for f in expected}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    missing = sorted(want.keys() - have.keys())
    extra = sorted(have.keys() - want.keys())
    wrong = sorted(c for c in want.keys() & have.keys() if want[c] != have[c])
    if missing or extra or wrong:
        raise SchemaMismatch(f"{name}: missing={missing} extra={extra} wrong type={wrong}")
    return df
