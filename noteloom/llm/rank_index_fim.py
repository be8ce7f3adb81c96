"""Fill-in-middle examples whose cuts come from a learned rank index over line boundaries.

A text of n lines has the boundary offsets 0 to its length, ranked 0 to n. Segments of a
piecewise-linear function are fitted to all of them with a bounded error: a cone of slopes
through the first point of a segment is narrowed by every further point, and a new segment
starts when it closes. Each boundary keeps its residual, one byte, so a cut is looked up by
predicting its offset and adding the residual, which gives it exactly. Where prefix and middle
end is drawn from a hash of the document's id, so an example can be made again at any time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from noteloom.llm.common import byte_slices

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

#: How far a prediction may lie from its boundary, in code points; with rounding a residual fits in one byte.
MAX_ERROR = 120


@dataclass(frozen=True)
class RankIndex:
    """Segments (first rank, offset there, slope) and the residual of every boundary."""

    ranks: list[int]
    starts: list[int]
    slopes: list[float]
    residuals: np.ndarray

    def predict(self, rank: int) -> int:
        i = bisect_right(self.ranks, rank) - 1
        return self.starts[i] + round(self.slopes[i] * (rank - self.ranks[i]))

    def offset(self, rank: int) -> int:
        return self.predict(rank) + int(self.residuals[rank])


def fit(offsets: list[int], max_error: int = MAX_ERROR) -> RankIndex:
    """The index of ascending offsets: every prediction errs by at most ``max_error``, up to rounding."""
    ranks, starts, slopes = [], [], []
    first = 0
    while first < len(offsets):
        base = offsets[first]
        low, high = 0.0, float("inf")
        end = first + 1
        while end < len(offsets):
            steps, rise = end - first, offsets[end] - base
            lower, upper = max(low, (rise - max_error) / steps), min(high, (rise + max_error) / steps)
            if lower > upper:
                break
            low, high = lower, upper
            end += 1
        ranks.append(first)
        starts.append(base)
        slopes.append((low + high) / 2 if end > first + 1 else 0.0)
        first = end
    index = RankIndex(ranks, starts, slopes, np.zeros(len(offsets), dtype=np.int8 if max_error < 127 else np.int64))
    index.residuals[:] = [offset - index.predict(rank) for rank, offset in enumerate(offsets)]
    return index


def boundaries(text: str) -> list[int]:
    """The offsets at which the lines of a text end, after 0; a line keeps its line feed."""
    found, at = [0], text.find("\n")
    while at >= 0:
        found.append(at + 1)
        at = text.find("\n", at + 1)
    if found[-1] < len(text):
        found.append(len(text))
    return found


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the id's text, a null id counting as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    return a, b, c, d


@dataclass(frozen=True)
class Example:
    """A transformed text; ``prefix_chars`` and ``middle_chars`` are None if the form is plain."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform(doc_id: object, text: str, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> Example:
    """The example of one text: cut at two of its line boundaries and put in order of its form."""
    ends = boundaries(text)
    n = len(ends) - 1
    one, two, chance, order = draws(doc_id, seed)
    if not text or any(mark in text for mark in MARKS) or chance % 100 >= fim_percent:
        return Example(n, "plain", None, None, text)
    index = fit(ends)
    first, second = (index.offset(rank) for rank in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if order % 100 < spm_percent:
        return Example(n, "spm", len(prefix), len(middle), "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Example(n, "psm", len(prefix), len(middle), "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def restore(output: str, form: str) -> str:
    """The text that an output was made from. No part holds a mark, so each is found once."""
    if form == "plain":
        return output
    opening, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, middle_at = output.index(between, len(opening)), output.index(MIDDLE)
    one, other = output[len(opening) : at], output[at + len(between) : middle_at]
    middle = output[middle_at + len(MIDDLE) :]
    return one + middle + other if form == "psm" else other + middle + one


def _per_text(docs: DataFrame, id_col: str, text_col: str, columns: str, row: Callable[[object, str], tuple]) -> DataFrame:
    """``row(id, text)`` for every document where it is read, in slices of bounded size."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                made = [row(i.as_py(), t.as_py() or "") for i, t in zip(part.column("doc_id"), part.column("text"), strict=True)]
                filled = [pa.array([r[k] for r in made], f.type) for k, f in enumerate(list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(arrow[0].type), *filled], schema=arrow)

    return keyed.mapInArrow(work, schema)


def rank_indexes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of every text: doc_id, n lines, segments (first_rank, start, slope), residuals (a byte each).

    ``boundary_offset`` looks a boundary up in these columns.
    """
    def row(_, text: str) -> tuple:
        index = fit(boundaries(text))
        segments = [{"first_rank": r, "start": s, "slope": p} for r, s, p in zip(index.ranks, index.starts, index.slopes, strict=True)]
        return len(index.residuals) - 1, segments, index.residuals.tobytes()

    return _per_text(
        docs, id_col, text_col,
        "n bigint, segments array<struct<first_rank: bigint, start: bigint, slope: double>>, residuals binary", row)


def boundary_offset(segments, residuals, rank):
    """The offset of a boundary as an expression over the columns of ``rank_indexes``."""
    segment = F.element_at(F.filter(segments, lambda s: s.first_rank <= rank), -1)
    byte = F.conv(F.hex(F.substring(residuals, (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    residual = F.when(byte > 127, byte - 256).otherwise(byte)
    return segment.start + F.rint(segment.slope * (rank - segment.first_rank)).cast("bigint") + residual


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
) -> DataFrame:
    """A training example of every text: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` is the number of lines. The form is ``psm`` or ``spm``, drawn by the id, or ``plain``
    (text unchanged, both lengths null) if the text is empty or null, holds one of the marks,
    or falls outside ``fim_percent``. A null id draws as an empty one; equal ids draw equally
    and repeated rows give repeated results; other columns are not looked at; an empty table
    gives an empty one. Work and memory are linear in the text, and nothing is shuffled.
    """
    def row(doc_id: object, text: str) -> tuple:
        made = transform(doc_id, text, seed, fim_percent, spm_percent)
        return made.n, made.form, made.prefix_chars, made.middle_chars, made.output

    return _per_text(
        docs, id_col, text_col, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", row)


def restored(examples: DataFrame) -> DataFrame:
    """``examples`` with the source text rebuilt from output and form alone, as ``text``."""
    columns = [F.col(c) for c in examples.columns]
    mark = {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}
    output = F.col("output")

    def parts(form: str):
        opening, between = mark[form]
        body = F.substr(output, F.lit(len(opening) + 1))
        one, rest = F.substring_index(body, between, 1), F.substr(body, F.locate(between, body) + len(between))
        other, middle = F.substring_index(rest, MIDDLE, 1), F.substr(rest, F.locate(MIDDLE, rest) + len(MIDDLE))
        return F.concat(one, middle, other) if form == "psm" else F.concat(other, middle, one)

    text = F.when(F.col("form") == "plain", output).when(F.col("form") == "psm", parts("psm")).otherwise(parts("spm"))
    return examples.select(*columns, text.alias("text"))


def fill_in_middle_digests(docs: DataFrame, **options) -> DataFrame:
    """``fill_in_middle`` with output and rebuilt text as SHA-256 (lower-case hex, UTF-8) instead of texts."""
    whole = restored(fill_in_middle(docs, **options))
    return whole.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
