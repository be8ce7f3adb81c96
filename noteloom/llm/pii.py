"""Personal data in disguise, found in a normalised text and mapped back to the source.

Two transducers normalise a text: one replaces look-alike characters one for one, the other
rewrites disguised signs (``[at]``, `` dot ``), spelled digits and invisible characters, and
keeps the source range of everything it rewrites. The detectors run over the source, whose
findings always stay, and over the normalised text, whose findings are mapped back to source
ranges and added, also where they overlap one of the source's own: that may be the plain
remainder of a disguised identifier. Only what a finding of the same kind covers is left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_slices

KINDS = ("email", "ip", "card", "phone")

# The detectors' patterns and limits.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_DIGITS = range(14, 20)
_PHONE_DIGITS = range(10, 16)

# Letters of other scripts that look like Latin ones, and spelled digits.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ı": "i", "‐": "-", "‑": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}

#: Letters beyond ASCII that a pattern which ignores case takes for i and s.
_CASE_FORMS = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})

_DIGIT = "|".join(DIGIT_WORDS)
_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,2}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_DOT = rf"(?:[ \t]{{1,3}}dot[ \t]{{1,3}}|{_OPEN}dot{_CLOSE})"
_DISGUISE = re.compile(
    rf"(?P<at>(?<=[A-Za-z0-9]){_OPEN}at{_CLOSE}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]{{1,3}}at[ \t]{{1,3}}(?={_LABEL}{_DOT}[A-Za-z0-9]))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<digits>\b(?:{_DIGIT})(?:[ \t-]{{1,2}}(?:{_DIGIT}))*\b)"
    rf"|(?P<plus>\bplus[ \t]{{1,2}}(?=[0-9]|(?:{_DIGIT})\b))"
    rf"|(?P<hidden>[\u200b-\u200d\u2060\ufeff\xad]+)", re.IGNORECASE)


def _compatible(ranges: tuple[tuple[int, int], ...]) -> dict[int, str]:
    """Characters of the ranges whose compatibility form is one printable ASCII character."""
    forms = ((c, unicodedata.normalize("NFKC", chr(c))) for a, b in ranges for c in range(a, b))
    return {c: f for c, f in forms if len(f) == 1 and "!" <= f <= "~"}


#: Full-width forms, mathematical letters and digits, circled and raised digits, by rule; the rest by the list.
_FOLD = _compatible(((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EA), (0x2070, 0x208A))) | {ord(a): b for a, b in LOOKALIKES.items()}
_FOLDABLE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_FOLD)) + "]")


#: What a text must hold for any search to find something, in the syntax of Arrow's matcher.
_WORTH_A_LOOK = (
    r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){13}|\+[0-9]"
    rf"|(?i:\b(?:dot|plus|{_DIGIT})\b|[\[({{<][ \t]?[ \t]?at[ \t\])}}>])"
    r"|[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}" + "".join(f"\\x{{{c:X}}}" for c in sorted(_FOLD)) + "]")


def worth_a_look(texts: pa.Array) -> list[bool | None]:
    """Whether each text can hold an identifier at all, plain or disguised."""
    return pc.match_substring_regex(texts, _WORTH_A_LOOK).to_pylist()


@dataclass(frozen=True, order=True)
class Span:
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ sign outwards, so that no run is walked twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        elif start == at:
            free = at + 1
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))


def detect(text: str) -> list[Span]:
    """The spans of each kind in a text, as it stands."""
    spans = [Span(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        spans += [Span(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= _CARD_DIGITS.start:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) in _CARD_DIGITS and luhn(digits):
                spans.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        spans += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if sum(map(str.isdigit, m[0])) in _PHONE_DIGITS]
    return sorted(spans)


@dataclass
class Rewritten:
    """A normalised text; for each of its pieces the place in it, the source range, and if it was copied."""

    parts: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    source: list[tuple[int, int, bool]] = field(default_factory=list)
    length: int = 0

    def add(self, part: str, start: int, end: int, copied: bool) -> None:
        if part:
            self.at.append(self.length)
            self.source.append((start, end, copied))
            self.parts.append(part)
            self.length += len(part)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source range of a range of the normalised text."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, _, copied), (c, d, also) = self.source[i], self.source[j]
        return a + (start - self.at[i]) * copied, c + end - self.at[j] if also else d


def normalise(text: str) -> Rewritten | None:
    """The text in plain signs, or None if it holds no disguise."""
    folded = text
    if not text.isascii() and _FOLDABLE.search(text):
        folded = text.translate(_FOLD)
    out, done = Rewritten(), 0
    for m in _DISGUISE.finditer(folded):
        out.add(folded[done:m.start()], done, m.start(), True)
        if m.lastgroup == "digits":
            at = m.start()
            for word in re.finditer(_DIGIT, m[0], re.IGNORECASE):
                out.add(DIGIT_WORDS[word[0].translate(_CASE_FORMS).lower()], at + word.start(), at + word.end(), False)
        else:
            out.add({"at": "@", "dot": ".", "plus": "+", "hidden": ""}[m.lastgroup], m.start(), m.end(), False)
        done = m.end()
    if not done and folded is text:
        return None
    out.add(folded[done:], done, len(folded), True)
    return out


def _disguised(text: str, base: list[Span]) -> set[Span]:
    """The spans that the normalised text adds: all that no span of ``base`` of the same kind covers."""
    normal = normalise(text)
    if normal is None:
        return set()
    covers: list[list[Span]] = [[] for _ in KINDS]
    for span in base:  # those of one kind do not overlap
        covers[span.kind].append(span)
    starts = [[s.start for s in spans] for spans in covers]
    added = set()
    for span in detect("".join(normal.parts)):
        a, b = normal.back(span.start, span.end)
        before = bisect_right(starts[span.kind], a)
        if not before or covers[span.kind][before - 1].end < b:
            added.add(Span(a, span.kind, b))
    return added


def whole_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text as it stands, and these with all disguised ones, which may overlap them."""
    base = detect(text)
    return base, sorted({*base, *_disguised(text, base)})


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text as it stands, and these with the disguised ones that stand apart from them."""
    base = detect(text)
    taken = sorted((s.start, s.end) for s in base)
    ends = list(accumulate((e for _, e in taken), max))
    starts = [s for s, _ in taken]
    apart = []
    for span in _disguised(text, base):
        before = bisect_right(starts, span.end - 1)
        if not before or ends[before - 1] <= span.start:
            apart.append(span)
    return base, sorted(base + apart)


def _joined(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (all spans of the kind, disguised ones
    too, also if they overlap a plain one), base_sha256 (of the spans of the text as it stands) and spans (all, as
    kind:start:end in code points, end exclusive, by start and then kind). A null text is
    treated as empty and has no spans; repeated rows give repeated results; other columns are
    not looked at. Each text is searched where it is read, without a shuffle.
    """
    rows, id_type = _keyed(docs, id_col, text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = part.column("text")
                found = [whole_spans(t.as_py()) if look else ([], []) for t, look in zip(texts, worth_a_look(texts), strict=True)]
                counts = [pa.array([sum(s.kind == k for s in every) for _, every in found], pa.int64()) for k in range(len(KINDS))]
                base = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
                spans = pa.array([_joined(every) for _, every in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, base, spans],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(
        search, f"doc_id {id_type}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are masked as one."""
    out, done, open_kind, open_end = [], 0, None, 0
    for span in whole_spans(text)[1]:
        if open_kind is not None and span.start < open_end:
            open_end = max(open_end, span.end)
            continue
        if open_kind is not None:
            out.append(f"[{KINDS[open_kind].upper()}]")
            done = open_end
        out.append(text[done:span.start])
        open_kind, open_end = span.kind, span.end
    if open_kind is None:
        return text
    return "".join([*out, f"[{KINDS[open_kind].upper()}]", text[open_end:]])


def _replaced(column: pa.Array, places: list[int], values: list) -> pa.Array:
    mask = np.zeros(len(column), dtype=bool)
    mask[places] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(values, column.type))


def mask_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the personal data of each text masked, and its length in code points corrected.

    A null text, or one in which nothing is searched, keeps its length as given. All columns stay
    in place, whatever their names.
    """
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col):
                look = [i for i, x in enumerate(worth_a_look(part.column(at))) if x]
                if look:
                    new = [masked(part.column(at)[i].as_py()) for i in look]
                    columns = list(part.columns)
                    columns[at] = _replaced(columns[at], look, new)
                    if chars is not None:
                        columns[chars] = _replaced(columns[chars], look, [len(t) for t in new])
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(mask, docs.schema)
