"""Where a note may be cut: sections, blocks and sentences of one text.

Offsets are code points. A text is described by a mask of its protected characters: fenced
code, display formulas, tables, inline code, formulas, links and images. Whole-line structures
come from columns over the table of its lines (what opens, what closes, what has bars), and
all cuts are arrays of candidate positions from which the mask strikes some.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np

# Patterns and characters that decide where a text may be cut.
HEADING = re.compile(r"^ {0,3}#{1,6}[ \t]+")
LIST_ITEM = re.compile(r"^\s*(?:[-+*]|\d+[.)])[ \t]+")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")
FORMULA_ENDS = {"$$": "$$", "\\[": "\\]"}
INLINE = (
    re.compile(r"(`+)[\s\S]*?\1"),
    re.compile(r"\$\$[\s\S]*?\$\$"),
    re.compile(r"(?<!\\)\$[^\n$]+\$"),
    re.compile(r"!?\[[^\]\n]*\]\([^\n]*?\)"),
)
BLOCK_CUT = re.compile(
    r"\r?\n[ \t]*\r?\n|^ {0,3}#{1,6}[^\r\n]*\r?\n|^(?=[ \t]*(?:[-+*]|\d+[.)])[ \t]+)", re.M
)
TERMINATORS = "。！？!?"
TRAILERS = "。！？!?\"”’」』）)]】"
BRACKETS = {"（": "）", "(": ")", "[": "]", "【": "】", "“": "”", "‘": "’", "「": "」", "『": "』"}
SHORT_WORD = re.compile(r"(?:[A-Za-z]\.)*[A-Za-z]{1,3}")

_HEADING_LINE = re.compile(HEADING.pattern, re.M)
_EVENTS = re.compile("[" + re.escape(TERMINATORS + '."' + "".join(BRACKETS) + "".join(BRACKETS.values())) + "]")
_CLOSING_MARKS = re.compile("[" + re.escape(TRAILERS) + "]*")
_LAST_WORD = re.compile(r"\S*\Z")
_BLANKS = re.compile(r"\s*")


class Unit(NamedTuple):
    start: int
    end: int
    prose: bool


class Lines:
    """A text as a table of lines: their bounds, and what each opens, closes or has."""

    def __init__(self, text: str):
        self.rows = text.splitlines(keepends=True)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in self.rows], dtype=np.int64)])

    def fences(self) -> Iterator[tuple[int, int]]:
        """First and last line of each structure that a line opens and a later line closes.

        Closing lines are listed by their sign and searched by line number; without one, the
        structure reaches to the end.
        """
        closing: dict[str, list[tuple[int, int]]] = {}
        for n, row in enumerate(self.rows):
            sign = row.strip()
            if sign in FORMULA_ENDS.values():
                closing.setdefault(sign, []).append((n, 1))
            elif sign[:1] in ("`", "~") and sign == sign[0] * len(sign):
                closing.setdefault(sign[0], []).append((n, len(sign)))
        free = 0
        for n, row in enumerate(self.rows):
            fence = FENCE.match(row)
            sign, least = (fence[1][0], len(fence[1])) if fence else (FORMULA_ENDS.get(row.strip()), 1)
            if sign is None or n < free:
                continue
            last = min((m for m, size in closing.get(sign, ()) if m > n and size >= least), default=len(self.rows) - 1)
            free = last + 1
            yield n, last

    def tables(self) -> Iterator[tuple[int, int]]:
        """First and last line of each table: a header with bars, a rule, and rows with bars."""
        bars = np.array(["|" in r for r in self.rows], dtype=bool)
        stops = np.append(np.flatnonzero(~bars), len(self.rows))
        for rule in np.flatnonzero([bool(TABLE_RULE.match(r)) for r in self.rows]):
            if rule and bars[rule - 1]:
                yield int(rule) - 1, int(stops[np.searchsorted(stops, rule + 1)]) - 1

    def spans(self) -> Iterator[tuple[int, int]]:
        for first, last in (*self.fences(), *self.tables()):
            yield int(self.bounds[first]), int(self.bounds[last + 1])


class Guard:
    """Protected characters of a text, and the runs they form."""

    def __init__(self, text: str, extra: Iterable[tuple[int, int]] = ()):
        self.text = text
        inline = (m.span() for pattern in INLINE for m in pattern.finditer(text))
        ends = np.zeros(len(text) + 2, dtype=np.int64)
        for start, end in (*extra, *Lines(text).spans(), *inline):
            ends[start] += 1
            ends[end] -= 1
        self.flags = np.cumsum(ends[:-1]) > 0
        self.starts = np.flatnonzero(np.diff(self.flags, prepend=False) & self.flags)
        self.ends = np.flatnonzero(np.diff(self.flags, prepend=False) & ~self.flags)

    def holds(self, position: int) -> bool:
        return bool(self.flags[position])

    def splits(self, position: int) -> bool:
        """A cut here would fall inside a run."""
        return bool(self.inside(np.array([position]))[0])

    def inside(self, positions: np.ndarray) -> np.ndarray:
        """Which positions have protected characters on both sides."""
        return (positions > 0) & self.flags[np.maximum(positions, 1) - 1] & self.flags[positions]

    def encloses(self, start: int, end: int) -> bool:
        return bool(self.flags[start:end].all())

    def line_runs(self, start: int, end: int) -> np.ndarray:
        """Edges of the runs in a stretch that begin and end with a line."""
        a, b = np.searchsorted(self.starts, start), np.searchsorted(self.ends, end, side="right")
        runs = [
            (s, e) for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=False)
            if (s == 0 or self.text[s - 1] == "\n") and (e == len(self.text) or self.text[e - 1] == "\n")]
        return np.array(runs, dtype=np.int64).ravel()


def section_spans(text: str, guard: Guard) -> list[tuple[int, int]]:
    """From heading to heading; blank lines before the first heading belong to it."""
    heads = [m.start() for m in _HEADING_LINE.finditer(text) if not guard.holds(m.start())]
    if heads and not text[: heads[0]].strip():
        heads[0] = 0
    starts = sorted({0, *heads})
    return [(a, b) for a, b in zip(starts, [*starts[1:], len(text)]) if a < b]


def block_units(text: str, start: int, end: int, guard: Guard) -> list[Unit]:
    """Blocks of a section, cut at blank lines, after headings and before list items."""
    found = np.fromiter((start + m.end() for m in BLOCK_CUT.finditer(text[start:end])), dtype=np.int64)
    edges = np.unique(np.concatenate([[start, end], found[~guard.inside(found)], guard.line_runs(start, end)]))
    return [Unit(a, b, not guard.encloses(a, b)) for a, b in pairwise(edges.tolist())]


def sentence_units(text: str, start: int, end: int, guard: Guard) -> list[Unit]:
    """Complete sentences of a block; open quotes and brackets hold a sentence together."""
    events = np.fromiter((m.start() for m in _EVENTS.finditer(text, start, end)), dtype=np.int64)
    cuts, awaited = [start], ""
    for place in events[~guard.flags[events]].tolist():
        if place < cuts[-1]:  # among the closing marks of the last sentence
            continue
        awaited = _awaited(awaited, text, place)
        if text[place] in TERMINATORS or text[place] == "." and _ends_word(text, cuts[-1], place, end):
            marks = _closing_marks(text, place + 1, end, guard)
            if not _settled(awaited, marks):
                cuts.append(_BLANKS.match(text, place + 1 + len(marks), end).end())
                awaited = ""
    return [Unit(a, b, True) for a, b in pairwise([*cuts, end]) if a < b]


def _awaited(awaited: str, text: str, place: int) -> str:
    """The closing signs still awaited after the sign at ``place``, innermost last."""
    sign = text[place]
    if awaited.endswith(sign):
        return awaited[:-1]
    if sign == '"':
        return awaited if place and text[place - 1] == "\\" else awaited + sign
    return awaited + BRACKETS.get(sign, "")


def _settled(awaited: str, marks: str) -> str:
    """What is still awaited after some closing marks."""
    for sign in marks:
        awaited = awaited.removesuffix(sign)
    return awaited


def _closing_marks(text: str, at: int, end: int, guard: Guard) -> str:
    """The run of closing marks at a place, up to the first protected one."""
    marks = _CLOSING_MARKS.match(text, at, end)[0]
    held = np.flatnonzero(guard.flags[at:at + len(marks)])
    return marks[:held[0]] if len(held) else marks


def _ends_word(text: str, begin: int, dot: int, end: int) -> bool:
    """White space or the end follows, and what the dot ends is no short word and no URL."""
    word = _LAST_WORD.search(text, max(begin, text.rfind("\n", begin, dot)), dot)[0]
    follows = text[dot + 1 : min(dot + 2, end)]
    return not follows.strip() and "://" not in word and not SHORT_WORD.fullmatch(word)


def _units(text: str, start: int, end: int, guard: Guard, whole: Callable[[Unit, str], object]) -> list[Unit]:
    """Blocks of a section; a prose block that is not to stay ``whole`` gives its sentences."""
    return [
        unit for block in block_units(text, start, end, guard)
        for unit in ([block] if not block.prose or whole(block, text[block.start : block.end]) else sentence_units(text, block.start, block.end, guard))]


def pack_units(text: str, start: int, end: int, guard: Guard, target: int) -> list[Unit]:
    """Blocks, with prose blocks above the target cut into sentences."""
    return _units(text, start, end, guard, lambda b, body: b.end - b.start <= target or LIST_ITEM.match(body))


def reading_units(text: str, start: int, end: int, guard: Guard) -> list[Unit]:
    """Sentences, with structure, headings and list items kept whole."""
    return _units(text, start, end, guard, lambda _, body: HEADING.match(body) or LIST_ITEM.match(body))


def check_spans(text: str, spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Protected spans given by the caller, sorted: inside the text, not empty and apart."""
    table = np.array(sorted(spans), dtype=np.int64).reshape(-1, 2)
    edges = np.concatenate([[0], table.ravel(), [len(text)]])
    if (np.diff(edges) < 0).any() or (table[:, 0] == table[:, 1]).any():
        raise ValueError("spans to protect overlap, are empty or leave the text")
    return [(int(a), int(b)) for a, b in table]
