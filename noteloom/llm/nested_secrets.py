"""Secrets in a text and in everything that is encoded inside it, with the source range of each.

A worklist starts with the text. Every layer on it is scanned as it stands and then unwrapped in
all ways that apply: URL escapes, Unicode escapes and character references, compatibility
characters, base64 runs, compressed streams inside them. What comes out is a further layer that
knows where its characters lie in the layer it came from, so that a finding is mapped back step
by step to the source. A layer that repeats one of those it lies in, or one already seen at the
same place, is not put on the list again; the list is empty at the fixpoint.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_slices

KINDS = ("assign", "access", "hex")

# The detectors' patterns and least lengths.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_VALUE = 8
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: What a text must hold for any search to find something, in the syntax of Arrow's matcher.
_WORTH_A_LOOK = (
    r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-fu]|\\[uUx0-7]|&(?:#|quot|apos|amp|lt|gt)"
    r"|[A-Za-z0-9+/_-]{16}|[^\x00-\x7F\x{A0}-\x{24F}]|\x{AD}")


def worth_a_look(texts: pa.Array) -> list[bool | None]:
    """Whether each text can hold a secret at all, plain or encoded."""
    return pc.match_substring_regex(texts, _WORTH_A_LOOK).to_pylist()


@dataclass(frozen=True, order=True)
class Span:
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def detect(text: str) -> list[Span]:
    """The spans of each kind in a text as it stands, by start and kind."""
    spans = []
    lowered = text.lower() if any(c in text for c in ":=") else ""
    if lowered and any(w in lowered for w in _WORDS):
        spans += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


# --- layers -----------------------------------------------------------------------------------


@dataclass
class Layer:
    """A text, the layer it was unwrapped from, and how its ranges map to that layer's."""

    text: str
    parent: Layer | None = None
    outward: Callable[[int, int], tuple[int, int]] | None = None

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The range of the source text that a range of this layer comes from."""
        layer = self
        while layer.parent is not None:
            start, end = layer.outward(start, end)
            layer = layer.parent
        return start, end

    @property
    def digest(self) -> bytes:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@dataclass
class Rewriter:
    """A text made from pieces of another: copied as they are, or put in place of a range."""

    source: str
    parts: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    ranges: list[tuple[int, int, bool]] = field(default_factory=list)
    length: int = 0
    done: int = 0

    def _add(self, part: str, start: int, end: int, copied: bool) -> None:
        if part:
            self.places.append(self.length)
            self.ranges.append((start, end, copied))
            self.parts.append(part)
            self.length += len(part)

    def replace(self, start: int, end: int, part: str) -> None:
        self._add(self.source[self.done : start], self.done, start, True)
        self._add(part, start, end, False)
        self.done = end

    def layer(self, parent: Layer) -> Layer | None:
        """The rewritten layer, or None if nothing was replaced."""
        if not self.done:
            return None
        self._add(self.source[self.done :], self.done, len(self.source), True)
        return Layer("".join(self.parts), parent, self.outward)

    def outward(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.places, start) - 1, bisect_right(self.places, max(start, end - 1)) - 1
        (a, _, copied), (c, d, also) = self.ranges[i], self.ranges[j]
        return a + (start - self.places[i]) * copied, c + end - self.places[j] if also else d


# --- escapes: the whole layer is rewritten ------------------------------------------------------

# ``%`` itself may be escaped many times over; ``%2525…41`` is one escape, so that a chain of n
# of them makes one layer and not n.
_URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ONE_URL = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_REFERENCES = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">"}
_UNICODE = re.compile(
    r"(?<!\\)\\++(?:u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|u(?P<four>[0-9A-Fa-f]{4})|U(?P<eight>[0-9A-Fa-f]{8})|x(?P<two>[0-9A-Fa-f]{2})"
    r"|(?P<octal>[0-3][0-7]{2}))|%u(?P<percent>[0-9A-Fa-f]{4})"
    r"|&(?:amp;)*+(?:#(?:0*(?P<decimal>[0-9]{1,7})|[xX]0*(?P<hexadecimal>[0-9A-Fa-f]{1,6}));?|(?P<name>quot|apos|lt|gt);)|(?P<amp>&(?:amp;)++)")


def _as_text(raw: bytes) -> str:
    """Bytes as UTF-8, or byte by byte where they are not."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _character(code: int) -> str:
    return chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else "\ufffd"


def url_layer(layer: Layer) -> Layer | None:
    """The layer with its URL escapes resolved."""
    if "%" not in layer.text:
        return None
    new = Rewriter(layer.text)
    for run in _URL.finditer(layer.text):
        escapes = list(_ONE_URL.finditer(layer.text, run.start(), run.end()))
        raw = bytes(int(m[1], 16) for m in escapes)
        if raw.isascii():
            for m, byte in zip(escapes, raw, strict=True):
                new.replace(m.start(), m.end(), chr(byte))
        else:
            new.replace(run.start(), run.end(), _as_text(raw))
    return new.layer(layer)


def unicode_layer(layer: Layer) -> Layer | None:
    r"""The layer with ``\u0041``, ``\x41``, ``\101``, ``%u0041``, ``&#65;`` and their like resolved."""
    if not any(c in layer.text for c in "\\&%"):
        return None
    new = Rewriter(layer.text)
    high: tuple[int, int, int] | None = None
    for m in _UNICODE.finditer(layer.text):
        base = 10 if m["decimal"] else 8 if m["octal"] else 16
        name = m["name"] or m["amp"] and "amp"
        code = ord(_REFERENCES[name]) if name else int(next(g for g in m.groups() if g), base)
        if high is not None and high[1] == m.start() and 0xDC00 <= code <= 0xDFFF:
            new.replace(high[0], m.end(), chr(0x10000 + (high[2] - 0xD800 << 10) + code - 0xDC00))
            high = None
            continue
        if high is not None:
            new.replace(high[0], high[1], "\ufffd")
        high = (m.start(), m.end(), code) if 0xD800 <= code <= 0xDBFF else None
        if high is None:
            new.replace(m.start(), m.end(), _character(code))
    if high is not None:
        new.replace(high[0], high[1], "\ufffd")
    return new.layer(layer)


def _compatible() -> dict[str, str]:
    """Characters that stand for one printable ASCII sign: full width, mathematical, circled, raised; signs that do not show."""
    blocks = ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EA), (0x2070, 0x208F), (0x2100, 0x2150))
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for a, b in blocks for c in range(a, b))
    plain = {c: f for c, f in forms if len(f) == 1 and "!" <= f <= "~"}
    return plain | dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\xad", "")


_PLAIN = _compatible()
_NOT_PLAIN = re.compile("[" + "".join(map(re.escape, sorted(_PLAIN))) + "]")


def compatible_layer(layer: Layer) -> Layer | None:
    """The layer with compatibility characters in plain ASCII and invisible characters taken out."""
    if layer.text.isascii():
        return None
    new = Rewriter(layer.text)
    for m in _NOT_PLAIN.finditer(layer.text):
        new.replace(m.start(), m.end(), _PLAIN[m[0]])
    return new.layer(layer)


# --- encoded runs: each is a layer of its own --------------------------------------------------

# Lines as mail and key files wrap them; both alphabets; runs that a path or an identifier joins.
_RUNS = (
    re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{2,}={0,2}"),
    re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9]{16,}={0,2}"))
_RAW_STREAM = re.compile(r"%1[fF]%8[bB](?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~*()!'-])+")
_TO_STANDARD = str.maketrans("-_", "+/")


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")


def _decoded_runs(text: str) -> Iterator[tuple[int, int, bytes, list[int] | None]]:
    """Start, end, bytes and places of the runs that may be base64.

    A run inside another is left out if the outer one decodes to readable text or a stream; it
    is tried by itself where the outer one does not, as it may begin out of step there.
    """
    seen: set[tuple[int, int]] = set()
    readable: list[tuple[int, int]] = []
    for pattern in _RUNS:
        for m in pattern.finditer(text):
            start, end = m.span()
            outer = bisect_right(readable, (start, len(text) + 1)) - 1
            if (start, end) in seen or outer >= 0 and readable[outer][1] >= end:
                continue
            seen.add((start, end))
            decoded = _from_base64(m[0])
            if decoded is None:
                continue
            raw, places = decoded
            if _decompressor(raw) is not None or _readable(raw):
                insort(readable, (start, end))
            yield start, end, raw, places


def _readable(raw: bytes) -> bool:
    try:
        return not _CONTROL.search(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _from_base64(run: str) -> tuple[bytes, list[int] | None] | None:
    """The bytes of a run and, if it is wrapped, where its characters lie in it; None if it is no base64."""
    places = None
    if "\n" in run:
        places = [i for i, c in enumerate(run) if c not in "\r\n"]
        run = "".join(run.split())
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body.translate(_TO_STANDARD) + "=" * (-len(body) % 4)), places
    except ValueError:
        return None


def _base64_outward(start: int, text: str, raw_is_text: bool, places: list[int] | None) -> Callable[[int, int], tuple[int, int]]:
    """Ranges of the decoded text to those of the run's characters that encode them."""
    offsets = None
    if not text.isascii() and raw_is_text:  # more than one byte a character
        offsets = np.concatenate(([0], np.cumsum([len(c.encode("utf-8")) for c in text])))

    def outward(a: int, b: int) -> tuple[int, int]:
        if offsets is not None:
            a, b = int(offsets[a]), int(offsets[b])
        last = max(a, b - 1)
        first_char, last_char = a // 3 * 4 + a % 3, last // 3 * 4 + last % 3 + 1
        if places is not None:
            first_char, last_char = places[first_char], places[last_char]
        return start + first_char, start + last_char + 1

    return outward


# --- compressed streams ------------------------------------------------------------------------


def _decompressor(raw: bytes):
    """A decompressor for the stream that some bytes start with, by its signature, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 < 8 and (raw[0] << 8 | raw[1]) % 31 == 0 and not raw[1] & 32:
        return zlib.decompressobj(15)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    return None


class Budget:
    """How much may still be unwrapped from one text; ``unopened`` counts what asked for more."""

    def __init__(self, size: int):
        self.left = size
        self.unopened = 0

    def take(self, size: int) -> bool:
        if size > self.left:
            self.unopened += 1
            return False
        self.left -= size
        return True


def _inflated(raw: bytes, budget: Budget, piece: int) -> Iterator[bytes]:
    """A stream in pieces of bounded size; what is damaged or cut off ends where it does."""
    engine, pending = _decompressor(raw), raw
    while engine is not None:
        try:
            out = engine.decompress(pending, piece)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        if not budget.take(len(out)):
            return
        if out:
            yield out
        if getattr(engine, "eof", False):
            # A further member may follow, as in concatenated streams.
            rest = engine.unused_data
            engine, pending = (_decompressor(rest), rest) if rest else (None, b"")
            continue
        pending = engine.unconsumed_tail if hasattr(engine, "unconsumed_tail") else b""
        if not out and not pending:
            return


def _stream_pieces(raw: bytes, budget: Budget, piece: int) -> Iterator[bytes]:
    """The content of compressed bytes, cut only behind line feeds, with streams inside it opened too.

    Nested streams are opened as often as they nest; a stream that contains itself is seen again
    by its digest and left.
    """
    stack, seen = [raw], set()
    while stack:
        stream = stack.pop()
        digest = hashlib.blake2b(stream, digest_size=16).digest()
        if digest in seen:
            continue
        seen.add(digest)
        tail = b""
        pieces = _inflated(stream, budget, piece)
        first = next(pieces, b"")
        if first and _decompressor(first) is not None:
            inner = b"".join([first, *pieces])
            if next(_inflated(inner, Budget(64), 16), b""):
                stack.append(inner)
                continue
            yield inner
            continue
        while first:
            whole = tail + first
            cut = whole.rfind(b"\n") + 1
            if cut:
                yield whole[:cut]
            tail = whole[cut:]
            first = next(pieces, b"")
        if tail:
            yield tail


# --- the worklist ------------------------------------------------------------------------------

#: What may be unwrapped from a text besides ``GROWTH`` times its own length, and the size of a piece of a stream.
MAX_UNWRAPPED, GROWTH, PIECE = 1 << 27, 16, 4 << 20


def _run_layers(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers inside the encoded runs of a layer."""
    for start, end, raw, places in _decoded_runs(layer.text):
        if _decompressor(raw) is not None:
            opened = False
            for content in _stream_pieces(raw, budget, PIECE):
                opened = True
                yield Layer(_as_text(content), layer, lambda a, b, s=start, e=end: (s, e))
            if opened:
                continue
        text = _as_text(raw)
        yield Layer(text, layer, _base64_outward(start, text, len(text) != len(raw), places))
    if "%1" in layer.text:
        for m in _RAW_STREAM.finditer(layer.text):
            for content in _stream_pieces(unquote_to_bytes(m[0]), budget, PIECE):
                yield Layer(_as_text(content), layer, lambda a, b, s=m.start(), e=m.end(): (s, e))


def _unwrapped(layer: Layer, budget: Budget) -> Iterator[Layer]:
    for rewrite in (url_layer, unicode_layer, compatible_layer):
        new = rewrite(layer)
        if new is not None:
            yield new
    yield from _run_layers(layer, budget)


def layers(text: str, budget: Budget | None = None) -> Iterator[Layer]:
    """The text and every layer inside it, each once: depth first, so that few are held at a time."""
    budget = budget or Budget(MAX_UNWRAPPED + GROWTH * len(text))
    root = Layer(text)
    seen = {(root.digest, 0, len(text))}
    path = {root.digest: 1}
    yield root
    open_layers = [(root, root.digest, _unwrapped(root, budget))]
    while open_layers:
        layer, digest, inside = open_layers[-1]
        new = next(inside, None)
        if new is None:
            open_layers.pop()
            path[digest] -= 1
            continue
        mark = new.digest
        key = (mark, *new.source(0, len(new.text))) if new.text else None
        if key is None or key in seen or path.get(mark) or not budget.take(len(new.text)):
            continue
        seen.add(key)
        path[mark] = path.get(mark, 0) + 1
        yield new
        open_layers.append((new, mark, _unwrapped(new, budget)))


def _widest(spans: set[Span], base: list[Span]) -> list[Span]:
    """``base`` with those of ``spans`` that no other span of their kind covers."""
    kept = list(base)
    for kind in range(len(KINDS)):
        held = sorted((s.start, s.end) for s in base if s.kind == kind)  # apart from each other
        starts = [a for a, _ in held]
        reach = -1
        for a, negative in sorted((s.start, -s.end) for s in spans if s.kind == kind):
            b = -negative
            before = bisect_right(starts, a)
            if b <= reach or before and held[before - 1][1] >= b:
                continue
            reach = b
            kept.append(Span(a, kind, b))
    return sorted(kept)


def whole_spans(text: str, max_unwrapped: int = MAX_UNWRAPPED) -> tuple[list[Span], list[Span], int]:
    """The spans of the text as it stands; these with all found in deeper layers; the layers left closed."""
    base, added, budget = detect(text), set(), Budget(max_unwrapped + GROWTH * len(text))
    for layer in layers(text, budget):
        if layer.parent is not None:
            for span in detect(layer.text):
                a, b = layer.source(span.start, span.end)
                added.add(Span(a, span.kind, b))
    return base, _widest(added, base), budget.unopened


def _joined(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_unwrapped: int = MAX_UNWRAPPED,
) -> DataFrame:
    """Secrets of every whole text and of all that is encoded in it.

    Returns doc_id, n_assign, n_access, n_hex (all spans of the kind, encoded ones too),
    base_sha256 (of the spans of the text as it stands), spans (all, as kind:start:end in code
    points of the source, end exclusive, by start and then kind) and n_unopened. A finding inside
    an encoded run has the range of the characters that encode it, inside a compressed stream
    that of the whole run; one that a span of its kind covers is not repeated. A null text is
    treated as empty; repeated rows give repeated results; other columns are not looked at; an
    empty table gives an empty one.

    Streams are inflated piece by piece. A text whose layers ask for more than ``max_unwrapped``
    characters in all, besides 16 times its own length, is a decompression bomb: what goes beyond
    is not opened but counted in ``n_unopened``, and everything else of the text is searched.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = part.column("text")
                found = [whole_spans(t.as_py(), max_unwrapped) if look else ([], [], 0)
                         for t, look in zip(texts, worth_a_look(texts), strict=True)]
                counts = [pa.array([sum(s.kind == k for s in every) for _, every, _ in found], pa.int64()) for k in range(len(KINDS))]
                base = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _, _ in found], pa.string())
                spans = pa.array([_joined(every) for _, every, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, base, spans, pa.array([n for _, _, n in found], pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_unopened"])

    return rows.mapInArrow(
        search, f"doc_id {id_type}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_unopened bigint")
