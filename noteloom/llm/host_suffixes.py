"""Main text of web pages: the article by structure, the rest by repeats across a host's pages.

A page is read as a sequence of blocks in three zones: the article, what its markup says is
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments), and what lies
outside both. If a page has an article, its main text is the article. If not, it is the text of its
main element, or all outside furniture, without the boilerplate that the host repeats.

Boilerplate is found in suffix order. Every token of every page takes part, in the article and
outside; a stream ends where a page ends and where an article begins or ends. Suffixes get ranks by
prefix doubling: the rank of the first 2n tokens is made from the rank of the first n and the rank
of the n that follow. Suffixes of equal rank are neighbours with a longest common prefix of at least
that depth, so those of a rank that come from enough pages of different content are a repeat. Ranks are
fingerprints, hence need no numbering of all suffixes, and no host gathers in one task. The longest
repeat over a token decides: it is boilerplate if more pages have it outside an article than in one.

Only suffixes are ranked that can recur and whose first tokens can also lie outside an article, as
no other repeat can be boilerplate. Of the short grams in the first tokens of a suffix, the smallest
depends on these tokens alone, so where they recur, it does. Such grams are counted over all tokens
and kept in a bitmap of fixed size; it may let more suffixes pass, but never loses one.

Text inside an article is never removed for being repeated: whole articles and passages recur on
other pages of a host, and often the very sentences that other pages show in an advert.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_slices, stored

# Element names by role, and the words in a class, id or role that mark furniture.
_RAW = "script|style|noscript|template|textarea|iframe|svg|math|head|title|object|select|noembed|xmp"
_ARTICLE = frozenset({"article"})
_MAIN = frozenset({"main"})
_FURNITURE = frozenset({"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"})
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription paywall popup modal overlay sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist disqus respond reply replies share sharing social related "
    "recommended recommendations widget widgets pagination pager login signup search skip complementary contentinfo".split())
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
_NEGATIONS = frozenset({"has", "with", "no", "without"})

_OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(?P<close>/?)(?P<letter>[A-Za-z]))", re.IGNORECASE)
_NAME = re.compile(r"[^\s/>]*")
_RAW_NAME = re.compile(rf"(?:{_RAW})\b", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW.split("|")}
_EDGE = re.compile("[>\"']")
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z0-9]+")

ARTICLE, MAIN, FREE, FURNITURE = range(4)


@dataclass
class Page:
    """Blocks of text in page order, each with its zone."""

    blocks: list[tuple[int, str]] = field(default_factory=list)

    def main_zone(self) -> int:
        zones = {z for z, _ in self.blocks}
        return next((z for z in (ARTICLE, MAIN) if z in zones), FREE)

    def segments(self) -> list[tuple[bool, list[str]]]:
        """All tokens, cut where an article begins or ends: whether in an article, and the tokens."""
        return [(inside, [t for _, text in run for t in text.split(" ")]) for inside, run in groupby(self.blocks, lambda block: block[0] == ARTICLE)]

    def packed(self) -> bytes:
        """All that the main text is made of: the article, or all blocks if there is none."""
        only = self.main_zone() == ARTICLE
        return "\n".join(f"{z}{text}" for z, text in self.blocks if z == ARTICLE or not only).encode("utf-8", "surrogatepass")

    @classmethod
    def unpacked(cls, packed: bytes) -> Page:
        return cls([(int(line[0]), line[1:]) for line in packed.decode("utf-8", "surrogatepass").split("\n")])


def _furniture(name: str, attributes: str) -> bool:
    if name in _FURNITURE:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return bool(_HIDDEN.search(attributes)) or _marked(attributes, _MARKS)


def _marked(attributes: str, marks: frozenset[str]) -> bool:
    """Whether a class, id or role names one of the marks, other than to say that there is none."""
    for value in _MARKED.findall(attributes):
        before = ""
        for word in _WORD.findall(value.lower()):
            if word in marks and before not in _NEGATIONS:
                return True
            before = word
    return False


class Tag(NamedTuple):
    """A stretch of markup: a tag with its name, an element without text (``raw``), or neither."""

    start: int
    end: int
    name: str = ""
    close: bool = False
    attributes: str = ""
    raw: bool = False


def tags(source: str) -> Iterator[Tag]:
    """The markup of a page in order, in time linear in its length.

    A tag ends at the first ``>`` outside quotes. If its quotes leave none up to the end of the page,
    quotes do not count for it; if no ``>`` follows at all, it is text. A quote from which no such end
    is reached is remembered, so it is followed once, whatever the number of unfinished tags before it.
    """
    last = source.rfind(">")
    hopeless: set[int] = set()

    def tag_end(at: int) -> int:
        first = source.find(">", at)
        if source.find('"', at, first) < 0 and source.find("'", at, first) < 0:
            return first
        place, passed = at, []
        while edge := _EDGE.search(source, place):
            if edge[0] == ">":
                return edge.start()
            passed.append(edge.start())
            closing = -1 if edge.start() in hopeless else source.find(edge[0], edge.end())
            if closing < 0:
                break
            place = closing + 1
        hopeless.update(passed)
        return first

    def until(sign: str, at: int) -> int:
        found = source.find(sign, at)
        return found + len(sign) if found >= 0 else len(source)

    at = 0
    while m := _OPENING.search(source, at):
        start, at = m.start(), m.end()
        sign = m[0].upper()
        if sign == "<!--":
            at = until("-->", at)
            yield Tag(start, at)
        elif sign == "<![CDATA[":
            at = until("]]>", at)
            yield Tag(start, at)
        elif at > last:
            at = start + 1
        elif m["letter"] is None:
            at = until(">", at)
            yield Tag(start, at)
        elif not m["close"] and (raw := _RAW_NAME.match(source, start + 1)):
            end = _RAW_END[raw[0].lower()].search(source, until(">", at))
            at = end.end() if end else len(source)
            yield Tag(start, at, raw=True)
        else:
            rest = _NAME.match(source, at).end()
            end = tag_end(rest)
            yield Tag(start, end + 1, source[at - 1:rest].lower(), bool(m["close"]), source[rest:end])
            at = end + 1


def read_page(source: str) -> Page:
    """The blocks of a page. Tags need not be closed or nested well.

    The first article or main element ends furniture that it begins in, so that an unclosed menu
    does not swallow the page; only comments are never ended so, and articles in them are
    comments. Furniture inside an article ends with its own tag, or with the article.
    """
    page, parts, done = Page(), [], 0
    article = main = 0
    skipped, depth, skipped_in_article, remarks, seen = "", 0, False, False, False

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                zone = FURNITURE if skipped else ARTICLE if article else MAIN if main else FREE
                page.blocks.append((zone, text))

    for tag in tags(source):
        if tag.start > done:
            parts.append(source[done:tag.start])
        done = tag.end
        if not tag.name:
            if tag.raw:
                end_block()
            continue
        name, close, attributes = tag.name, tag.close, tag.attributes
        if name in _INLINE and not (attributes and not close and _furniture(name, attributes)):
            if skipped == name:
                depth += -1 if close else 1
                if not depth:
                    end_block()
                    skipped = ""
            continue
        end_block()
        opens = not close and not attributes.endswith("/") and name not in _VOID
        comment = opens and bool(attributes) and _marked(attributes, _COMMENTS)
        if (name in _ARTICLE or name in _MAIN) and not comment and name != skipped:
            if skipped and (opens and not (skipped_in_article or seen or remarks) or close and skipped_in_article and name in _ARTICLE):
                skipped = ""
            if skipped:
                continue
            seen = seen or opens
            step = 1 if opens else -1 if close else 0
            if name in _ARTICLE:
                article = max(0, article + step)
            elif name in _MAIN:
                main = max(0, main + step)
            continue
        if skipped:
            if name == skipped:
                depth += 1 if opens else -1 if close else 0
                if depth <= 0:
                    skipped = ""
        elif opens and (comment or _furniture(name, attributes)):
            skipped, depth, skipped_in_article, remarks = name, 1, article > 0, comment
    if done < len(source):
        parts.append(source[done:])
    end_block()
    return page


def main_text(page: Page, covered: set[int]) -> str:
    """The text of the main zone; without an article it loses the covered tokens (numbered from the page's first)."""
    zone = page.main_zone()
    if zone == ARTICLE:
        return " ".join(text for z, text in page.blocks if z == zone)
    kept, at = [], 0
    for z, text in page.blocks:
        tokens = text.split(" ")
        if z == zone:
            kept += [t for k, t in enumerate(tokens, at) if k not in covered]
        at += len(tokens)
    return " ".join(kept)


#: Groups of grams, the bits of a gram that name its group, its place in the bitmap, and all that is kept of it.
_GROUP_BITS, _PLACE_BITS, _KEPT_BITS = 10, 27, 34


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of ordered pairs of fingerprints."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    """``values`` from place ``by`` on, zeros at the end."""
    out = np.zeros_like(values)
    out[:max(0, len(values) - by)] = values[by:]
    return out


@dataclass
class Streams:
    """The tokens of some pages one after another: page and place in it, what is left of the segment, zone, and fingerprints."""

    page: np.ndarray
    place: np.ndarray
    left: np.ndarray
    inside: np.ndarray
    host: np.ndarray
    token: np.ndarray

    def heads(self, at: np.ndarray, length: int) -> np.ndarray:
        """The rank of the first ``length`` tokens of the suffixes that begin at ``at``; so many have to be left."""
        ranks = self.host[at]
        for k in range(length):
            ranks = _joined(ranks, self.token[at + k])
        return ranks

    def least_grams(self, length: int) -> np.ndarray:
        """The smallest gram of half the length in the first ``length`` tokens of every suffix; it says nothing where fewer are left."""
        size = max(1, length // 2)
        grams = self.host
        for k in range(size):
            grams = _joined(grams, _shifted(self.token, k))
        return np.minimum.reduce([_shifted(grams, k) for k in range(length - size + 1)])


def read_streams(hosts: list[str], sources: list[str | None]) -> Streams:
    segments = [(n, host, *s) for n, (host, source) in enumerate(zip(hosts, sources, strict=True)) for s in read_page(source or "").segments()]
    sizes = np.array([len(tokens) for *_, tokens in segments], np.int64)
    ends = np.cumsum(sizes)
    at = np.arange(sizes.sum())
    page = np.repeat(np.array([n for n, *_ in segments], np.int64), sizes)
    host = np.array([xxhash.xxh3_64_intdigest(host) for _, host, *_ in segments], np.uint64)
    token = pd.util.hash_array(np.array(list(chain.from_iterable(tokens for *_, tokens in segments)), object), categorize=False)
    return Streams(
        page, at - np.searchsorted(page, page), np.repeat(ends, sizes) - at,
        np.repeat(np.array([inside for _, _, inside, _ in segments], bool), sizes), np.repeat(host, sizes), token)


def recurring_grams(pages: DataFrame, min_tokens: int, min_pages: int) -> bytes:
    """A bitmap by the first bits of a gram, set for all that are smallest at the head of suffixes of ``min_pages`` pages, one of them outside an article."""
    kept, group, width = np.uint64(64 - _KEPT_BITS), np.uint64(_KEPT_BITS - _GROUP_BITS), (_KEPT_BITS - _GROUP_BITS) // 8

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html"):
                streams = read_streams(part.column("host").to_pylist(), part.column("html").to_pylist())
                least, whole = streams.least_grams(min_tokens), streams.left >= min_tokens
                changed = (least[1:] != least[:-1]) | (streams.page[1:] != streams.page[:-1]) | (streams.inside[1:] != streams.inside[:-1]) | ~whole[:-1]
                whole &= np.append(True, changed)[:len(least)]
                for inside in (False, True):
                    found, n = np.unique(least[whole & (streams.inside == inside)] >> kept, return_counts=True)
                    found = np.repeat(found, np.minimum(n, min_pages))
                    parts, starts = np.unique(found >> group, return_index=True)
                    bytes_of = found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                    rows = [b.tobytes() for b in np.split(bytes_of, starts[1:])] if len(parts) else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts.astype(np.int32)), pa.array([inside] * len(parts), pa.bool_()), pa.array(rows, pa.binary())], ["part", "inside", "grams"])

    def values(rows: list[bytes]) -> np.ndarray:
        dense = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
        out = np.zeros((len(dense), 8), np.uint8)
        out[:, :width] = dense
        return out.view("<u8").ravel()

    def bitmap(key: tuple, table: pa.Table) -> pa.Table:
        inside, outside = (values(table.filter(side).column("grams").to_pylist()) for side in (table.column("inside"), pc.invert(table.column("inside"))))
        found, n = np.unique(np.concatenate([inside, outside]), return_counts=True)
        found = np.intersect1d(found[n >= min_pages], outside)
        bits = np.zeros(1 << (_PLACE_BITS - _GROUP_BITS), np.uint8)
        bits[found >> np.uint64(_KEPT_BITS - _PLACE_BITS)] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    size = 1 << (_PLACE_BITS - _GROUP_BITS - 3)
    whole = bytearray(size << _GROUP_BITS)
    dealt = pages.select("host", "html").mapInArrow(grams, "part int, inside boolean, grams binary")
    for row in dealt.groupBy("part").applyInArrow(bitmap, "part int, bits binary").collect():
        whole[row.part * size:(row.part + 1) * size] = row.bits
    return bytes(whole)


def repeated_places(pages: DataFrame, min_tokens: int, min_pages: int) -> DataFrame:
    """(row, places): the repeats that begin in a row outside an article, for rows that have such.

    ``pages`` has row (a key of its content), host and html. A place is its number times 64, and twice
    the times that ``min_tokens`` was doubled to the longest repeat there, and 1 if that is boilerplate.
    """
    shared = pages.sparkSession.sparkContext.broadcast(recurring_grams(pages, min_tokens, min_pages))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in byte_slices(batch, "html"):
                sources = part.column("html").to_pylist()
                streams = read_streams(part.column("host").to_pylist(), sources)
                rows = part.column("row").to_numpy()
                contents = np.array([xxhash.xxh3_64_intdigest((source or "").encode("utf-8", "surrogatepass")) for source in sources], np.uint64).view(np.int64)
                spot = streams.least_grams(min_tokens) >> np.uint64(64 - _PLACE_BITS)
                found = (streams.left >= min_tokens) & ((bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                names, depth = np.zeros(len(found), np.uint64), 0
                names[found] = streams.heads(np.flatnonzero(found), min_tokens)
                while found.any():
                    at = np.flatnonzero(found)
                    page = streams.page[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[page]), pa.array(contents[page]), pa.array(streams.inside[at]),
                         pa.array(streams.place[at] * 64 + 2 * depth), pa.array(names[at].view(np.int64))],
                        ["row", "content", "inside", "place", "rank"])
                    length = min_tokens << depth
                    names, depth = _joined(names, _shifted(names, length)), depth + 1
                    found = found & _shifted(found, length) & (streams.left >= 2 * length)

    suffixes = stored(pages.select("row", "host", "html").mapInArrow(ranks, "row bigint, content bigint, inside boolean, place bigint, rank bigint"), "suffixes")
    # Written first, so that a join on a rank that very many pages share can be split.
    repeats = stored(suffixes.groupBy("rank", "content").agg(F.max("inside").cast("int").alias("inside"), F.min("inside").cast("int").alias("all_inside")).groupBy("rank").agg(
        F.count("*").alias("n"), F.sum("inside").alias("inside"), F.sum(1 - F.col("all_inside")).alias("outside")).where(F.col("n") >= min_pages).select(
        "rank", (F.col("outside") > F.col("inside")).cast("int").alias("boilerplate")), "repeats")
    return suffixes.where(~F.col("inside")).join(repeats, "rank").groupBy("row").agg(F.collect_set(F.col("place") + F.col("boilerplate")).alias("places"))


def covered(places: list[int], min_tokens: int) -> tuple[int, set[int]]:
    """How many tokens of a page lie in repeats, and the tokens where all the longest repeats are boilerplate."""
    if not places:
        return 0, set()
    starts = np.array(places, np.int64)
    starts, depths, boilerplate = starts >> 6, starts >> 1 & 31, starts & 1 == 1
    ends = starts + (min_tokens << depths)
    repeated, removed = np.zeros(ends.max(), bool), np.zeros(ends.max(), bool)

    def over(some: np.ndarray) -> np.ndarray:
        size = len(repeated) + 1
        return np.cumsum(np.bincount(starts[some], minlength=size) - np.bincount(ends[some], minlength=size))[:-1] > 0

    for depth in np.unique(depths):
        here = over(depths == depth)
        repeated |= here
        removed = np.where(here, ~over((depths == depth) & ~boilerplate), removed)
    return int(repeated.sum()), set(np.flatnonzero(removed).tolist())


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 8, min_pages: int = 3,
) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, n_repeated.

    Character references are decoded, white space inside a block becomes one space, and blocks
    are joined by one space in page order. ``n_repeated`` counts the tokens outside the article
    that lie in a substring of ``min_tokens`` or more found on ``min_pages`` or more pages of the
    host of different content, in an article or not. A null or empty page has an empty text; a null url
    belongs to a host of its own; repeated rows are extracted alike and count as one page.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn(
        "row", F.xxhash64("page_id", "url", "html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    places = repeated_places(rows.withColumn("host", host), min_tokens, min_pages)
    id_type = pages.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html"):
                blocks = [read_page(source or "").packed() for source in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("page_id"), part.column("url"), pa.array([len(b) for b in blocks], pa.int64()),
                     pa.array([pa.compress(b, codec="zstd", asbytes=True) for b in blocks], pa.binary())],
                    ["row", "page_id", "url", "size", "blocks"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "size"):
                out, repeated = [], []
                for size, blocks, starts in zip(*(part.column(c).to_pylist() for c in ("size", "blocks", "places")), strict=True):
                    n, removed = covered(starts or [], min_tokens)
                    out.append(main_text(Page.unpacked(pa.decompress(blocks, size, codec="zstd", asbytes=True)) if size else Page(), removed))
                    repeated.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(repeated, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_repeated"])

    read = rows.mapInArrow(packed, f"row bigint, page_id {id_type}, url string, size bigint, blocks binary")
    return read.join(places, "row", "left").select("page_id", "url", "size", "blocks", "places").mapInArrow(
        texts, f"page_id {id_type}, url string, text string, n_chars bigint, n_repeated bigint")
