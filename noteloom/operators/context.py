"""Complete the evidence: whole sentences, what they depend on, and near neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.operators.chunking import unit_table
from noteloom.operators.quality import reconstruct
from noteloom.session import checkpointed, hinted


def dependency_islands(units: DataFrame) -> DataFrame:
    """For each unit of a section: where its dependencies begin and end.

    Units: ``doc_id, section, unit, heading, dependent``. Adds ``head`` (the unit that
    starts the chain, looking back no further than a heading), ``headless`` (the chain
    has no independent start) and ``tail`` (the last dependent unit that follows).
    A window holds the units of one section.
    """
    w = Window.partitionBy("doc_id", "section").orderBy("unit")
    starts = ~F.col("dependent") | F.coalesce(F.lag("heading").over(w), F.lit(True))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    last = F.max("unit").over(Window.partitionBy("doc_id", "section"))
    return (
        units.withColumn("_starts", starts)
        .withColumn("head", F.max(F.when(F.col("_starts"), F.col("unit"))).over(w))
        .withColumn("tail", F.coalesce(F.min(F.when(~F.col("dependent"), F.col("unit"))).over(ahead) - 1, last))
        .withColumn("headless", F.max(F.when(F.col("_starts"), F.struct("unit", "dependent"))).over(w)["dependent"])
        .drop("_starts")
    )


def chunk_sections(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """The section that holds each chunk: (chunk_id, doc_id, section, char_start, char_end).

    Section starts and chunk starts of a document are put in one order; a chunk belongs to
    the last section that has started, if it also ends inside. No pairs are formed.
    """
    nothing = F.lit(None).cast("bigint")
    starts = units.select(
        "doc_id", F.col("section_start").alias("_at"), F.lit(0).alias("_kind"), F.struct("section", "section_end").alias("_s"),
        nothing.alias("chunk_id"), nothing.alias("char_end"),
    ).distinct()
    spans = chunks.select(
        "doc_id", F.col("char_start").alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(starts.schema["_s"].dataType).alias("_s"), "chunk_id", "char_end",
    )
    w = Window.partitionBy("doc_id").orderBy("_at", "_kind")
    placed = starts.unionByName(spans).withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return placed.filter((F.col("_kind") == 1) & (F.col("char_end") <= F.col("_s.section_end"))).select(
        "chunk_id", "doc_id", F.col("_s.section").alias("section"), F.col("_at").alias("char_start"), "char_end"
    )


def _sections(units: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per section with its units and the chunks inside it; spans only, no text."""
    u = dependency_islands(units).groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(F.struct("unit", "char_start", "char_end", "heading", "head", "tail", "headless"))).alias("units")
    )
    c = placed.groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(F.struct("char_start", "char_end", "chunk_id"))).alias("chunks")
    )
    return u.join(c, ["doc_id", "section"])


class _Section:
    """A section as sorted arrays: bounds of its units and of the chunks inside it."""

    def __init__(self, units: list[dict], chunks: list[dict]):
        self.unit_start, self.unit_end, head, tail = (
            np.array([u[k] for u in units]) for k in ("char_start", "char_end", "head", "tail"))
        self.headings = np.flatnonzero([bool(u["heading"]) for u in units])
        self.headless = [bool(u["headless"]) for u in units]
        base = units[0]["unit"]
        # Chains of units without an independent start have no head.
        self.head = np.array([-1 if h is None or h != h else h - base for h in head.tolist()], dtype=np.int64)
        self.tail = tail - base
        self.start, self.end, self.ids = (np.array([c[k] for c in chunks]) for k in ("char_start", "char_end", "chunk_id"))

    def reach(self, start: int, end: int, neighbours: int) -> np.ndarray | None:
        """Bounds of what a span requires and of what is wanted with it; None if its chain has no start."""
        first = int(np.searchsorted(self.unit_start, start, side="right")) - 1
        last = int(np.searchsorted(self.unit_end, end))
        if self.headless[first]:
            return None
        first, last = int(self.head[first]), int(self.tail[last])
        before, after = np.searchsorted(self.headings, [first, last + 1])
        floor = self.headings[before - 1] + 1 if before else 0
        ceiling = (self.headings[after] if after < len(self.headings) else len(self.unit_end)) - 1
        wide_first, wide_last = min(first, max(first - neighbours, floor)), max(last, min(last + neighbours, ceiling))
        return np.array([self.unit_start[first], self.unit_end[last], self.unit_start[wide_first], self.unit_end[wide_last]])

    def cover(self, start: int, end: int, preferred: set[int]) -> list[int] | None:
        """Places of the chunks that cover a span, preferred ones first and then those that reach furthest."""
        picked: list[int] = []
        while start < end:
            here = np.flatnonzero((self.start <= start) & (self.end > start))
            if not len(here):
                return None
            liked = np.array([c in preferred for c in self.ids[here].tolist()])
            picked.append(int(here[np.argmax(np.where(liked, self.end[here] + self.end.max(), self.end[here]))]))
            start = self.end[picked[-1]]
        return picked


def _completed(anchors: pd.DataFrame, max_chars: int, neighbour_chars: int, neighbour_units: int):
    """The chunks of one question in order with what each requires, or the reason why there are none.

    Chunks are worked off level by level: the anchors, then the chunks that they brought in,
    and so on, until a level brings in nothing.
    """
    refused = anchors["problem"].dropna()
    if len(refused):
        return refused.iloc[0], None
    sections: dict[int, _Section] = {}
    spans: dict[int, tuple[int, int, _Section]] = {}
    for row in anchors.itertuples():
        key = (row.units[0]["unit"], row.units[0]["char_start"], row.doc_id)
        section = sections.setdefault(key, _Section(list(row.units), list(row.chunks)))
        spans[row.chunk_id] = (row.char_start, row.char_end, section)
    links: set[tuple[int, int]] = set()
    level, depth = list(spans), 0
    while level:
        arrived: list[int] = []
        for chunk in level:
            a, b, section = spans[chunk]
            bounds = section.reach(a, b, neighbour_units if depth == 0 else 0)
            if bounds is None:
                return "dependency_missing", None
            need_from, need_to, from_, to = bounds.tolist()
            picked = section.cover(from_, to, spans.keys())
            if picked is None:
                return "not_covered", None
            ids, starts, ends = (x[picked].tolist() for x in (section.ids, section.start, section.end))
            extra = {i: e - s for i, s, e in zip(ids, starts, ends, strict=True) if i != chunk}
            if sum(extra.values()) > neighbour_chars:
                return "neighbour_budget", None
            for i, s, e in zip(ids, starts, ends, strict=True):
                if i not in spans:
                    spans[i] = (s, e, section)
                    arrived.append(i)
            needed = {i for i, s, e in zip(ids, starts, ends, strict=True) if s < need_to and e > need_from} | {chunk}
            links |= {(i, j) for i in needed for j in needed if i != j}
        level, depth = arrived, depth + 1
    if sum(b - a for a, b, _ in spans.values()) > max_chars:
        return "total_budget", None
    return None, [(c, sorted(j for i, j in links if i == c)) for c in spans]


def _expand_group(max_chars: int, neighbour_chars: int, neighbour_units: int):
    def expand(frame: pd.DataFrame) -> pd.DataFrame:
        anchors = frame.sort_values("rank")
        problem, found = _completed(anchors, max_chars, neighbour_chars, neighbour_units)
        hits = set(anchors["chunk_id"])
        rows = [(0, None, None, None, problem)] if problem is not None else [
            (n, chunk, chunk in hits, needed, None) for n, (chunk, needed) in enumerate(found, start=1)]
        out = pd.DataFrame(rows, columns=["place", "chunk_id", "is_anchor", "context_chunk_ids", "problem"])
        out.insert(0, "question_id", anchors["question_id"].iloc[0])
        return out

    return expand


EXPANDED = (
    "question_id bigint, place bigint, chunk_id bigint, is_anchor boolean, context_chunk_ids array<bigint>, problem string"
)


def expand_evidence(
    anchors: DataFrame, chunks: DataFrame, documents: DataFrame,
    max_chars: int = S.CONTEXT_TOTAL_CHARS, neighbour_chars: int = S.CONTEXT_NEIGHBOUR_CHARS,
    neighbour_units: int = S.CONTEXT_NEIGHBOUR_UNITS,
) -> DataFrame:
    """Hits in order, then the chunks that complete them, with the required ones listed.

    Anchors: ``question_id, rank, chunk_id``. Chunks: ``chunk_id, doc_id, kb_id, content,
    char_start, char_end``. Documents: ``doc_id, kb_id, char_count``. A question whose
    evidence cannot be completed has a single row with ``problem``. Text is read only for
    the documents that were hit; the last step groups spans of one question's sections.
    """
    # A few rows per question, used several times below; the search behind them runs once.
    asked = checkpointed(anchors.select("question_id", "rank", "chunk_id"))
    spans = chunks.select("chunk_id", "doc_id", "char_start", "char_end").join(
        hinted(asked.select("chunk_id").distinct()), "chunk_id", "left_semi"
    )
    hit = checkpointed(asked.join(spans, "chunk_id", "left"))
    docs = hinted(hit.select("doc_id").dropna().distinct())
    wanted = documents.join(docs, "doc_id", "left_semi").select("doc_id", "kb_id", "char_count")
    held = checkpointed(
        chunks.select("chunk_id", "doc_id", "kb_id", "content", "char_start", "char_end")
        .join(docs, "doc_id", "left_semi").join(wanted, ["doc_id", "kb_id"], "left_semi")
    )
    whole = checkpointed(reconstruct(held, wanted))
    units = checkpointed(unit_table(whole.filter(F.col("code").isNull()).select("doc_id", "text")))
    placed = chunk_sections(units, held.select("chunk_id", "doc_id", "char_start", "char_end"))
    located = (
        hit.join(whole.select("doc_id", "code"), "doc_id", "left")
        .join(placed.select("chunk_id", "section"), "chunk_id", "left")
        .join(_sections(units, placed), ["doc_id", "section"], "left")
    )
    problem = (
        F.when(F.col("char_start").isNull(), "anchor_missing")
        .when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("section").isNull(), "crosses_sections")
    )
    return (
        located.withColumn("problem", problem)
        .select("question_id", "rank", "chunk_id", "doc_id", "char_start", "char_end", "units", "chunks", "problem")
        .groupBy("question_id")
        .applyInPandas(_expand_group(max_chars, neighbour_chars, neighbour_units), EXPANDED)
    )


# The layout of a numbered source, whose length counts against the budget.
_TITLE, _SPAN, _BODY = "文档名称：", "原文字符位置：", "原文："
_NEEDS, _NEEDS_END, _LIST_MARK = "须结合上下文来源：", "；条件与指代不得省略。", "、"


def source_context(evidence: DataFrame, max_chars: int = S.CONTEXT_TOTAL_CHARS) -> DataFrame:
    """Numbered source blocks per question: (question_id, context, length, fits).

    Evidence: ``question_id, number, chunk_id, doc_id, doc_title, content, char_start,
    char_end, context_chunk_ids``. Blocks follow the numbers, or the source order as soon
    as one block depends on another. A question has as many rows as its budget holds.
    """
    collected = evidence.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "number", "chunk_id", "doc_id", "char_start", "char_end", "doc_title", "content", "context_chunk_ids"
        ))).alias("s"),
    ).withColumn("numbers", F.map_from_entries(F.transform("s", lambda x: F.struct(x["chunk_id"], x["number"]))))
    linked = F.exists("s", lambda x: F.size(x["context_chunk_ids"]) > 0)
    by_source = F.array_sort(F.transform("s", lambda x: F.struct(
        x["doc_id"].alias("d"), x["char_start"].alias("a"), x["char_end"].alias("b"), x["number"].alias("n"), x.alias("x")
    )))

    def block(x):
        related = F.transform(
            F.filter(x["context_chunk_ids"], lambda c: F.map_contains_key(F.col("numbers"), c)),
            lambda c: F.concat(F.lit("["), F.element_at(F.col("numbers"), c).cast("string"), F.lit("]")),
        )
        needs = F.when(
            F.size(x["context_chunk_ids"]) > 0,
            F.concat(F.lit(_NEEDS), F.array_join(related, _LIST_MARK), F.lit(_NEEDS_END + "\n")),
        ).otherwise(F.lit(""))
        return F.concat(
            F.lit("["), x["number"].cast("string"), F.lit("] " + _TITLE), x["doc_title"], F.lit("\n" + _SPAN),
            x["char_start"].cast("string"), F.lit("–"), x["char_end"].cast("string"), F.lit("\n"), needs,
            F.lit(_BODY + "\n"), F.regexp_replace(x["content"], r"(?U)^\s+|\s+$", ""),
        )

    ordered = F.when(linked, F.transform(by_source, lambda y: y["x"])).otherwise(F.col("s"))
    return (
        collected.withColumn("s", ordered)
        .select("question_id", F.array_join(F.transform("s", block), "\n\n").alias("context"))
        .withColumn("length", F.length("context").cast("bigint"))
        .withColumn("fits", F.col("length") <= max_chars)
    )
