"""Packing of tokenised documents into sequences by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so the packing problem is a histogram, whatever
the number of documents. It is solved on the driver from the counts of the lengths alone:

1. Linear grouping: the large lengths are sorted and cut into groups of equal cardinality, and
   every length is rounded up to the longest of its group, so that few sizes remain.
2. Configurations of these sizes are optimised by column generation: a linear programme over
   configurations, new ones found by a knapsack over the dual prices.
3. Each rounded place receives an actual piece of its group, which frees what was rounded up.
4. What is left, large pieces of broken configurations and all small ones, goes by best fit,
   longest first, into the freed space.

The plan says which ranks of each length go to which sequences and offsets. Spark counts the
ranks, in bounded parts of each length, and every piece looks its place up.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noteloom.llm.common import byte_slices, stored
from noteloom.llm.segment_bpe import byte_letters

#: Ranks of a length are counted in so many parts.
_RANK_PARTS = 256
#: Remembered words per generation in a Python worker.
_REMEMBERED = 200_000
# The split pattern of byte-level vocabularies, and Unicode's white space.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = r"\t-\r\x20\x85\xa0  -     　"


class ByteCodec:
    """The ids of a byte-level tokenizer file, from a bounded memory of words.

    A word with the white space before it is split and merged alike in every text. A file whose
    ids follow its merges is encoded by a rank table, any other by the file's own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._words = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        byte_level = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["normalizer"] is None
        if byte_level and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs)):
            byte_of = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            own = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode = own.encode_ordinary
            self._whole = False
        else:
            library = Tokenizer.from_file(path)
            self._encode = lambda text: library.encode(text, add_special_tokens=False).ids
            self._whole = True
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text; the names of special tokens in it stand for them."""
        if self._whole:
            return np.array(self._encode(text), dtype="<u4").tobytes()
        parts = self._split.split(text) if self._split and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += [self._young.get(w) or self._learn(w) for w in self._words.findall(part)]
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        found = self._old.get(word)
        if found is None:
            found = np.array(self._encode(word), dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self._young) >= _REMEMBERED:
                self._old, self._young = self._young, {}
            self._young[word] = found
        return found


@cache
def byte_codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every tokenised document.

    A document is its ids and ``end_id``. One of more than ``capacity`` ids is cut into pieces of
    exactly so many, but for the first one, which takes the rest.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = byte_codec(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in byte_slices(batch, "text"):
                row, piece, start, length, check = [], [], [], [], []
                for n, text in enumerate(part.column("text").to_pylist()):
                    ids = codec.ids(text or "") + end
                    at, size = 0, (len(ids) // 4 - 1) % capacity + 1
                    while at < len(ids):
                        row.append(n)
                        piece.append(piece[-1] + 1 if at else 0)
                        start.append(at // 4)
                        length.append(size)
                        check.append(zlib.crc32(ids[at:at + 4 * size]))
                        at, size = at + 4 * size, capacity
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, check))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Placement(NamedTuple):
    """Ranks ``first`` to ``first + count - 1`` of a length go to as many sequences, at one offset."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often to use each, by column generation."""
    m = len(sizes)
    s, d = np.array(sizes), np.array(demand, dtype=np.float64)
    basis = np.diag((capacity // s).astype(np.float64))
    amount = np.linalg.solve(basis, d)
    for _ in range(40 * m):
        price = np.maximum(np.linalg.solve(basis.T, np.ones(m)), 0.0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            fits = s <= c
            value = np.where(fits, best[np.maximum(c - s, 0)] + price, -1.0)
            j = int(value.argmax())
            best[c], last[c] = (value[j], j) if value[j] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, d), 0.0)
    return [(basis[:, j].astype(int), float(amount[j])) for j in range(m)]


#: The shares of the capacity above which a length counts as large, of which the best plan is taken.
LARGE_SHARES = (1 / 8, 1 / 4, 1 / 3, 1 / 2)


def best_plan(counts: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """The plan with the fewest sequences, over what counts as large."""
    return min((plan(counts, capacity, small_share=s) for s in LARGE_SHARES), key=lambda p: p[1])


def plan(counts: dict[int, int], capacity: int, groups: int = 48, small_share: float = 1 / 2) -> tuple[list[Placement], int]:
    """Where the pieces go, given the number of pieces of each length; and the number of sequences."""
    left = {n: c for n, c in counts.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    placed: list[Placement] = []
    sequences = 0
    # By free space: runs of sequences that are filled alike (first sequence, number).
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        placed.append(Placement(length, ranks[length], count, sequence, offset))
        ranks[length] += count

    large = [(n, left[n]) for n in sorted(left, reverse=True) if n > capacity * small_share]
    total = sum(c for _, c in large)
    queues: list[deque[list[int]]] = []
    if total:
        bounds, at = [-(-total * (g + 1) // groups) for g in range(groups)], 0
        queues.append(deque())
        for n, c in large:
            while c:
                while at >= bounds[0]:
                    bounds.pop(0)
                    queues.append(deque())
                take = min(c, bounds[0] - at)
                queues[-1].append([n, take])
                at, c = at + take, c - take
        queues = [q for q in queues if q]
        merged: list[deque[list[int]]] = []  # groups of one rounded size are one
        for q in queues:
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1].extend(q)
            else:
                merged.append(q)
        queues = merged
        found = configurations([q[0][0] for q in queues], [sum(c for _, c in q) for q in queues], capacity)
        for config, amount in sorted(found, key=lambda x: -x[1]):
            times = int(amount + 1e-6)
            for j, need in enumerate(config):
                if need:
                    times = min(times, sum(c for _, c in queues[j]) // need)
            if not times or not config.any():
                continue
            slots = [_take(queues[j], times) for j, need in enumerate(config) for _ in range(need)]
            start = 0
            while start < times:
                run = min(slot[0][1] for slot in slots)
                offset = 0
                for slot in slots:
                    n = slot[0][0]
                    put(n, run, sequences, offset)
                    left[n] -= run
                    offset += n
                    slot[0][1] -= run
                    if not slot[0][1]:
                        slot.popleft()
                free[capacity - offset].append((sequences, run))
                sequences, start = sequences + run, start + run
    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            space = next((r for r in range(n, capacity + 1) if free[r]), None)
            if space is None:
                opened = -(-rest // (capacity // n))
                free[capacity].append((sequences, opened))
                sequences, space = sequences + opened, capacity
            first, number = free[space].pop()
            each = space // n
            full = min(number, rest // each)
            if not full:  # the last few of this length share one sequence
                full, each = 1, rest
            for k in range(each):
                put(n, full, first, capacity - space + k * n)
            rest -= full * each
            free[space - each * n].append((first, full))
            if number > full:
                free[space].append((first + full, number - full))
    return placed, sequences


def _take(queue: deque[list[int]], count: int) -> deque[list[int]]:
    """The next ``count`` pieces of a group as (length, number)."""
    out: deque[list[int]] = deque()
    while count:
        n, c = queue[0]
        take = min(c, count)
        out.append([n, take])
        count -= take
        if take == c:
            queue.popleft()
        else:
            queue[0][1] -= take
    return out


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset
    (gapless from 0 in each sequence). Null and empty texts have the end id alone. Repeated rows
    are packed each; null ids are packed like others. An empty table gives no rows; other
    columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(token_pieces(rows, path, capacity, end_id), "pieces").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_RANK_PARTS)))
    # At most 256 counts for each of the lengths up to the capacity.
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("here"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("here").alias("n")).collect()}
    before = parts.select(
        "length", "part", (F.sum("here").over(Window.partitionBy("length").orderBy("part")) - F.col("here")).alias("before"))
    placed, _ = best_plan(counts, capacity)
    table = np.array(sorted(placed), dtype=np.int64).reshape(-1, 5)
    width = int(max(counts.values(), default=0)) + 1
    starts = table[:, 0] * width + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            found = table[np.searchsorted(starts, length * width + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("number", number).join(before, ["length", "part"]).select(
        *names, (F.col("before") + F.col("number") - 1).cast("bigint").alias("rank"))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")
