"""Shards of nearly equal size: contiguous ranges of ordered groups under the smallest capacity.

Groups (equal texts) are atomic and ordered by their fingerprint. The smallest capacity under
which a greedy walk needs no more than the given shards is found by binary search, and the
shards are cut where that walk cuts. A group as large as a fair share gets a shard of its own
first, so that the rest is still divided evenly.

The driver never sees the groups. It walks over a summary of their prefix sums, at most
``CELLS`` cells per round, and asks for a finer summary only of the stretches in which the
answer is still open, so the capacity found is exact.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import stored

CELLS = 16_384
#: The leading bits of a fingerprint that make the ranges in which running sums are taken.
_RANGE_BITS = 12
#: Slots of a shard are counted in so many parts.
_SLOT_PARTS = 1024
OVERHEAD_BYTES = 8


class PrefixSums:
    """Sorted prefix sums, of which some are known and the rest lie in gaps marked open."""

    def __init__(self, total: int):
        self.total, self.known, self.open_after = total, [0, total], [True, False]

    def below(self, x: int) -> int:
        """The largest prefix sum known to be at most ``x``."""
        return self.known[bisect.bisect_right(self.known, x) - 1]

    def above(self, x: int) -> int:
        """No prefix sum up to ``x`` exceeds this."""
        i = bisect.bisect_right(self.known, x) - 1
        return min(x, self.known[i + 1] - 1) if self.open_after[i] else self.known[i]

    def walk(self, capacity: int, shards: int, step) -> list[int]:
        """Where each shard of the greedy walk ends."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.total if at + capacity >= self.total else step(at + capacity)
            ends.append(at)
        return ends

    def open_stretches(self, low: list[int], high: list[int]) -> list[tuple[int, int]]:
        """The open gaps that meet any of the ranges, those that touch joined to one."""
        gaps = set()
        for a, b in zip(low, high, strict=True):
            i = bisect.bisect_right(self.known, a) - 1
            while i < len(self.known) - 1 and self.known[i] <= b:
                if self.open_after[i]:
                    gaps.add((self.known[i], self.known[i + 1]))
                i += 1
        joined: list[list[int]] = []
        for a, b in sorted(gaps):
            if joined and joined[-1][1] == a:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        return [(a, b) for a, b in joined]

    def refine(self, stretches: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> None:
        """Take in (smallest, largest, number) of the prefix sums in each cell of the stretches."""
        marks = {k: o for k, o in zip(self.known, self.open_after, strict=True)}
        for a, b in stretches:
            for k in [k for k in marks if a <= k < b]:
                marks[k] = False
        for smallest, largest, number in cells:
            marks[largest] = marks.get(largest, False)
            if smallest < largest:
                marks[smallest] = number > 2
        self.known = sorted(marks)
        self.open_after = [marks[k] for k in self.known]


def _bisect(low: int, high: int, holds) -> int:
    """The smallest value in (low, high] for which ``holds``, given that it holds for ``high``."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def smallest_capacity(total: int, largest: int, shards: int, summarise) -> tuple[int, list[int]]:
    """The smallest capacity for contiguous shards, and the prefix sums at which they end.

    ``summarise(stretches)`` gives (smallest, largest, number) for cells of the prefix sums
    that lie inside the stretches.
    """
    sums = PrefixSums(total)
    floor = max(largest, -(-total // shards)) - 1
    stretches = [(0, total)]
    while True:
        sums.refine(stretches, summarise(stretches))
        fits = _bisect(floor, max(total, floor + 1), lambda c: sums.walk(c, shards, sums.below)[-1] >= total)
        may_fit = _bisect(floor, fits, lambda c: sums.walk(c, shards, sums.above)[-1] >= total)
        if may_fit == fits:
            return fits, sums.walk(fits, shards, sums.below)
        floor = may_fit - 1
        low, high = sums.walk(may_fit, shards, sums.below), sums.walk(fits, shards, sums.above)
        stretches = sums.open_stretches(low, high)


def _summaries(positions: DataFrame, cells: int):
    """What :func:`smallest_capacity` asks for, as one aggregation over the stored positions."""

    def summarise(stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        each = max(2, cells // len(stretches))
        cell = F.lit(None).cast("long")
        for n, (a, b) in reversed(list(enumerate(stretches))):
            width = max(1, -(-(b - a) // each))
            place = F.lit(n * (each + 1)).cast("long") + F.floor((F.col("prefix") - F.lit(a)) / F.lit(width)).cast("long")
            cell = F.when((F.col("prefix") > a) & (F.col("prefix") < b), place).otherwise(cell)
        found = positions.select(cell.alias("cell"), "prefix").where("cell is not null").groupBy("cell").agg(
            F.min("prefix").alias("a"), F.max("prefix").alias("b"), F.count("*").alias("n"))
        return [(r.a, r.b, r.n) for r in found.select("a", "b", "n").collect()]

    return summarise


def shard_bounds(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """Groups that fill a shard alone, and the last group of each further shard but the last.

    ``groups`` has one row per ``group`` (long) with its ``weight`` (long, positive).
    """
    total, most = groups.agg(F.sum("weight"), F.max("weight")).first()
    if not total:
        return [], []
    largest = [(None, most)]
    if most * shards >= total:
        largest = [(r.group, r.weight) for r in groups.orderBy(F.desc("weight"), "group").limit(shards).collect()]
    alone: list[int] = []
    while len(alone) < min(len(largest), shards - 1) and largest[len(alone)][1] * (shards - len(alone)) >= total > 0:
        total -= largest[len(alone)][1]
        alone.append(largest[len(alone)][0])
    if total <= 0:
        return alone, []
    rest = groups.where(~F.col("group").isin(alone)) if alone else groups
    part = F.shiftright("group", 64 - _RANGE_BITS)
    # At most 4096 ranges: their running sum is one small window, and the table is broadcast.
    ranges = rest.groupBy(part.alias("part")).agg(F.sum("weight").alias("inside"))
    ranges = ranges.select("part", (F.sum("inside").over(Window.orderBy("part")) - F.col("inside")).alias("before"))
    inside = F.sum("weight").over(Window.partitionBy("part").orderBy("group").rowsBetween(Window.unboundedPreceding, 0))
    positions = stored(
        rest.withColumn("part", part).withColumn("inside", inside).join(F.broadcast(ranges), "part")
        .select("group", (F.col("before") + F.col("inside")).alias("prefix")), "prefix-sums")
    _, ends = smallest_capacity(total, largest[len(alone)][1], shards - len(alone), _summaries(positions, cells))
    cuts = sorted({e for e in ends if e < total})
    found = positions.where(F.col("prefix").isin(cuts)).orderBy("prefix").collect() if cuts else []
    return alone, [r.group for r in found]


def shard_documents(
    docs: DataFrame, shards: int = 24, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text",
    overhead: int = OVERHEAD_BYTES, cells: int = CELLS,
) -> DataFrame:
    """Put every document into a shard, equal texts into the same one.

    The law ``bytes`` makes the sizes of the shards nearly equal (a document's size is its
    UTF-8 bytes plus ``overhead``); ``groups`` gives every document the weight 1. Returns
    doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard
    (null: shards under these laws do not grow row by row).

    A null text has no bytes, the checksum of an empty text, and is a group of its own. Repeated
    rows are separate documents with slots of their own; null ids are placed like others. With
    fewer groups than shards some shards stay empty; an empty table gives no rows. Other columns
    of ``docs`` are not looked at.
    """
    if law not in ("bytes", "groups"):
        raise ValueError(f"unknown law {law!r}")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("group"))
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    groups = stored(rows.groupBy("group").agg(F.sum(weight).alias("weight")), "groups")
    alone, lasts = shard_bounds(groups, shards, cells)
    placed = rows.withColumn("shard", _shard_of(F.col("group"), alone, lasts)).withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.lit(_SLOT_PARTS)))
    # 1024 counts per shard, whatever the number of documents.
    before = placed.groupBy("shard", "part").agg(F.count("*").alias("here")).select(
        "shard", "part",
        (F.sum("here").over(Window.partitionBy("shard").orderBy("part")) - F.col("here")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("number", number).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _shard_of(group: Column, alone: list[int], lasts: list[int]) -> Column:
    """The shard of a group: its own, or the number of cuts before it."""
    shard = F.lit(len(alone))
    for last in lasts:
        shard = shard + (group > last).cast("int")
    for n, own in enumerate(alone):
        shard = F.when(group == own, n).otherwise(shard)
    return shard.cast("int")
