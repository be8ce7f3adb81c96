"""Near duplicates by ProbMinHash signatures of weighted word shingles.

A shingle is five consecutive words; its weight is 1 for the first occurrence in a text and grows
with the logarithm of their number, so that a line said a hundred times does not drown the rest of
its text. Every shingle sends
arrivals of a Poisson process whose rate is its weight; each arrival falls on a random register
of the signature, and a register keeps the shingle that reached it first. A shingle stops when
its next arrival is later than the latest register (early termination). Two signatures agree in
a register with the probability Jaccard similarity of the texts, which for shingles that occur
once is the plain Jaccard similarity.

Bands of registers bring candidates together, in two steps whose number of jobs is fixed but for
the search of components. First, each text of a bucket is compared with the bucket's centres, its
texts of smallest and largest hash, so that large classes grow together at a cost of twice n
comparisons for a bucket of n texts. Buckets whose texts are then all in one class are settled.
The texts of the others meet by rare shingles: the similarity of two texts is at most
1 / (1 / P + 1 / Q - 1) with P and Q the shares of their weights on common shingles, so at the
threshold t both shares reach t, and one of them 2 t / (1 + t). In any order of all shingles, the
first common one therefore lies among the first shingles that hold just over 1 - t of the weight of
both texts, and just over (1 - t) / (1 + t) of one of them. With the rarest first, passages that
many texts share bring nobody together. Texts that meet and are in different classes are compared by
parity sketches of all their shingles, which bound the similarity from above, and those that may reach
the threshold are verified exactly on their whole texts: first the pair of any two classes that meets most often, then all
other pairs of those classes that it does not link. So two texts that share a bucket are compared,
or cannot reach the threshold, or are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import byte_slices, stored

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: What sums of floating-point numbers may fall short of a similarity that equals the threshold.
_ROUNDING = 1e-9
#: Bits of a text's parity sketch, and how many pairs of sketches are compared at a time.
_SKETCH_BITS, _SKETCH_PAIRS = 2048, 1 << 15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Settings:
    """With 32 bands of 5 registers, a pair of similarity 0.8 shares no bucket with probability 3e-6.

    A block of texts that meet by one rare shingle holds about ``block_rows`` of them.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    band_rows: int = 5
    block_rows: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.band_rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose values look independent."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def weighted_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and weight of every distinct shingle, by text and hash.

    Words are lower-cased and separated by white space. A text with fewer words than ``width``,
    but at least one, has a single shingle of them all.
    """
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(words)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "")
    doc = doc[full.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(flat.filter(full))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64)
    counts = np.bincount(doc, minlength=len(texts))
    value = np.zeros(max(0, len(word) - width + 1), dtype=np.uint64)
    for k in range(width):
        value = mix(value + word[k:k + len(value)] + _GOLDEN)
    inside = doc[:len(value)] == doc[width - 1:] if len(value) else np.zeros(0, bool)
    doc_of, value = doc[:len(value)][inside], value[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        starts = np.cumsum(counts) - counts
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] = mix(extra[has] + word[starts[short[has]] + k] + _GOLDEN)
        doc_of, value = np.concatenate([doc_of, short]), np.concatenate([value, extra])
    order = np.lexsort((value, doc_of))
    doc_of, value = doc_of[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (doc_of[1:] != doc_of[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc_of[first], value[first], 1.0 + np.log(np.diff(np.append(first, len(value))))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The ProbMinHash signature of each text, all texts side by side; zero for texts without shingles."""
    arrival = np.full(docs * registers, np.inf)
    found = np.zeros(docs * registers, dtype=np.uint64)
    sizes = np.bincount(doc, minlength=docs)
    alone = sizes[doc] == 1  # a single shingle reaches every register first
    found.reshape(docs, registers)[doc[alone]] = shingle[alone][:, None]
    doc, shingle, rate = doc[~alone], shingle[~alone], weight[~alone]
    time = np.zeros(len(doc))
    latest = np.full(docs, np.inf)
    turn = 0
    while len(doc):
        turn += 1
        draw = mix(shingle + np.uint64(turn * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        on = time < latest[doc]
        doc, shingle, rate, time = doc[on], shingle[on], rate[on], time[on]
        slot = doc * registers + (mix(draw[on] ^ _M1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, slot, time)
        won = arrival[slot] == time
        found[slot[won]] = shingle[won]
        seen = doc[np.append(True, doc[1:] != doc[:-1])] if len(doc) else doc
        latest[seen] = arrival.reshape(docs, registers)[seen].max(axis=1)
    return found.reshape(docs, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One number per band; equal bands of different place have different numbers."""
    rows = signature.shape[1] // bands
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    for k in range(rows):
        key = mix(key + signature[:, k::rows][:, :bands] + _GOLDEN)
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The similarity of two weighted sets given by sorted distinct elements and their weights.

    For each common element d, one over the sum over all e of max(x_e / x_d, y_e / y_d). The
    sum depends on d by the ratio x_d / y_d alone, so it is taken once for each ratio.
    """
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = x[i], y[j]
    ratios, which = np.unique(p / q, return_inverse=True)
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    if len(ratios) == 1:
        s = ratios[0]
        return float((p / (only_x + s * only_y + np.maximum(p, s * q).sum())).sum())
    order = np.argsort(which, kind="stable")
    ps, qs = np.cumsum(p[order]), np.cumsum(q[order])
    ends = np.searchsorted(which[order], np.arange(len(ratios)), side="left")
    # Elements of smaller ratio count with s * y, the others with x.
    y_below = np.where(ends > 0, qs[np.maximum(ends - 1, 0)], 0.0)
    x_above = ps[-1] - np.where(ends > 0, ps[np.maximum(ends - 1, 0)], 0.0)
    total = only_x + x_above + ratios * (only_y + y_below)
    return float((p / total[which]).sum())


def similarities(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """The exact similarity of the texts in each row."""
    coded = pc.dictionary_encode(pa.chunked_array([pc.fill_null(left, ""), pc.fill_null(right, "")])).unify_dictionaries().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    doc, value, weight = weighted_shingles(coded.dictionary, width)
    bounds = np.searchsorted(doc, np.arange(len(coded.dictionary) + 1))
    place = coded.indices.to_numpy(zero_copy_only=False)
    out = np.empty(len(left))
    for n, (i, j) in enumerate(zip(place[:len(left)], place[len(left):], strict=True)):
        s, t = slice(bounds[i], bounds[i + 1]), slice(bounds[j], bounds[j + 1])
        out[n] = probability_jaccard(value[s], weight[s], value[t], weight[t])
    return out


def text_bands(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, the band keys of its text, the number of its shingles, their weight and the largest; texts without words have no row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                coded = pc.dictionary_encode(pc.fill_null(part.column("text"), ""))  # copies are signed once
                texts = len(coded.dictionary)
                doc, value, weight = weighted_shingles(coded.dictionary, settings.words)
                keys = band_keys(signatures(doc, value, weight, texts, settings.registers), settings.bands)
                place = coded.indices.to_numpy(zero_copy_only=False)
                some = np.bincount(doc, minlength=texts)[place] > 0
                rows = keys[place[some]]
                many, total, top = np.bincount(doc, minlength=texts), np.bincount(doc, weights=weight, minlength=texts), np.zeros(texts)
                np.maximum.at(top, doc, weight)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").filter(pa.array(some)), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), settings.bands).cast(pa.list_(pa.int64())),
                     *[pa.array(x[place[some]]) for x in (many.astype(np.int64), total, top)]],
                    ["doc_id", "keys", "many", "total", "top"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, keys array<bigint>, many bigint, total double, top double")


def may_reach(a: Column, b: Column, settings: Settings) -> Column:
    """Whether two texts can reach the threshold, by the number of their shingles and their weights alone.

    The share of a text's weight on common shingles is at most that of as many of its heaviest
    shingles as the smaller text has in all.
    """
    fewer = F.least(a["many"], b["many"])
    p, q = (F.least(F.lit(1.0), fewer * x["top"] / x["total"]) for x in (a, b))
    return 1 / (1 / p + 1 / q - 1) >= settings.threshold - _ROUNDING


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, with the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for some in byte_slices(batch, "text_a", 1 << 20) for p in byte_slices(some, "text_b", 1 << 20)):
                value = similarities(part.column("text_a"), part.column("text_b"), settings.words)
                near = pa.array(value >= settings.threshold - _ROUNDING)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(near), part.column("b").filter(near), pa.array(value).filter(near)], ["a", "b", "similarity"])

    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        check, "a bigint, b bigint, similarity double")


def near_classes(docs: DataFrame, ids: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id) of all documents of ``ids`` that are linked to others.

    ``ids`` (doc_id) names one document per distinct text. Texts are signed where they are
    read, and move only if they share a bucket with another one.
    """
    bands = stored(text_bands(docs, settings).join(ids, "doc_id", "left_semi"), "bands")
    text = F.struct("doc_id", "many", "total", "top")
    met = bands.select(text.alias("one"), F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("one.doc_id").alias("o"), "one")
    centres = met.groupBy("key").agg(F.count("*").alias("n"), F.min(order)["one"].alias("low"), F.max(order)["one"].alias("high")).where("n > 1")
    shared = stored(met.join(centres.drop("n"), "key").select("one", "low", "high"), "buckets")
    near = shared.select("one", F.explode(F.array("low", "high")).alias("centre")).where(
        (F.col("one.doc_id") != F.col("centre.doc_id")) & may_reach(F.col("one"), F.col("centre"), settings))
    pairs = stored(near.select(F.least("one.doc_id", "centre.doc_id").alias("a"), F.greatest("one.doc_id", "centre.doc_id").alias("b")).distinct(), "pairs")
    meeting = shared.select("one.doc_id").distinct()
    texts = stored(docs.join(meeting, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "candidates")
    links = stored(verified(pairs, texts, settings).select("a", "b"), "links")
    classes = stored(components(links), "classes")
    open_ = open_texts(bands, classes)
    found = rare_links(open_, texts, settings)
    star = classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).where("a <> b")
    return components(star.unionAll(found))


def open_texts(bands: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class_id) of the texts in buckets that hold more than one class.

    The class joins the one row of a text, before its keys are exploded.
    """
    known = stored(bands.select("doc_id", "keys").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "keys"), "known")
    keys = known.select("doc_id", "class_id", F.explode("keys").alias("key"))
    mixed = stored(keys.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("key"), "mixed")
    return stored(keys.join(mixed, "key", "left_semi").select("doc_id", "class_id").distinct(), "open")


def parity_sketches(doc: np.ndarray, shingle: np.ndarray, docs: int) -> np.ndarray:
    """For each text, which of ``_SKETCH_BITS`` classes of shingles hold an odd number of its shingles, as packed bits."""
    cell, n = np.unique(doc * _SKETCH_BITS + (shingle % np.uint64(_SKETCH_BITS)).astype(np.int64), return_counts=True)
    cell = cell[n % 2 == 1]
    packed = np.zeros(docs * _SKETCH_BITS // 8, dtype=np.uint8)
    np.bitwise_or.at(packed, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    return packed.reshape(docs, -1)


def sketches_may_reach(sketch: np.ndarray, many: np.ndarray, total: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the texts ``x`` and ``y`` of each pair can reach the threshold, by their parity sketches.

    Every class of different parity holds a shingle of one text alone, and a shingle weighs 1 at least.
    So the number of differing bits bounds from below what each text has alone, and thereby from above
    the shares of the weights on common shingles. No pair that reaches the threshold is refused.
    """
    words = np.ascontiguousarray(sketch).view(np.uint64)
    out = np.empty(len(x), dtype=bool)
    for start in range(0, len(x), _SKETCH_PAIRS):
        i, j = x[start:start + _SKETCH_PAIRS], y[start:start + _SKETCH_PAIRS]
        differ = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        more = many[i] - many[j]
        p, q = (np.maximum(0.0, 1 - np.maximum(0, differ + d) / 2 / total[k]) for k, d in ((i, more), (j, -more)))
        # 1 / (1 / p + 1 / q - 1) without a division by zero; texts that have nothing in common are not similar
        out[start:start + _SKETCH_PAIRS] = (p * q > 0) & (p * q >= (threshold - _ROUNDING) * (p + q - p * q))
    return out


def text_shingles(texts: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, the shingles of its text with their shares of its weight, their number, their weight and their parity sketch."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                doc, value, weight = weighted_shingles(part.column("text"), settings.words)
                docs = part.num_rows
                many, total = np.bincount(doc, minlength=docs), np.bincount(doc, weights=weight, minlength=docs)
                bounds = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(value.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(weight / total[doc])),
                     pa.array(many.astype(np.int64)), pa.array(total), pa.array([r.tobytes() for r in parity_sketches(doc, value, docs)], pa.binary())],
                    ["doc_id", "shingles", "shares", "many", "total", "sketch"])

    return texts.select("doc_id", "text").mapInArrow(
        shares, "doc_id bigint, shingles array<bigint>, shares array<double>, many bigint, total double, sketch binary")


def rare_shingles(texts: DataFrame, settings: Settings) -> DataFrame:
    """(shingle, doc_id, short): the rare shingles by which texts that reach the threshold must meet."""
    return rarest(stored(text_shingles(texts, settings), "shingles"), settings)


def rarest(shingled: DataFrame, settings: Settings) -> DataFrame:
    """(shingle, doc_id, short): of each text, rarest first, the shingles that hold just over ``1 - t`` of its weight.

    ``short`` marks those that hold just over ``(1 - t) / (1 + t)``. Shingles that one text has alone
    come first, bring nobody together, and are counted by their weight only.
    """
    t = settings.threshold
    rows = shingled.select("doc_id", F.explode(F.arrays_zip("shingles", "shares")).alias("s")).select(
        "doc_id", F.col("s.shingles").alias("shingle"), F.col("s.shares").alias("share"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ranked = Window.partitionBy("doc_id").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What comes before a shingle is the whole less the weight of all that follow it, itself included.
    after = F.sum("share").over(Window.partitionBy("doc_id")) - F.sum("share").over(ranked) + F.col("share")
    before = rows.join(counts, "shingle").select("shingle", "doc_id", (F.lit(1.0) - after).alias("before"))
    return before.where(F.col("before") <= 1 - t + 1e-6).select(
        "shingle", "doc_id", (F.col("before") <= (1 - t) / (1 + t) + 1e-6).alias("short"))


def cell_pairs(ids: np.ndarray, classes: np.ndarray, short: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Row numbers of the pairs between two blocks, or inside one, of different classes and not both long."""
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    met = (classes[left][:, None] != classes[right][None, :]) & (short[left][:, None] | short[right][None, :])
    if block.min() == block.max():
        met &= ids[left][:, None] < ids[right][None, :]
    i, j = np.nonzero(met)
    return np.column_stack([left[i], right[j]])


def rare_pairs(members: DataFrame, rare: DataFrame, sketches: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, low, high, n): texts of different classes ``low`` and ``high`` that meet by n groups of rare shingles.

    Texts that share a rare shingle are dealt out in blocks of three kinds: those of the largest
    class for which it is short, those of other classes for which it is short, and the rest. Blocks
    meet in cells, except that blocks of the first kind do not meet each other, nor do those of the rest.
    Of several shingles that bring the same texts together one is kept. No text moves; the parity
    ``sketches`` (doc_id, many, total, sketch) do, and pairs that they refuse do not leave their cell.
    """
    rare = stored(rare.join(members, "doc_id").select("shingle", "doc_id", "short", "class_id"), "rare")
    sums = [F.sum(F.xxhash64("doc_id", "short", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(2)]
    by_class = rare.groupBy("shingle", "class_id").agg(
        F.count_if("short").alias("short"), F.count("*").alias("n"), *sums)
    groups = by_class.groupBy("shingle").agg(
        F.max(F.struct("short", "class_id")).alias("top"), F.sum("short").alias("short"), F.sum("n").alias("n"), F.count("*").alias("classes"),
        *[F.sum(f"s{k}").cast("string").alias(f"s{k}") for k in range(2)]).where("classes > 1 and short > 0")
    blocks = lambda many: F.ceil(many / settings.block_rows).cast("int")
    one = groups.groupBy("n", "s0", "s1").agg(F.min(F.struct("shingle", "top", "short")).alias("g")).select("n", "g.*")
    plan = stored(one.select(
        "shingle", F.col("top.class_id").alias("top"), blocks(F.col("short") - F.col("top.short")).alias("others"),
        blocks(F.col("top.short")).alias("tops"), blocks(F.col("n") - F.col("short")).alias("rests")), "plan")
    number = lambda many: F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), many))
    kind = F.when(~F.col("short"), 2).when(F.col("class_id") == F.col("top"), 1).otherwise(0)
    dealt = rare.join(plan, "shingle").withColumn("kind", kind).withColumn(
        "block", F.when(F.col("kind") == 0, number(F.col("others"))).when(F.col("kind") == 1, F.col("others") + number(F.col("tops")))
        .otherwise(F.col("others") + F.col("tops") + number(F.col("rests"))).cast("int"))
    of = lambda block: F.when(block < F.col("others"), 0).when(block < F.col("others") + F.col("tops"), 1).otherwise(2)
    partners = F.filter(F.sequence(F.lit(0), F.col("others") + F.col("tops") + F.col("rests") - 1), lambda x: (F.col("kind") == 0) | (of(x) != F.col("kind")))
    cells = dealt.withColumn("other", F.explode(partners)).select(
        "shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "class_id", "short").join(sketches, "doc_id")

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        ids, classes = cell["doc_id"].to_numpy(), cell["class_id"].to_numpy()
        x, y = cell_pairs(ids, classes, cell["short"].to_numpy(), cell["block"].to_numpy()).T
        if len(x):
            sketch = np.frombuffer(b"".join(cell["sketch"]), np.uint8).reshape(len(ids), -1)
            on = sketches_may_reach(sketch, cell["many"].to_numpy(), cell["total"].to_numpy(), x, y, settings.threshold)
            x, y = x[on], y[on]
        u, v = ids[x], ids[y]
        p, q = classes[x], classes[y]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "low": np.minimum(p, q), "high": np.maximum(p, q)})

    met = cells.groupBy("shingle", "i", "j").applyInPandas(meet, "a bigint, b bigint, low bigint, high bigint")
    return stored(met.groupBy("a", "b", "low", "high").agg(F.count("*").alias("n")), "rare-pairs")


def rare_links(members: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that join all similar texts of ``members`` that are in different classes."""
    known = stored(texts.join(members.select("doc_id"), "doc_id", "left_semi"), "open-texts")
    shingled = stored(text_shingles(known, settings), "shingles")
    rare = stored(rarest(shingled, settings), "rare-shingles")
    pairs = rare_pairs(members, rare, shingled.select("doc_id", "many", "total", "sketch"), settings)
    best = pairs.groupBy("low", "high").agg(F.max(F.struct("n", "a", "b")).alias("p")).select("p.a", "p.b")
    first = stored(verified(best, known, settings).select("a", "b"), "first-links")
    tried = pairs.join(first, ["a", "b"], "left_semi").select("low", "high")
    rest = pairs.join(tried, ["low", "high"], "left_anti").join(best, ["a", "b"], "left_anti").select("a", "b")
    return first.unionAll(stored(verified(rest, known, settings).select("a", "b"), "rest-links"))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, class_id) of all linked nodes: the smallest id that links lead to.

    Every round, a node takes the smallest label next to it, and then the label of that label;
    the number of rounds grows with the logarithm of a chain's length in most graphs.
    """
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select("a", "label", F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        labels = stored(
            hop.join(jump, "next").select("a", F.least("next", "far").alias("new"), "label")
            .select("a", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
    return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("class_id"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of every document: doc_id, copy_of, class_id.

    ``copy_of`` is the smallest id with an equal text, ``class_id`` the smallest id that equal
    texts and links of at least the threshold lead to. A document alone is its own class. Null
    and empty texts, and texts of white space, have no shingles: equal ones are copies of each
    other, and nothing else is linked to them. Rows that repeat an id repeat the result;
    different texts under one id count as one document. Rows without an id get nulls and are not
    compared. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    text = F.col("text")
    print_of = F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("h"), F.octet_length(text).alias("n"))
    prints = rows.where("doc_id is not null").select("doc_id", print_of.alias("print"))
    # Written first, so that a join on a text with very many copies can be split.
    firsts = stored(prints.groupBy("print").agg(F.min("doc_id").alias("copy_of")), "firsts")
    members = stored(prints.join(firsts, "print").select("doc_id", "copy_of"), "copies")
    distinct = members.where("doc_id = copy_of").select("doc_id").distinct()
    classes = near_classes(rows.where("doc_id is not null"), distinct, settings)
    found = members.join(classes.withColumnRenamed("doc_id", "copy_of"), "copy_of", "left").select(
        "doc_id", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"))
    none = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("copy_of"), F.lit(None).cast("bigint").alias("class_id"))
    return found.unionAll(none)


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, that of the smallest id, all columns as they are.

    Rows without an id belong to no class and stay.
    """
    first = near_duplicates(docs, settings).where("doc_id = class_id").select("doc_id").distinct()
    number = "row number"
    while number in docs.columns:
        number += "_"
    # Repeated rows of an id meet in the partition that the join has made anyway.
    one = docs.join(first, "doc_id", "left_semi").withColumn(
        number, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).where(F.col(number) == 1).drop(number)
    return one.unionByName(docs.where("doc_id is null"))
