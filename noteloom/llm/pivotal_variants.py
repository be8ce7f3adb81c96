"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Bigrams are ranked by how many words hold them, rarest first. The prefix of a word is its rarest
bigrams, at least three. One edit spoils at most one of two disjoint bigrams, so of two near words
the one whose prefix ends earlier in the ranking keeps one of any two disjoint bigrams of its
prefix, its pivots, in the prefix of the other, moved by at most one place. Each word is
therefore indexed under its prefix and asks with its pivots alone, which a dynamic program
chooses by the words that share their keys.

The edit lies left of the second pivot or right of the first. In one case both words are equal
from the second pivot to their ends, in the other from their starts to the end of the first. So
keys are whole heads and tails with the length of the word, not bare bigrams, which keeps groups
small; large ones are split into parts. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_slices, stored
from noteloom.session import hinted

#: The least length and occurrences of a word, and by how much a form is more frequent.
MIN_CHARS, MIN_COUNT, FORM_FACTOR = 7, 2, 10

#: Bigrams in a prefix: one edit spoils at most two, so three hold two disjoint ones, of which one stays.
PREFIX_GRAMS = 3
#: An edit can put two more of the same bigram in front of one, so of a repeated bigram two more are indexed.
REPEATS = PREFIX_GRAMS + 2
#: Words of one key that one part of a join holds.
PART_ROWS = 2048


def _runs(min_chars: int) -> re.Pattern[str]:
    return re.compile(rf"[A-Za-zÀ-ÿ]{{{min_chars},}}")


def noised(doc_id: object, run: str, every: int) -> str:
    """The run in lower case (A-Z only); of one in ``every``, by a checksum of document and run, a code point is deleted."""
    raw = run.encode("utf-8").lower()
    word = raw.decode("utf-8")
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode() + raw)
    if every and h % every == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS, delete_every: int = 31,
) -> DataFrame:
    """Every word of at least ``min_chars`` code points in the texts, with its occurrences: word, n.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF; in one of ``delete_every`` distinct
    runs of a document one letter is deleted (0: in none). Counts are combined before they move.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(min_chars)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                total: Counter[str] = Counter()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    for run, n in Counter(runs.findall(text.as_py() or "")).items():
                        word = noised(doc_id, run, delete_every)
                        if len(word) >= min_chars:
                            total[word] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return keyed.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """The rank of each bigram by the number of words that hold it, rarest first.

    There are at most as many as pairs of letters of the alphabet, 90 squared.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()  # bounded like the result
        for batch in batches:
            for word in batch.column("word"):
                text = word.as_py()
                held.update({text[i : i + 2] for i in range(len(text) - 1)})
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])

    grams = words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {gram: rank for rank, (_, gram) in enumerate(sorted((r.n, r.gram) for r in grams.collect()))}


def prefix_places(word: str, ranks: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """The rank at which the prefix ends, the places of its bigrams, and those that can be pivots.

    All bigrams of a lower rank belong to the prefix, and of those at its end the first few. A
    pivot is among the first three of its kind, so that it is among the first five elsewhere.
    """
    order = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = order[PREFIX_GRAMS - 1][0]
    places = [i for rank, i in order if rank < last]
    ends = [i for rank, i in order if rank == last]
    return last, sorted(places + ends[:REPEATS]), sorted(places + ends[:PREFIX_GRAMS])


def letter_bits(word: str) -> int:
    """A bit per letter that occurs an odd number of times, letters sharing 63 bits: one edit flips at most two."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


def _with_prefix(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """``words`` with last, bits, places and pivots of each word."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("word").to_pylist()
            made = [prefix_places(w, known) for w in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.int32()), pa.array([letter_bits(w) for w in texts], pa.int64()),
                 pa.array([m[1] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made], pa.list_(pa.int32()))],
                [*batch.schema.names, "last", "bits", "places", "pivots"])

    return words.mapInArrow(add, "word string, n bigint, last int, bits bigint, places array<int>, pivots array<int>")


def _key(side: str, place: Column, chars: Column) -> Column:
    """The key of a head that ends with the bigram at a place, or a tail that starts with it, of words of a length."""
    word = F.col("word")
    affix = F.substr(word, F.lit(1), place + 2) if side == "head" else F.substr(word, place + 1)
    return F.xxhash64(F.lit(side), affix, chars.cast("int"))


def _index(words: DataFrame) -> DataFrame:
    """A row for each place in the prefix of each word and each side, with the key and how many words have it."""
    places = words.select("word", "n", "last", "bits", F.explode("places").alias("place"), "pivots")
    sides = F.explode(F.array(*(
        F.struct(F.lit(side == "head").alias("head"), _key(side, F.col("place"), F.length("word")).alias("key")) for side in ("head", "tail"))))
    rows = places.select(
        "word", "n", "last", "bits", "place", F.array_contains("pivots", F.col("place")).alias("pivot"), sides.alias("side"),
    ).select("word", "n", "last", "bits", "place", "pivot", "side.head", "side.key")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("fellows")), "key")


def _pivots(index: DataFrame) -> DataFrame:
    """Two disjoint bigrams of each word's prefix whose keys the fewest words share, as places ``first`` and ``second``.

    The best pair that ends with a bigram is the cost of its tail and the best head among the
    bigrams before it; the best of these pairs is taken, ties going to the smaller places.
    """
    def sides(head: bool) -> Column:
        return F.collect_list(F.when(F.col("pivot") & (F.col("head") == head), F.struct("fellows", "place")))

    grams = index.groupBy("word").agg(
        F.first("n").alias("n"), F.first("last").alias("last"), F.first("bits").alias("bits"), sides(True).alias("heads"), sides(False).alias("tails"))

    def pair(tail: Column) -> Column:
        head = F.array_min(F.filter("heads", lambda h: h.place <= tail.place - 2))
        return F.when(head.isNotNull(), F.struct(
            (head.fellows + tail.fellows).alias("cost"), head.place.alias("first"), tail.place.alias("second")))

    best = F.array_min(F.filter(F.transform("tails", pair), lambda p: p.isNotNull()))
    return grams.withColumn("best", best).select("word", "n", "last", "bits", "best.first", "best.second")


#: Above this length the edit distance, whose time grows with the square, gives way to a linear comparison.
LONG_CHARS = 128


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two different words are one edit apart: behind the first letter that differs the rest is equal."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    more = F.length(a) - F.length(b)
    rest = F.substr(a, at + (more >= 0).cast("int")) == F.substr(b, at + (more <= 0).cast("int"))
    short = (F.length(a) <= LONG_CHARS) & (F.length(b) <= LONG_CHARS)
    return F.when(short, F.levenshtein(a, b, 1) == 1).otherwise((a != b) & (F.abs(more) <= 1) & rest)


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of words at edit distance one, in both orders and each once: word, n, near, near_n.

    ``words`` has word (distinct, at least four code points) and n.
    """
    indexed = stored(_index(_with_prefix(words, gram_ranks(words))), "prefix-index")
    parts = F.ceil(F.col("fellows") / PART_ROWS).cast("int")
    crowded = hinted(
        indexed.filter(F.col("fellows") > PART_ROWS).groupBy("key").agg(F.first("fellows").alias("fellows")).select("key", parts.alias("parts")))
    index = indexed.select(
        "key", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("near"),
        F.col("n").alias("near_n"), F.col("last").alias("near_last"), F.col("bits").alias("near_bits"))
    keys = F.explode(F.array(*(
        _key(side, F.col(place), F.length("word") + step)
        for side, place in (("head", "first"), ("tail", "second")) for step in (-1, 0, 1)))).alias("key")
    asking = _pivots(indexed).select("word", "n", "last", "bits", keys).join(crowded, "key", "left")
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    found = asking.join(index, ["key", "part"]).filter(
        (F.col("last") <= F.col("near_last")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("near_bits"))) <= 2)
        & _one_edit(F.col("word"), F.col("near")))
    both = F.explode(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return found.select(both.alias("pair")).select("pair.*").dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """The last of the forms that follow from each word that has one: word, root.

    Every form is ``FORM_FACTOR`` times as frequent as the word before, so a chain has at most 19
    steps, and five rounds of jumps of doubled width reach its end.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(5):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(onward.select("root"), "root", "left_semi").limit(1).count():
            break
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return roots


def group_variants(words: DataFrame) -> DataFrame:
    """Each word with its form and root: word, form, root, n, n_near, form_n.

    ``words`` has word (distinct, at least four code points) and n (its occurrences). ``form`` is
    the most frequent near word (ties: the smallest in code-point order) if that is at least ten
    times as frequent, else null; ``root`` is what following forms ends at, the word itself
    without one; ``n_near`` counts near words.
    """
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    chosen = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    near = stored(near.select(
        "word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "near-words")
    roots = _roots(near.filter(F.col("form").isNotNull()))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``group_variants`` over the words of the texts that occur at least twice.

    A null or empty text has no words, a null id counts as an empty one, repeated rows count
    again, and an empty table gives an empty one. Words of any length are treated alike; other
    columns are not looked at. No group is collected: a key that many words share is split into
    parts of about ``PART_ROWS`` words. All counts cover all texts.
    """
    words = count_words(docs, id_col, text_col, **options)
    return group_variants(words.filter(F.col("n") >= MIN_COUNT))
