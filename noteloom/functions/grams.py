"""Trigram expressions for the query side of the keyword channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.binding import let

# The characters that Unicode counts as white space.
BLANK_GRAM = (
    r"^[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
)


def sliding_grams(text: Column) -> Column:
    """Every window of three code points, in order, with repeats; linear in the text."""

    def windows(chars: Column) -> Column:
        n = F.greatest(F.size(chars) - 2, F.lit(0))
        pairs = F.zip_with(
            F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b)
        )
        return F.zip_with(pairs, F.slice(chars, F.lit(3), n), lambda ab, c: F.concat(ab, c))

    return let(F.split(text, ""), windows)


def query_grams(text: Column, limit: int | None = None) -> Column:
    """Distinct trigrams of a question in first-seen order, all or evenly sampled to ``limit``.

    Windows that hold only white space or contain NUL are left out. Sampling keeps
    the first and the last gram; positions between round half to even.
    """
    kept = F.array_distinct(F.filter(sliding_grams(text), lambda g: ~g.rlike(BLANK_GRAM) & ~g.contains("\0")))
    if limit is None:
        return kept
    last = float(limit - 1)
    sample = lambda grams: F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)),
        lambda i: F.get(grams, F.rint(i * (F.size(grams) - 1).cast("double") / F.lit(last)).cast("int")),
    )
    return let(kept, lambda grams: F.when(F.size(grams) > limit, sample(grams)).otherwise(grams))


def word_grams(text: Column) -> Column:
    """The set of padded word trigrams: two blanks before and one after each word."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, sliding_grams)))


def trgm_similarity(left: Column, right: Column) -> Column:
    """Shared word trigrams over all word trigrams; 0 when both sets are empty."""
    pair = F.struct(word_grams(left).alias("a"), word_grams(right).alias("b"))

    def ratio(p: Column) -> Column:
        shared = F.size(F.array_intersect(p["a"], p["b"]))
        union = F.size(p["a"]) + F.size(p["b"]) - shared
        return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)

    return let(pair, ratio)
