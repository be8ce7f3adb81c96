"""Quality rules whose cutoffs have a proven limit on false rejection, per stratum.

The statistics are expressions over the whole text. Each rule rejects a document whose
statistic, a whole number of thousandths, exceeds a cutoff. Labelled documents tell, for every
stratum, rule and cutoff on a fixed grid, how many good documents the cutoff would reject; a
cutoff is certified if the exact binomial upper bound of that share lies below the rule's part
of the risk, at a confidence divided by the number of strata, rules and cutoffs (so all
statements hold together, whichever cutoff is then chosen). Of the certified cutoffs, the one
that best separates bad from good is used; a rule without one rejects nothing in that stratum.

Everything over documents is DataFrame code. The driver only sees one row of counts for each
stratum that has enough labels for any certificate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import NO_SPACE, SPACE_CLASS, let, stored

#: The characters that count as symbols, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_POSITION_BITS = 21


@dataclass(frozen=True)
class Risk:
    """``share`` of good documents that may be rejected per stratum, with ``confidence``.

    ``cutoffs`` are thousandths, the same grid for all rules.
    """

    share: float = 0.02
    confidence: float = 0.95
    cutoffs: tuple[int, ...] = (20, 50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)


#: Rule names and, for each, numerator and denominator among the statistics.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}


def _covered(starts: Column) -> Column:
    """Words in the windows of three that begin at the given sorted places."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")),
            lambda s: s["n"]))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the list.

    Sorted hashes tell which windows may repeat. Hash and place share one long, so that the
    sort runs on plain numbers; neighbours with equal hashes are compared word by word, and a
    list with a hash collision, or too long for the place bits, is sorted by the words themselves.
    """
    place_mask = (1 << _POSITION_BITS) - 1

    def same(w: Column, i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def place(code: Column) -> Column:
        return code.bitwiseAND(F.lit(place_mask)).cast("int")

    def like(a: Column, b: Column) -> Column:
        return F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)

    def windows(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def by_code(w: Column) -> Column:
        codes = F.sort_array(F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.shiftleft(
            F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), _POSITION_BITS).bitwiseOR(i.cast("long"))))
        followed = lambda c: F.filter(c, lambda x, k: like(x, F.get(c, k + 1)))
        return let(codes, lambda c: let(followed(c), lambda f: F.when(F.size(f) == 0, F.lit(0)).otherwise(twins_covered(w, c))))

    def twins_covered(w: Column, c: Column) -> Column:
        """The words covered by windows with an equal hash; null if such windows differ."""
        twins = F.filter(c, lambda x, k: F.coalesce(like(x, F.get(c, k + 1)), F.lit(False)) | F.coalesce(like(x, F.get(c, k - 1)), F.lit(False)))
        return let(twins, lambda t: F.when(
            F.size(F.filter(t, lambda x, k: like(x, F.get(t, k + 1)) & ~same(w, place(x), place(F.get(t, k + 1))))) > 0,
            F.lit(None).cast("int"),
        ).otherwise(_covered(F.sort_array(F.transform(t, place)))))

    def by_words(w: Column) -> Column:
        windows_at = F.sort_array(F.transform(windows(w), lambda i: F.struct(
            F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("at"))))
        key = lambda s: F.struct(s["a"], s["b"], s["c"])
        return let(windows_at, lambda s: _covered(F.sort_array(F.transform(
            F.filter(s, lambda x, k: F.coalesce(key(x) == key(F.get(s, k - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, k + 1)), F.lit(False))),
            lambda x: x["at"]))))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) > place_mask, by_words(w)).otherwise(
        F.coalesce(by_code(w), by_words(w)))).cast("long")


def text_statistics(text: Column) -> Column:
    """The statistics of a text as a struct; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NO_SPACE))

    def dropped(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    return let(words, lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        dropped(f"[{SYMBOLS}]+").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        dropped(r"\p{Lu}+").alias("n_capitals"))))


BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(of=F.col) -> Column:
    """The base rule; ``of(name)`` gives a statistic's column."""
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEATED_PERCENT * of("n_words"))


def thousandths(rule: str, of=F.col) -> Column:
    part, whole = (of(c) for c in RULES[rule])
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(1000 * part / whole))


def binomial_below(successes: int, trials: int, p: float) -> float:
    """P(X <= successes) for X binomial, summed from the largest term down."""
    if successes >= trials:
        return 1.0
    log_term = (
        math.lgamma(trials + 1) - math.lgamma(successes + 1) - math.lgamma(trials - successes + 1)
        + successes * math.log(p) + (trials - successes) * math.log1p(-p))
    if successes > trials * p:  # not a tail: no certificate can come of it
        return 1.0
    term = total = math.exp(log_term)
    k = successes
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((trials - k + 1) * p)
        total += term
        k -= 1
    return min(1.0, total)


def choose_cutoff(counts: list[tuple[int, int, int]], good: int, bad: int, share: float, error: float) -> int | None:
    """The certified cutoff that separates best, of (cutoff, good rejected, bad rejected).

    A share of rejected good documents of ``share`` or more would show so few rejections with
    a probability of at most ``error``. Ties go to the loosest cutoff. None if no cutoff is
    certified or none rejects anything bad.
    """
    best, found = 0, None
    for cutoff, good_out, bad_out in sorted(counts, reverse=True):
        if binomial_below(good_out, good, share) <= error:
            gain = bad_out * good - good_out * bad
            if gain > best:
                best, found = gain, cutoff
    return found


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str | None, dict[str, int | None]]:
    """The cutoff of each rule (or None) by stratum, for strata with enough labels for any.

    ``measured`` has doc_id, stratum and the statistics; ``labels`` has doc_id and quality (1
    good, 0 bad; others are not used). Labels of documents that fail the base rule do not count.
    A document counts once, however often it or its label is repeated, as the bound holds for
    independent documents; one with both labels counts as bad.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stats = [c for pair in RULES.values() for c in pair]
    joined = measured.where(~base_failed()).select("doc_id", "stratum", *sorted(set(stats))).join(known, "doc_id").dropDuplicates()
    sums = [F.sum((F.col("quality") == q).cast("long")).alias(f"n{q}") for q in (1, 0)]
    for rule in RULES:
        for cut in risk.cutoffs:
            sums += [F.sum(((F.col("quality") == q) & (F.col(rule) > cut)).cast("long")).alias(f"{rule}_{cut}_{q}") for q in (1, 0)]
    counts = joined.select("stratum", "quality", *[thousandths(r).alias(r) for r in RULES]).groupBy("stratum").agg(*sums)
    strata = max(1, measured.select("stratum").distinct().count())
    share = risk.share / len(RULES)
    error = (1 - risk.confidence) / (strata * len(RULES) * len(risk.cutoffs))
    least = math.ceil(math.log(error) / math.log1p(-share))  # below it, not even zero rejections prove anything
    return {
        row.stratum: {
            rule: choose_cutoff([(c, row[f"{rule}_{c}_1"], row[f"{rule}_{c}_0"]) for c in risk.cutoffs], row.n1, row.n0, share, error)
            for rule in RULES}
        for row in counts.where(F.col("n1") >= least).collect()}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """The statistics of every document, with its stratum (a null stratum is one of its own)."""
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit("all")
    return docs.select(
        F.col(id_col).alias("doc_id"), stratum.alias("stratum"), text_statistics(F.col(text_col)).alias("statistics"),
    ).select("doc_id", "stratum", "statistics.*")


def kept(cutoffs: dict[str | None, dict[str, int | None]], stratum: Column, of=F.col) -> Column:
    """Whether a document passes the base rule and the cutoffs of its stratum."""
    verdict = ~base_failed(of)
    for rule in RULES:
        over = F.lit(False)
        for name, cuts in cutoffs.items():
            if cuts[rule] is not None:
                over = over | (stratum.eqNullSafe(F.lit(name).cast("string")) & (thousandths(rule, of) > cuts[rule]))
        verdict = verdict & ~over
    return verdict


def apply_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum_col: str | None = "lang") -> DataFrame:
    """Statistics and verdict of every document of ``docs``, under cutoffs fitted on ``labels``.

    The statistics are written once, so that texts are measured a single time. Null and empty
    texts have no words and fail the base rule; repeated rows are judged alike, each on its own
    row; with no or few labels only the base rule applies. An empty table gives no rows.
    """
    measured = stored(measure(docs, stratum_col=stratum_col), "text-statistics")
    cutoffs = fit_cutoffs(measured, labels, risk)
    return measured.select(
        "doc_id", *BASE_COLUMNS, base_failed().alias("base_failed"), kept(cutoffs, F.col("stratum")).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, without a shuffle of texts."""
    measured = measure(docs, stratum_col=stratum_col).select("doc_id", "stratum", *{c for pair in RULES.values() for c in pair})
    cutoffs = fit_cutoffs(stored(measured, "text-statistics"), labels, risk)
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit("all")
    return docs.where(let(text_statistics(F.col("text")), lambda s: kept(cutoffs, stratum, lambda name: s[name])))
