"""Quality scores by a sparse ensemble of rules.

Boosted shallow trees over text statistics are grown on a bounded sample of labelled documents.
Every path of a tree, from the root to any node, is a conjunction of comparisons: a rule. A
logistic model with a lasso penalty weighs the rules and drops most of them. What remains is
compiled into a Spark expression, so that scoring is one pass of built-in functions over the
texts, with no Python and no shuffle.

Fitting is small: it sees at most ``Fit.max_documents`` rows of statistics, on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import SPACE_CLASS, held_out, let

#: Names of the statistics; each is computed from the text alone.
STATISTICS = (
    "words", "word_length", "distinct_words", "capitals", "digits", "symbols", "bars", "marks", "stops",
    "distinct_lines", "line_words",
)


@dataclass(frozen=True)
class Fit:
    """``max_documents`` bounds the labelled rows that the model is fitted on."""

    max_documents: int = 6000
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    penalty: float = 2e-3
    steps: int = 600


def statistics(text: Column) -> Column:
    """The statistics of a text as a struct of doubles; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")
    lines = F.array_remove(F.split(text, "\n"), "")
    length = F.length(text)

    def share(part: Column, whole: Column) -> Column:
        return (part / F.greatest(whole, F.lit(1))).cast("double")

    def found(pattern: str) -> Column:
        return share(length - F.length(F.regexp_replace(text, pattern, "")), length)

    return let(words, lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("double").alias("words"),
        share(length, F.size(w)).alias("word_length"),
        share(F.size(F.array_distinct(w)), F.size(w)).alias("distinct_words"),
        found(r"\p{Lu}+").alias("capitals"),
        found(r"[0-9]+").alias("digits"),
        found(r"[#*$%&<>=\\^~]+").alias("symbols"),
        found(r"\|+").alias("bars"),
        found(r"[!?]+").alias("marks"),
        found(r"[.]+").alias("stops"),
        share(F.size(F.array_distinct(x)), F.size(x)).alias("distinct_lines"),
        share(F.size(w), F.size(x)).alias("line_words"))))


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, is greater, bound) that must all hold."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        tests = [values[s] > b if above else values[s] <= b for s, above, b in self.parts]
        return np.logical_and.reduce(tests)

    def compiled(self, of) -> Column:
        tests = [of(s) > b if above else of(s) <= b for s, above, b in self.parts]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass(frozen=True)
class Model:
    """A base log-odds and weighted rules."""

    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, of) -> Column:
        """The probability of label 1, where ``of(name)`` gives a statistic's column."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(rule.compiled(of), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, values: dict[str, np.ndarray]) -> np.ndarray:
        total = self.base + sum((w * r.holds(values) for r, w in self.rules), np.zeros(len(next(iter(values.values())))))
        return 1 / (1 + np.exp(-total))


def simplified(parts: list[tuple[str, bool, float]]) -> Rule:
    """The tightest bound of each statistic and direction."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, bound in parts:
        old = tight.get((name, above))
        tight[name, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return Rule(tuple(sorted((n, a, b) for (n, a), b in tight.items())))


def tree_rules(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, fit: Fit) -> tuple[list[Rule], np.ndarray]:
    """The paths of one tree grown on the gradients, and what the tree adds to every row."""
    rules, gain = [], np.zeros(len(gradient))

    def grow(rows: np.ndarray, parts: list, depth: int) -> None:
        if parts:
            rules.append(simplified(parts))
        g, h = gradient[rows].sum(), hessian[rows].sum()
        gain[rows] = fit.rate * g / (h + 1.0)
        best = (1e-6, 0, 0)
        if depth < fit.depth and len(rows) >= 2:
            for j in range(binned.shape[1]):
                sums = [np.cumsum(np.bincount(binned[rows, j], v, minlength=fit.bins + 1)) for v in (gradient[rows], hessian[rows])]
                value = sums[0]**2 / (sums[1] + 1) + (g - sums[0])**2 / (h - sums[1] + 1) - g**2 / (h + 1)
                k = int(np.argmax(value[:len(edges[j])])) if len(edges[j]) else 0
                if len(edges[j]) and value[k] > best[0]:
                    best = (value[k], j, k)
        if best[0] > 1e-6:
            _, j, k = best
            left = binned[rows, j] <= k
            bound = float(edges[j][k])
            grow(rows[left], [*parts, (STATISTICS[j], False, bound)], depth + 1)
            grow(rows[~left], [*parts, (STATISTICS[j], True, bound)], depth + 1)

    grow(np.arange(len(gradient)), [], 0)
    return rules, gain


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    rate = 1 / (0.25 * (1 + np.linalg.norm(x, 2)**2 / n)) if x.shape[1] else 1.0
    base, w = float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(x.shape[1])
    at, t, back = (base, w), 1.0, (base, w)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(at[0] + x @ at[1]))) - y
        base = at[0] - rate * error.mean()
        w = at[1] - rate * (x.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = (base + (t - 1) / after * (base - back[0]), w + (t - 1) / after * (w - back[1]))
        back, t = (base, w), after
    return back


def fit_model(values: np.ndarray, labels: np.ndarray, fit: Fit = Fit()) -> Model:
    """A model from rows of statistics and labels 0 and 1. With one class only, its smoothed share."""
    y = labels.astype(np.float64)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return Model(base, ())
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, fit.bins + 1)[1:-1], method="lower")) for c in values.T]
    edges = [e[e < c.max()] for e, c in zip(edges, values.T, strict=True)]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, values.T, strict=True)])
    total, rules = np.full(len(y), base), {}
    for _ in range(fit.trees):
        p = 1 / (1 + np.exp(-total))
        found, gain = tree_rules(binned, edges, y - p, p * (1 - p), fit)
        rules |= dict.fromkeys(found)
        total += gain
    columns = dict(zip(STATISTICS, values.T, strict=True))
    held = np.column_stack([r.holds(columns) for r in rules]).astype(np.float64)
    base, weights = lasso_logistic(held, y, fit.penalty, fit.steps)
    return Model(base, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fit on labelled documents outside the holdout.

    At most ``fit.max_documents`` labels are used, those with the smallest hash of their id;
    labels other than 0 and 1 and rows without an id are left out. Only the chosen documents
    are measured. A label counts once: of the texts that share an id, one chosen by its hash is fitted.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct().orderBy(
        order, "doc_id", "quality").limit(fit.max_documents)
    # No more rows than the parameter says, so they can be sent to every task.
    measured = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "quality", F.struct(F.xxhash64("text").alias("key"), statistics(F.col("text")).alias("s")).alias("one")).groupBy(
        "doc_id", "quality").agg(F.min("one").alias("one")).select(*[f"one.s.{n}" for n in STATISTICS], "quality")
    rows = np.array([tuple(r) for r in measured.orderBy(*STATISTICS, "quality").collect()], dtype=np.float64)
    return fit_model(rows[:, :-1], rows[:, -1], fit) if len(rows) else Model(0.0, ())


def quality(model: Model, text: Column) -> Column:
    """The score of a text, as one expression."""
    return let(statistics(text), lambda s: model.score(lambda name: s[name]))


def score_documents(docs: DataFrame, labels: DataFrame, accept: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``accept`` on) of every document.

    Null texts are scored as empty ones; rows that repeat are scored alike; a null id counts as
    an empty one for the holdout. Without usable labels every score is 0.5. An empty table
    gives no rows.
    """
    rows = docs.select("doc_id", "text")
    scored = rows.select("doc_id", quality(train(rows, labels, fit), F.col("text")).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accept_documents(docs: DataFrame, labels: DataFrame, accept: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, all columns as they are."""
    return docs.where(quality(train(docs, labels, fit), F.col("text")) >= accept)
