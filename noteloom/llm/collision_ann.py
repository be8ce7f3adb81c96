"""Nearest vectors by collision counting on query-centred windows.

Every projection on a random direction gives one sorted array of the indexed vectors. A query
looks at a window around its own projection in each array. A vector inside the window collides
with the query there; vectors that collide in enough arrays are candidates and are verified
with their exact inner product. Virtual rehashing widens all windows by a constant factor until
enough candidates are found and the radius that the windows stand for covers the k-th of them.

The largest inner product becomes the smallest distance by one more component: vectors are
lengthened to the norm of the longest one, and queries have a zero there and are scaled to that
norm, which leaves their order of products as it is. So that the added component stays small, each
range of norms is an index of its own, whose longest vector sets the norm; every query meets all ranges.

The indexed vectors are dealt out in blocks and the queries in slices, so a task holds one
block and one slice, whatever the number of either. Each cell returns at most k rows a query,
and the k best of all blocks are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """Parameters of the index.

    ``projections`` arrays of which a vector must collide in ``threshold`` (a share of them).
    ``window`` is the half width of the first window and ``growth`` its factor per round, both
    relative to the norm that the vectors are lengthened to. A query stops as soon as it has
    ``spare`` candidates for each of the k wanted ones and ``enough``, a share of the block, besides,
    and the windows cover the k-th of them: a vector at its distance is expected to collide in the
    needed share of the arrays. Norms of one range differ by the factor ``norm_ratio`` at most.
    """

    k: int = 20
    projections: int = 64
    threshold: float = 0.9
    window: float = 1.3
    growth: float = 1.1
    spare: int = 15
    enough: float = 0.13
    norm_ratio: float = 1.1
    block_rows: int = 16_384
    slice_rows: int = 2_048
    seed: int = 7


def usable(vector: str = "embedding"):
    """Vectors with components that are all finite numbers, not all of them zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, norm: float, search: Search):
        rest = np.sqrt(np.maximum(0.0, norm**2 - (vectors**2).sum(axis=1)))
        directions = np.random.default_rng(search.seed).standard_normal((vectors.shape[1] + 1, search.projections))
        self.directions, self.search, self.norm = directions, search, norm
        places = np.column_stack([vectors, rest]) @ directions
        self.order = np.ascontiguousarray(np.argsort(places, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(places, axis=0).T)
        self.vectors = vectors
        self.needed = max(1, int(np.ceil(search.threshold * search.projections)))
        #: Half width of a window, relative to a distance, in which a vector so far away lies with the probability ``threshold``.
        self.cover = NormalDist().inv_cdf((1 + min(search.threshold, 0.999)) / 2)

    def covered(self, near: np.ndarray, query: np.ndarray, half: float) -> bool:
        """Whether windows of the half width cover the k-th best of the candidates, the query's own vector not counted."""
        k = min(self.search.k + 1, len(self.vectors))
        if len(near) < k:
            return False
        kth = np.partition(self.vectors[near] @ query, len(near) - k)[len(near) - k]
        return half >= self.cover * np.sqrt(max(0.0, 2 * self.norm**2 - 2 * kth))

    def candidates(self, queries: np.ndarray, together: int = 128) -> Iterator[np.ndarray]:
        """For each query the places of the vectors that collide often enough.

        Windows are widened until there are enough. Most of an array lies inside the window, so
        what is counted is the rest: first the two tails outside, then what each round gains.
        """
        s, n = self.search, len(self.vectors)
        wanted = min(n, s.spare * s.k + int(s.enough * n))
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        queries = queries * (self.norm / np.where(length > 0, length, 1.0))
        for first in range(0, len(queries), together):
            at = queries[first:first + together] @ self.directions[:-1]
            found: list[np.ndarray | None] = [None] * len(at)
            misses = np.zeros((len(at), n), dtype=np.int16)
            low, high = np.zeros(at.shape, dtype=np.int64), np.zeros(at.shape, dtype=np.int64)
            open_, half, new = np.arange(len(at)), s.window * self.norm, True
            while len(open_):
                a, b = np.empty((len(open_), s.projections), dtype=np.int64), np.empty((len(open_), s.projections), dtype=np.int64)
                for j in range(s.projections):
                    a[:, j] = np.searchsorted(self.sorted[j], at[open_, j] - half, "left")
                    b[:, j] = np.searchsorted(self.sorted[j], at[open_, j] + half, "right")
                for i, q in enumerate(open_):
                    if new:
                        parts = [x for j, o in enumerate(self.order) for x in (o[:a[i, j]], o[b[i, j]:])]
                    else:
                        parts = [x for j, o in enumerate(self.order) for x in (o[a[i, j]:low[q, j]], o[high[q, j]:b[i, j]])]
                    count = np.bincount(np.concatenate(parts), minlength=n)
                    misses[q] += count.astype(np.int16) if new else -count.astype(np.int16)
                    near = np.flatnonzero(misses[q] <= s.projections - self.needed)
                    if (b[i] - a[i] == n).all() or len(near) >= wanted and (len(near) == n or self.covered(near, queries[first + q], half)):
                        found[q] = near
                low[open_], high[open_] = a, b
                open_ = np.array([q for q in open_ if found[q] is None], dtype=np.int64)
                half, new = half * s.growth, False
            yield from found


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector divided by the power of two above its largest component, and the powers' exponents."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponents[:, None]), exponents


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision. What a partial sum overflows is summed in smaller numbers, so only a
    product that is itself beyond the largest double is infinite, and none is undefined."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = vectors @ query
        lost = np.flatnonzero(~np.isfinite(out))
        if len(lost):
            (small, exponents), (other, exponent) = scaled(vectors[lost]), scaled(query[None])
            out[lost] = np.ldexp(small @ other[0], exponents + exponent)
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, search: Search) -> pd.DataFrame:
    """The nearest found of one block for each query: query_id, vec_id, score.

    The index holds the block divided by one power of two, so lengths neither overflow nor vanish;
    scores are products of the vectors as they are.
    """
    _, exponents = scaled(vectors)
    small = np.ldexp(vectors, -exponents.max())
    index = CollisionIndex(small, float(np.linalg.norm(small, axis=1).max()), search)
    out = []
    for q, query, found in zip(query_ids, queries, index.candidates(scaled(queries)[0]), strict=True):
        found = found[ids[found] != q]
        score = products(vectors[found], query)
        if len(found) > search.k:  # ties with the last one stay until ids decide
            last = np.partition(score, len(found) - search.k)[len(found) - search.k]
            keep = score >= last
            found, score = found[keep], score[keep]
        best = np.lexsort((ids[found], -score))[:search.k]
        out.append((np.full(len(best), q), ids[found][best], score[best]))
    parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))


def nearest(vectors: DataFrame, is_query, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest by inner product, in double precision: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Every row is a candidate for every query but the
    rows with the query's own id; nearest come first and ties go to the smaller id. Vectors that
    are null or zero or hold a null, NaN or infinite component take no part, nor do rows
    without an id; a row that repeats an id and a vector counts once; vectors of another
    length than the query's have no product with it. Components of any size take part; a product
    beyond the largest double is an infinite score. Without usable rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & usable("v")).dropDuplicates()
    # Norms are measured beside the largest component, whose square need not fit into a double.
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).withColumn(
        "log_norm", F.log("top") + F.log(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))) / 2)
    # Ranges are centred on the powers of the ratio, so that unit vectors that are rounded share one.
    rows = rows.withColumn("range", F.floor(F.col("log_norm") / F.lit(float(np.log(search.norm_ratio))) + 0.5).cast("int")).drop("top")
    sizes = rows.groupBy("range").agg(F.count("*").alias("n")).collect()
    asked = rows.where(is_query(F.col("vec_id")))
    parts = [(r["range"], b) for r in sizes for b in range(-(-r["n"] // search.block_rows))]
    blocks = {r["range"]: -(-r["n"] // search.block_rows) for r in sizes}
    slices = max(1, -(-asked.count() // search.slice_rows))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def cell(key: tuple, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(
            block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()), queries["vec_id"].to_numpy(),
            np.stack(queries["v"].to_numpy()), search)

    length = F.size("v").alias("length")
    number = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    dealt = rows.select("vec_id", "v", length, "range", F.pmod(F.xxhash64("vec_id"), number[F.col("range")]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    places = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(b).alias("block")) for r, b in parts])
    spread = asked.select("vec_id", "v", length, F.explode(places).alias("place"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int").alias("slice")).select(
        "vec_id", "v", "length", "place.range", "place.block", "slice")
    keys = ["block", "range", "slice", "length"]
    found = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(cell, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= search.k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact result's rows that were found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    wanted = exact.count()
    return hits.count() / wanted if wanted else 1.0
