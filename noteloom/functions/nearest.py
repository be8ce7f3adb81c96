"""Nearest vectors by cosine over blocks of rows, inside one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from noteloom.functions.topk import RunningTopK

# Similarities are compared after rounding to this many digits, so that equal vectors tie exactly and the id decides.
SCORE_DIGITS = 9
_QUESTIONS, _ROWS = 512, 4096

#: [question, row]: which rows of a block a slice of questions may find.
Allowed = Callable[[np.ndarray, slice], np.ndarray]


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, and the vectors at length 1 in single precision; a zero vector stays zero."""
    squares = (vectors * vectors).sum(axis=1)
    length = np.sqrt(squares)[:, None]
    return squares, np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)


class NearestVectors:
    """The exact best ``k`` rows of each question, whatever the blocks.

    Products are taken in single precision. Only pairs that may reach the k-th best within its
    error are computed in double precision, and these values decide.
    """

    def __init__(self, query: np.ndarray, k: int):
        self.query, self.k = query, k
        self.squares, self.unit = _unit(query)
        self.best = RunningTopK(len(query), k)
        self.margin = (query.shape[1] + 8) * 2.0**-22 + 10.0**-SCORE_DIGITS

    def update(self, vectors: np.ndarray, ids: np.ndarray, among: np.ndarray | None = None, allowed: Allowed | None = None) -> None:
        """Let the questions ``among`` (all by default) see a block; ``allowed`` says which rows each may find."""
        squares, unit = _unit(vectors)
        among = np.arange(len(self.query)) if among is None else among
        for row in range(0, len(ids), _ROWS):
            rows = slice(row, min(row + _ROWS, len(ids)))
            for first in range(0, len(among), _QUESTIONS):
                asked = among[first:first + _QUESTIONS]
                near = self.unit[asked] @ unit[rows].T
                inside = allowed(asked, rows) if allowed else None
                hit = near >= self._floor(asked, near, inside)[:, None]
                if inside is not None:
                    hit &= inside
                q, r = np.divmod(np.flatnonzero(hit), near.shape[1])
                q, r = asked[q], r + row
                norms = np.sqrt(self.squares[q] * squares[r])
                products = np.einsum("ij,ij->i", self.query[q], vectors[r])
                exact = np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
                self.best.merge(q, ids[r], np.round(np.clip(exact, -1.0, 1.0), SCORE_DIGITS))

    def _floor(self, asked: np.ndarray, near: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
        """What a row must reach at least, in single precision, to be among the best of each question."""
        full = self.best.filled[asked] == self.k
        low = np.where(full, self.best.scores[asked, -1] - self.margin, -np.inf)
        waiting = np.flatnonzero(~full)
        if len(waiting) and near.shape[1] >= self.k:
            seen = near[waiting] if inside is None else np.where(inside[waiting], near[waiting], -np.inf)
            low[waiting] = np.partition(seen, -self.k, axis=1)[:, -self.k] - 2 * self.margin
        return np.nextafter(low.astype(np.float32), np.float32(-np.inf))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question index, id and similarity of everything kept."""
        return self.best.rows()
