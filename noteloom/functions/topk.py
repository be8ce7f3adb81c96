"""Running top-k per question inside one task."""

from __future__ import annotations

import numpy as np


class RunningTopK:
    """Best ``k`` (score descending, id ascending) per question over blocks of rows.

    The state is ``questions x k`` whatever the number of rows seen, and the result
    does not depend on how rows are cut into blocks.
    """

    def __init__(self, questions: int, k: int, dtype=np.float64):
        low = -np.inf if np.issubdtype(dtype, np.floating) else np.iinfo(dtype).min
        self.k = k
        self.scores = np.full((questions, k), low, dtype=dtype)
        self.ids = np.full((questions, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.filled = np.zeros(questions, dtype=np.int64)

    def update(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Merge ``scores[row, question]`` where ``allowed[row, question]``."""
        full = self.filled == self.k
        hit = allowed & (~full[None, :] | (scores >= self.scores[:, -1][None, :]))
        for q in np.flatnonzero(hit.any(axis=0)):
            rows = np.flatnonzero(hit[:, q])
            n = self.filled[q]
            s = np.concatenate([self.scores[q, :n], scores[rows, q]])
            i = np.concatenate([self.ids[q, :n], ids[rows]])
            best = np.lexsort((i, -s))[: self.k]
            n = len(best)
            self.scores[q, :n], self.ids[q, :n], self.filled[q] = s[best], i[best], n

    def merge(self, question: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge single candidates: an id and a score for a question, in any order."""
        touched = np.unique(question)
        held = np.arange(self.k)[None, :] < self.filled[touched][:, None]
        q = np.concatenate([np.repeat(touched, self.filled[touched]), question])
        i = np.concatenate([self.ids[touched][held], ids])
        s = np.concatenate([self.scores[touched][held], scores])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = place < self.k
        q, place = q[kept], place[kept]
        self.scores[q, place], self.ids[q, place] = s[kept], i[kept]
        self.filled[touched] = np.bincount(q, minlength=len(self.filled))[touched]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question index, id and score of everything kept."""
        taken = np.arange(self.k)[None, :] < self.filled[:, None]
        question = np.nonzero(taken)[0]
        return question, self.ids[taken], self.scores[taken]
