"""The best few rows for each of many queries, kept while batches go by."""

from __future__ import annotations

import numpy as np

DIGITS = 9


class Best:
    """The best ``k`` rows of each query so far, by score at ``DIGITS`` digits, then by the smaller ``tie``.

    However many rows tie, no more than ``k`` of a batch are kept for a query.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = np.zeros((queries, 0), object)
        self.tie = None
        self.score = np.zeros((queries, 0))

    def add(self, ids: np.ndarray, tie: np.ndarray, score: np.ndarray) -> None:
        """Take in a batch of rows; ``score`` has a row for each query and a column for each row of the batch."""
        queries, n = score.shape
        if not queries or not n:
            return
        order = np.argsort(tie, kind="stable")
        if n > self.k:  # in one number, score before place
            key = np.rint(score[:, order] * 10.0**DIGITS).astype(np.int64) * n + np.arange(n - 1, -1, -1)
            top = order[np.argpartition(key, n - self.k, axis=1)[:, n - self.k :]]
        else:
            top = np.broadcast_to(order, (queries, n))
        tie = tie[top] if self.tie is None else np.concatenate([self.tie, tie[top]], axis=1)
        ids = np.concatenate([self.ids, ids[top]], axis=1)
        score = np.concatenate([self.score, np.round(np.take_along_axis(score, top, 1), DIGITS)], axis=1)
        place = np.unique(tie, return_inverse=True)[1].reshape(tie.shape)
        best = np.lexsort((place, -score), axis=1)[:, : self.k]
        self.ids, self.tie, self.score = (np.take_along_axis(x, best, 1) for x in (ids, tie, score))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, tie, score) of what is kept."""
        q = np.repeat(np.arange(self.ids.shape[0]), self.ids.shape[1])
        return q, self.ids.ravel(), self.tie.ravel() if self.tie is not None else np.zeros(0, np.int64), self.score.ravel()
