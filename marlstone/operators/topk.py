"""The k best candidates of a stated query set, kept while a task reads its points."""

from __future__ import annotations

import numpy as np


class RunningTop:
    """For every query the k greatest scores met so far; of equal scores the lesser point stays."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.zeros((queries, 0), np.int64)
        self.points = np.zeros((queries, 0), object)

    def add(self, scores: np.ndarray, points: np.ndarray, ok: np.ndarray | None = None) -> None:
        """``scores`` of all queries against a batch of points; pairs that are not ``ok`` do not count."""
        order = np.argsort(points, kind="stable")
        points, s = points[order], np.where(True if ok is None else ok[:, order], scores[:, order], NONE)
        best = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
        both = np.concatenate((self.scores, np.take_along_axis(s, best, 1)), 1)
        ids = np.concatenate((self.points, points.astype(object)[best]), 1)
        if self.scores.shape[1]:
            rank = np.unique(ids.ravel(), return_inverse=True)[1].reshape(ids.shape)
            keep = np.lexsort((rank, -both), axis=1)[:, : self.k]
            both, ids = np.take_along_axis(both, keep, 1), np.take_along_axis(ids, keep, 1)
        self.scores, self.points = both, ids

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, point, score) of what is left."""
        row, col = np.nonzero(self.scores > NONE)
        return row, self.points[row, col], self.scores[row, col]


NONE = -(1 << 60)
