"""The best of many scores, kept by a task."""

from __future__ import annotations

import numpy as np


class Best:
    """Of each of n queries the k best scores with their identifiers (ties: the lesser identifier), over batches of scores. What can't be
    among them is left out by one comparison with the query's k-th best, so only the others are rounded and sorted."""

    def __init__(self, n: int, k: int, digits: int = 6):
        self.n, self.k, self.digits = n, k, digits
        self.low, self.low_id = np.full(n, -1e300), np.full(n, np.iinfo(np.int64).max)
        self.q, self.id, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, scores, ids) -> None:
        """scores: a row a query, a column an identifier; -inf is no candidate."""
        if not scores.size:
            return
        margin, width = 10.0**-self.digits, scores.shape[1]
        low = self.low - margin
        new = np.flatnonzero(self.low <= -1e300)
        if len(new) and width > self.k:
            low[new] = np.maximum(low[new], np.partition(scores[new], width - self.k, axis=1)[:, width - self.k] - margin)
        rows, cols = np.nonzero(scores >= low[:, None])
        s, at = np.round(scores[rows, cols], self.digits), np.asarray(ids, np.int64)[cols]
        keep = (s > self.low[rows]) | ((s == self.low[rows]) & (at < self.low_id[rows]))
        if not keep.any():
            return
        q, at, s = (np.concatenate(x) for x in ((self.q, rows[keep]), (self.id, at[keep]), (self.s, s[keep])))
        order = np.lexsort((at, -s, q))
        q, at, s = q[order], at[order], s[order]
        many = np.bincount(q, minlength=self.n)
        place = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
        last = place == self.k - 1
        self.low[q[last]], self.low_id[q[last]] = s[last], at[last]
        kept = place < self.k
        self.q, self.id, self.s = q[kept], at[kept], s[kept]
