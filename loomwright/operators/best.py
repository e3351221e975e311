"""The best rows of many queries, kept within a task while their scores go by."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Scores that are worked out at once, and rows that may wait before the worse ones go.
CELLS, WAITING = 1_000_000, 500_000
ROWS = "query_id long, id long, score double"


def rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Scores times 10^digits, rounded as Spark's ``round`` does: halves of the shortest decimal away from zero."""
    scaled = score * 10.0**digits
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Best:
    """The k best rows of each query by rounded score, then by the smaller id. Holds k rows a query and ``WAITING`` more."""

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self.queries, self.k, self.digits = queries, k, digits
        #: No row below this (rounded) can be among the best of a query.
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, first: int, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of rows (columns) for the queries from ``first`` on (rows); -inf is none."""
        least, scale, n = self.least[first : first + len(score)], 10.0**self.digits, score.shape[1]
        if n > self.k and np.isneginf(least).any():
            np.maximum(least, np.floor(np.partition(score, n - self.k, axis=1)[:, n - self.k] * scale) - 1, out=least)
        q, v = np.nonzero((score >= ((least - 1) / scale)[:, None]) & np.isfinite(score))
        if len(q):
            self.held.append((q + first, ids[v], score[q, v]))
            self.waiting += len(q)
            if self.waiting > WAITING + 2 * self.k * len(self.queries):
                self._cut()

    def _cut(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        key = rounded(score, self.digits)
        order = np.lexsort((ids, -key, q))
        q, ids, score, key = q[order], ids[order], score[order], key[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        last = place == self.k - 1
        self.least[q[last]] = key[last]
        kept = place < self.k
        self.held = [(q[kept], ids[kept], score[kept])]
        self.waiting = 0

    def rows(self) -> pa.RecordBatch:
        """query_id, id, score."""
        if self.held:
            self._cut()
        q, ids, score = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.queries[q]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])
