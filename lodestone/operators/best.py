"""The best few candidates of every query, kept while scores stream past."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Candidates that a task keeps beyond k, so that rounding cannot lose one.
SPARE = 8
SCHEMA = "query_id long, id long, score double"


class Best:
    """For n queries, the `keep` candidates of highest score to six places; ties go to the smaller id."""

    def __init__(self, n: int, keep: int):
        self.keep, self.edge = keep, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.room = 0, max(1 << 18, 4 * keep * n)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.held += len(query)
        if self.held > self.room:
            self.trim()

    def add_block(self, first: int, ids: np.ndarray, score: np.ndarray, least: float = -np.inf) -> None:
        """Scores above `least` of queries first, first + 1 ... (rows) for ids (columns)."""
        if not score.size:
            return
        edge = self.edge[first : first + len(score)]
        if score.shape[1] > self.keep:
            edge = np.maximum(edge, np.partition(score, score.shape[1] - self.keep, axis=1)[:, score.shape[1] - self.keep])
        q, at = np.nonzero((score >= edge[:, None] - 1e-6) & (score > least))
        self.add(q + first, ids[at], score[q, at])

    def trim(self) -> None:
        if not self.parts:
            return
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -np.round(score, 6), query))
        query, ids, score = query[order], ids[order], score[order]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        some = rank < self.keep
        last = rank == self.keep - 1
        self.edge[query[last]] = score[last]
        self.parts, self.held = [(query[some], ids[some], score[some])], int(some.sum())

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        """All that is kept, as rows of SCHEMA."""
        self.trim()
        query, ids, score = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(names[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "id", "score"])
