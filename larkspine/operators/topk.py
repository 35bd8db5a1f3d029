"""Best k of many vectors for each of a block of queries, as vectors stream by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores that are held at once.
SCORES = 4 << 20


def vectors_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``size`` numbers, and them as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    fits = np.flatnonzero((np.diff(ends) == size) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    return fits, values[ends[:-1][fits][:, None] + np.arange(size)] if len(fits) and size else np.zeros((len(fits), size))


class best_rows:
    """The best ``k`` ids for each query by cosine, rounded to six digits; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.length = np.linalg.norm(queries, axis=1)
        self.edge = np.full(len(ids), -np.inf)
        empty = np.zeros(0, np.int64)
        self.query, self.doc, self.score = empty, empty, np.zeros(0)

    def add(self, docs: np.ndarray, vectors: pa.Array, of: np.ndarray | None = None) -> None:
        """Takes rows in, for the queries ``of`` some places only."""
        of = np.arange(len(self.ids)) if of is None else of
        step = max(1, SCORES // max(1, len(of)))
        for a in range(0, len(docs), step):
            self._add(docs[a : a + step], vectors.slice(a, step), of)

    def _add(self, docs: np.ndarray, vectors: pa.Array, of: np.ndarray) -> None:
        fits, m = vectors_of(vectors, self.queries.shape[1])
        score = np.zeros((len(of), len(docs)))
        if len(fits):
            length = np.outer(self.length[of], np.linalg.norm(m, axis=1))
            score[:, fits] = np.where(length == 0, 0.0, self.queries[of] @ m.T / np.where(length == 0, 1, length))
        score = np.round(score, 6) + 0.0
        if len(docs) > self.k:  # no row below the k-th best of these, or of those before, can count
            self.edge[of] = np.maximum(self.edge[of], np.partition(score, len(docs) - self.k, axis=1)[:, len(docs) - self.k])
        q, d = np.nonzero(score >= self.edge[of][:, None])
        self.query = np.concatenate([self.query, of[q]])
        self.doc = np.concatenate([self.doc, docs[d]])
        self.score = np.concatenate([self.score, score[q, d]])
        order = np.lexsort((self.doc, -self.score, self.query))
        self.query, self.doc, self.score = self.query[order], self.doc[order], self.score[order]
        first = np.searchsorted(self.query, self.query)
        place = np.arange(len(self.query)) - first
        last = place == self.k - 1
        self.edge[self.query[last]] = np.maximum(self.edge[self.query[last]], self.score[last])
        keep = place < self.k
        self.query, self.doc, self.score = self.query[keep], self.doc[keep], self.score[keep]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if len(self.query):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.query].astype(np.int64)), pa.array(self.doc.astype(np.int64)), pa.array(self.score)], ["query_id", "doc_id", "score"])
