"""The k best of each query within one task, for searches whose tasks score Arrow batches of rows against broadcast queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Best:
    """Holds k rows a query at most. ``floor`` is each query's k-th score so far: what lies below it can't be among the k best."""

    def __init__(self, names: pa.Array, query_key: str, key: str, k: int):
        self.names, self.query_key, self.key, self.k = names, query_key, key, k
        self.floor = np.full(len(names), -np.inf)
        self.held: pa.Table | None = None

    def add(self, keys: pa.Array, scores: np.ndarray) -> None:
        """scores: a row per key and a column per query, rounded; -inf is no hit."""
        least = self.floor
        if len(scores) > self.k:  # these rows' own k-th scores
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, q = np.nonzero((scores >= least) & (scores > -np.inf))
        if len(row):
            new = pa.table({"q": q, self.key: keys.take(pa.array(row)), "score": scores[row, q]})
            self.held = self._cut(pa.concat_tables([self.held, new]) if self.held is not None else new)

    def _cut(self, t: pa.Table) -> pa.Table:
        """The k best of each query, ties by key."""
        t = t.sort_by([("q", "ascending"), ("score", "descending"), (self.key, "ascending")])
        q = t["q"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
        full = np.flatnonzero(place == self.k - 1)
        self.floor[q[full]] = t["score"].to_numpy()[full]
        return t.filter(pa.array(place < self.k))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            columns = [self.names.take(self.held["q"].combine_chunks()), self.held[self.key].combine_chunks(), self.held["score"].combine_chunks()]
            yield from pa.table(columns, names=[self.query_key, self.key, "score"]).combine_chunks().to_batches()
