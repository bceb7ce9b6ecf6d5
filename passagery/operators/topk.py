"""Best k (score, id) per query over the blocks of one task.

Scores are integers (scaled by the caller), so equal texts tie exactly and the lower id wins on any partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK_BYTES = 64 << 20
SCORE_BYTES = 16 << 20
COMPACT_ROWS = 1 << 20
STRIP = 64
SKIPPED = -(1 << 62)
MERGE_GROUPS = 32


def to_numpy(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


class BestK:
    """`floors` holds the k-th best score known of each of `queries` queries, for `add_above`."""

    def __init__(self, k: int, queries: int = 0) -> None:
        self.k = k
        self.floors = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.most = 0

    def add(self, first: int, score: np.ndarray, ids: np.ndarray, skip: np.ndarray | None = None) -> None:
        """Scores of queries `first`, `first + 1`, ... (rows) for corpus rows in ascending id order (columns)."""
        n = score.shape[1]
        bits = max(n, 2).bit_length()
        take = min(self.k, n)
        if np.abs(score).max(initial=0) < 1 << (61 - bits):
            key = (score << bits) - np.arange(n)
            if skip is not None:
                key[skip] = SKIPPED
            best = np.argpartition(-key, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(score), 1))
            chosen = np.take_along_axis(key, best, axis=1) > SKIPPED
        else:
            key = np.where(skip, SKIPPED, score) if skip is not None else score
            best = np.argsort(-key, axis=1, kind="stable")[:, :take]
            chosen = np.take_along_axis(key, best, axis=1) > SKIPPED
        rows = np.repeat(np.arange(first, first + len(score)), take).reshape(len(score), take)
        found = np.take_along_axis(score, best, axis=1)
        self.parts.append((rows[chosen], found[chosen], ids[best[chosen]]))
        self.rows += int(chosen.sum())
        if self.rows > COMPACT_ROWS:
            self.compact()

    def add_floats(self, first: int, score: np.ndarray, ids: np.ndarray, scale: int) -> None:
        """The same for scores before scaling, of which those at minus infinity are left out. The k-th best of the greatest
        scores of strips of columns bounds the k-th best score from below: only what reaches it is scaled and ordered."""
        strips = score.shape[1] // STRIP
        if strips > self.k:
            tops = score[:, : strips * STRIP].reshape(len(score), strips, STRIP).max(axis=2)
            floor = np.partition(tops, strips - self.k, axis=1)[:, strips - self.k] - 2.0 / scale
            near = score >= floor[:, None]
            if np.count_nonzero(near) <= 8 * self.k * len(score):
                rows, columns = np.nonzero(near & (score > -np.inf))
                self.parts.append((rows + first, np.rint(score[rows, columns] * scale).astype(np.int64), ids[columns]))
                self.rows += len(rows)
                if self.rows > COMPACT_ROWS:
                    self.compact()
                return
        skip = score == -np.inf
        self.add(first, np.rint(np.where(skip, 0.0, score) * scale).astype(np.int64), ids, skip)

    def add_above(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, scale: int) -> None:
        """Scores of the numbered `queries` (rows) before scaling, those of 0 left out. Only what may reach the k-th best score
        known of its query is scaled and ordered."""
        near = (score != 0.0) & (score >= (self.floors[queries] - 1.0)[:, None] / scale)
        if np.count_nonzero(near) <= self.k * len(queries):
            rows, columns = np.nonzero(near)
            found = queries[rows], np.rint(score[rows, columns] * scale).astype(np.int64), ids[columns]
        else:
            part = BestK(self.k)
            part.add(0, np.rint(score * scale).astype(np.int64), ids, ~near)
            rows, scaled, names = part.parts[0]
            found = queries[rows], scaled, names
        self._put(*found)

    def add_pairs(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, scale: int) -> None:
        """The same for single (query, row) pairs."""
        near = score >= (self.floors[queries] - 1.0) / scale
        self._put(queries[near], np.rint(score[near] * scale).astype(np.int64), ids[near])

    def _put(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((rows, score, ids))
        self.rows += len(rows)
        if self.rows > self.most:
            self.compact()
            self.most = min(2 * self.rows + COMPACT_ROWS // 64, COMPACT_ROWS + self.rows)

    def compact(self) -> None:
        if not self.parts:
            return
        rows, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((-score, rows))
        rows, score = rows[order], score[order]
        starts, ends = np.searchsorted(rows, rows, side="left"), np.searchsorted(rows, rows, side="right")
        keep = score >= score[np.minimum(starts + self.k, ends) - 1]
        rows, score, ids = rows[keep], score[keep], ids[order[keep]]
        # ids are ordered only where more than k rows are left, which tie for the last places
        tied = np.flatnonzero(np.bincount(rows)[rows] > self.k)
        _, ordinal = np.unique(ids[tied], return_inverse=True)
        by_id = tied[np.lexsort((ordinal, -score[tied], rows[tied]))]
        score[tied], ids[tied] = score[by_id], ids[by_id]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        if len(self.floors):
            last = place == self.k - 1
            self.floors[rows[last]] = score[last]
        self.parts = [(rows[keep], score[keep], ids[keep])]
        self.rows = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        self.compact()
        if not self.parts:
            return None
        rows, score, ids = self.parts[0]
        _, ordinal = np.unique(ids, return_inverse=True)
        order = np.lexsort((ordinal, -score, rows))
        return rows[order], score[order], ids[order]


def merged(partial: DataFrame, keys: list[str], score: str, id_col: str, k: int, groups: int = MERGE_GROUPS) -> DataFrame:
    """The best k rows per key of what the tasks emitted, with their rank. Each task emits k rows per key, so a key has as
    many as k times the tasks: they are cut to k within groups by id first, and only k times the groups meet in one task."""
    best = [F.col(score).desc(), F.col(id_col)]
    cut = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, *by).orderBy(*best))).filter(F.col("rank") <= k)
    grouped = partial.withColumn("__group", F.pmod(F.xxhash64(id_col), F.lit(groups)))
    return cut(cut(grouped, "__group").drop("__group", "rank"))
