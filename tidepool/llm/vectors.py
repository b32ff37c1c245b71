"""Vector tables: which rows take part, and columns to arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, vec array<double>): rows whose id and vector are not null and
    whose components are all finite numbers."""
    inf = float("inf")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & sound)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-d array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query by score, ties to
    the smaller vec_id.  ``found`` has these columns and ``query`` (the query
    row's key).  Spark limits each task's groups to k rows before the shuffle."""
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best (score, id) of many queries, fed with pairs in any order."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.q = np.empty(0, np.int64)
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0)
        self.part: list[tuple] = []
        self.held, self.n = 0, n

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Callers may leave out pairs below ``floor[q]``."""
        self.part.append((q, ids, scores))
        self.held += len(q)
        if self.held > 4 * self.k * self.n + 100_000:
            self.settle()

    def settle(self) -> None:
        parts = [(self.q, self.ids, self.scores), *self.part]
        q, ids, scores = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        start = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
        sizes = np.diff(np.r_[start, len(q)]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, sizes) if len(q) else np.empty(0, np.int64)
        keep = rank < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        last = rank == self.k - 1
        self.floor[q[last]] = scores[last]
        self.part, self.held = [], 0
