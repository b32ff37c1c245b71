"""Exact top-k by inner product: columnar branch-and-bound.

Candidates stand in vertical layout (one row per dimension).  For a query the
dimensions are taken block by block, the query's heaviest first; partial products
accumulate, and a candidate is dropped as soon as its partial product plus the
largest possible rest (Cauchy-Schwarz on the remaining masses of both vectors)
cannot reach the k-th best score known.  The survivors are compacted, so later
blocks touch only their columns.

The query set meets all rows in tiles: candidates are dealt into chunks, queries
into blocks, and each (chunk, block) is one bounded task that returns at most k
rows per query.  Nothing is broadcast or collected but two counts per dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.vectors import best_per_query, matrix, usable

CHUNK_ROWS, QUERY_ROWS, BLOCK_DIMS = 8192, 4096, 16
EXACT = 2.0 ** 53


def search_chunk(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole-number vectors: (query row, id, score) of each query's k best by
    inner product, rows with the query's own id left out, ties to the smaller id."""
    dims = x.shape[1]
    by_id = np.argsort(ids, kind="stable")
    ids = ids[by_id]
    xt = np.ascontiguousarray(x[by_id].T)
    safe = dims * np.abs(xt).max(initial=0) * np.abs(queries).max(initial=0) < EXACT
    out_q, out_i, out_s = [], [], []
    for r, q in enumerate(queries):
        live = np.flatnonzero(ids != query_ids[r])
        if not len(live):
            continue
        if not safe:  # beyond exact doubles: whole numbers of any size
            score = np.array([sum(int(a) * int(b) for a, b in zip(q, xt[:, j])) for j in live], dtype=object)
            top = sorted(range(len(live)), key=lambda j: (-score[j], ids[live[j]]))[:k]
            cap = np.iinfo(np.int64)
            pick, s = live[top], np.array([min(max(score[j], cap.min), cap.max) for j in top], dtype=np.int64)
        else:
            pick, s = _bounded(xt, q, live, k)
        out_q.append(np.full(len(pick), r))
        out_i.append(ids[pick])
        out_s.append(s)
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _bounded(xt: np.ndarray, q: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    heavy = np.argsort(-np.abs(q), kind="stable")
    blocks = [heavy[i:i + BLOCK_DIMS] for i in range(0, len(q), BLOCK_DIMS)]
    mass = (xt[:, live] ** 2).sum(axis=0) if len(live) < xt.shape[1] - 1 else _masses(xt)[live]
    rest_q = float(q @ q)
    partial, threshold = np.zeros(len(live)), -np.inf
    for b, block in enumerate(blocks):
        part = xt[block] if len(live) == xt.shape[1] else xt[np.ix_(block, live)]
        partial = partial + q[block] @ part
        mass = np.maximum(mass - (part * part).sum(axis=0), 0.0)
        rest_q = max(rest_q - float(q[block] @ q[block]), 0.0)
        if b + 1 == len(blocks) or len(live) <= k:
            continue
        if b == 0:  # exact scores of the most promising give a first threshold
            lead = live[np.argpartition(-partial, k - 1)[:4 * k]] if len(live) > 4 * k else live
            threshold = np.partition(q @ xt[:, lead], -k)[-k]
        reach = np.sqrt(rest_q * mass)
        threshold = max(threshold, np.partition(partial - reach, -k)[-k])
        keep = partial + reach >= threshold - 0.5  # scores are whole numbers
        if not keep.all():
            live, partial, mass = live[keep], partial[keep], mass[keep]
    if len(live) > k:
        keep = partial >= np.partition(partial, -k)[-k]
        live, partial = live[keep], partial[keep]
    order = np.lexsort((live, -partial))[:k]  # columns stand in order of id
    return live[order], np.rint(partial[order]).astype(np.int64)


_mass_of: tuple = (None, None)


def _masses(xt: np.ndarray) -> np.ndarray:
    global _mass_of
    if _mass_of[0] is not xt:
        _mass_of = (xt, (xt * xt).sum(axis=0))
    return _mass_of[1]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0,
                id_col: str = "vec_id", vec_col: str = "embedding",
                chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of
    floor(scale * x), ties to the smaller vec_id.

    ``is_query`` is a condition on column ``vec_id``.  Rows with a null id, a null
    vector or a null or non-finite component take no part.  A query's own row is
    every row with its id; a query id that stands with several vectors is answered
    for each of them.  Vectors of different lengths never meet.  Fewer than k
    candidates: all.  Scores beyond a long stop at its ends.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).select(
        "vec_id", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vec"))
    rows = rows.withColumn("dim", F.size("vec")).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("m"))
    # One row per vector length, to size the tiles.
    sizes = spark.createDataFrame(
        [(r.dim, max(1, -(-r.n // chunk_rows)), max(1, -(-r.m // query_rows))) for r in counts.collect()],
        "dim int, chunks long, blocks long")
    turn = F.monotonically_increasing_id()  # deals equal rows to different tiles, too
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("turn", turn)
    candidates = dealt.select(
        "dim", F.pmod("turn", "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("long").alias("query"), "vec_id", "vec")
    # A query row that stands several times is asked once.
    asked = dealt.where("is_query").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("vec_id", "vec"), "blocks").alias("block"), F.xxhash64("vec_id", "vec").alias("query"), "vec_id", "vec")
    schema = "query_id long, query long, vec_id long, score long"

    def search(key, tile):
        is_q = tile["query"].is_valid().to_numpy()
        ids, x = tile["vec_id"].to_numpy(), matrix(tile["vec"])
        keys, at = np.unique(tile["query"].filter(pa.array(is_q)).to_numpy(), return_index=True)
        q_ids = ids[is_q][at]
        r, i, s = search_chunk(x[~is_q], ids[~is_q], x[is_q][at], q_ids, k)
        return pa.table({"query_id": pa.array(q_ids[r], pa.int64()), "query": pa.array(keys[r], pa.int64()),
                         "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    found = candidates.unionByName(asked).groupBy("dim", "chunk", "block").applyInArrow(search, schema)
    return best_per_query(found, k)
