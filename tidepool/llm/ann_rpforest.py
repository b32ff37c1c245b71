"""Approximate nearest neighbours: a forest of random-projection trees.

Fit: each tree splits a bounded sample of the vectors at the median of their
projection on the line between two centres found from random points, down to
small leaves.  Vectors get one more coordinate that brings all to the same length,
so the largest inner product is the smallest angle whatever the lengths.

Index: every row falls into one leaf of every tree.  Rows travel by shard, a run
of neighbouring leaves that fits a task; a leaf with more rows than that (one
vector in a third of all rows, say) is cut into blocks, so no group is unbounded.

Search: one priority queue per query is shared by all trees.  It always opens the
branch whose sum of squared distances to the crossed hyperplanes is smallest, until
the opened leaves hold ``search_share`` of the distinct sample.  The query then
visits the shards of these leaves, where the leaves' candidates are scored
exactly; the best k of each task merge into the final k.  Queries beyond QUERY_ROWS
are dealt into blocks as well: a task is a block of a shard and a block of queries.

The model (a few thousand hyperplanes at most) is all that travels with the tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage
from tidepool.llm.vectors import Best, best_per_query, matrix, usable

#: Vectors the trees are fitted on (at most), vectors of it in a leaf, trees, the
#: share of the sample a query's leaves must hold, index rows and queries of one task.
SAMPLE_ROWS, LEAF_SAMPLE, TREES, SEARCH_SHARE, SHARD_ROWS, QUERY_ROWS = 16384, 32, 4, 0.75, 16384, 16384
FOUND = "query_id long, query long, vec_id long, score double"
SEED = 42


@dataclass
class Tree:
    normals: list = field(default_factory=list)
    offsets: list = field(default_factory=list)
    children: list = field(default_factory=list)  # per inner node; >= 0 a node, else ~leaf
    members: list = field(default_factory=list)  # per leaf: its part of the sample


def _normal(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    a, b = x[rng.choice(len(x), 2, replace=False)]
    few = x[rng.choice(len(x), min(len(x), 256), replace=False)]
    for _ in range(4):
        near = few @ (a - b) > (a + b) @ (a - b) / 2
        if near.all() or not near.any():
            break
        a, b = few[near].mean(axis=0), few[~near].mean(axis=0)
    w = a - b
    size = np.linalg.norm(w)
    return w / size if size else w


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    tree = Tree()

    def grow(idx: np.ndarray) -> int:
        if len(idx) > leaf:
            for _ in range(3):
                w = _normal(x[idx], rng)
                p = x[idx] @ w
                cut = float(np.median(p))
                high = p > cut
                if high.any() and not high.all():
                    at = len(tree.normals)
                    tree.normals.append(w)
                    tree.offsets.append(cut)
                    tree.children.append(None)
                    tree.children[at] = (grow(idx[~high]), grow(idx[high]))
                    return at
        tree.members.append(idx)
        return ~(len(tree.members) - 1)

    tree.root = grow(np.arange(len(x)))
    return tree


class Forest:
    def __init__(self, sample: np.ndarray, longest: float, trees: int, leaf: int):
        rng = np.random.default_rng(SEED)
        self.longest, self.size = longest, len(sample)
        x = self.level(sample)
        self.trees = [fit_tree(x, leaf, rng) for _ in range(trees)]
        self.first = np.cumsum([0, *(len(t.members) for t in self.trees)]).tolist()
        self.members = [m for t in self.trees for m in t.members]

    def level(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0.0))
        return np.c_[x, rest]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree, numbered through."""
        x = self.level(x)
        out = np.empty((len(x), len(self.trees)), dtype=np.int64)
        for t, tree in enumerate(self.trees):
            todo = [(tree.root, np.arange(len(x)))]
            while todo:
                at, idx = todo.pop()
                if at < 0:
                    out[idx, t] = self.first[t] + ~at
                elif len(idx):
                    high = x[idx] @ tree.normals[at] > tree.offsets[at]
                    todo += [(tree.children[at][0], idx[~high]), (tree.children[at][1], idx[high])]
        return out

    def search(self, queries: np.ndarray, share: float) -> list[list[int]]:
        """The leaves each query opens, best first."""
        q = np.c_[queries, np.zeros(len(queries))]
        length = np.linalg.norm(q, axis=1, keepdims=True)
        q = q / np.where(length > 0, length, 1) * self.longest  # only its direction counts
        margins = [q @ np.array(t.normals).T - np.array(t.offsets) if t.normals else None for t in self.trees]
        enough = share * self.size
        out = []
        for r in range(len(q)):
            seen, opened = np.zeros(self.size, dtype=bool), []
            heap = [(0.0, t, tree.root) for t, tree in enumerate(self.trees)]
            held = 0
            while heap and held < enough:
                cost, t, at = heapq.heappop(heap)
                tree = self.trees[t]
                while at >= 0:
                    m = margins[t][r, at]
                    low, high = tree.children[at]
                    at, far = (high, low) if m > 0 else (low, high)
                    heapq.heappush(heap, (cost + m * m, t, far))
                leaf = self.first[t] + ~at
                opened.append(leaf)
                members = self.members[leaf]
                held += len(members) - int(seen[members].sum())
                seen[members] = True
            out.append(opened)
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, leaf_sample: int = LEAF_SAMPLE, search_share: float = SEARCH_SHARE,
            sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found candidates of the largest inner
    product (in doubles, on the original vectors), ties to the smaller vec_id.

    ``is_query`` is a condition on column ``vec_id``.  Rows with a null id or with a
    vector that is null, all zero, or holds null or non-finite components take no
    part.  A query's candidates are the vectors of its own length: every length has a
    forest of its own, over a sample of its distinct vectors.  A query's own row is every
    row with its id; rows equal in id and vector count once.  With ``search_share=1``
    every leaf is opened and the result is exact.
    """
    if k < 1 or not 0 < search_share <= 1:
        raise ValueError("k must be 1 or more, search_share above 0 and at most 1")
    rows = usable(vectors, id_col, vec_col)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where(F.exists("vec", lambda x: x != 0)).withColumn("query", F.xxhash64("vec_id", "vec"))
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(
        F.count("*").alias("n"), F.max(square).alias("far"), F.count_if(is_query).alias("asked")).collect()
    # Vectors travel in the width they came in; single floats are exact as doubles.
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = f"array<{'float' if kind == 'float' else 'double'}>"
    found = [_found(rows.where(F.size("vec") == r.dim), is_query, k, kind, float(np.sqrt(r.far)), r.asked,
                    trees, leaf_sample, search_share, sample_rows, shard_rows)
             for r in sorted(lengths, key=lambda r: r.dim) if r.asked]
    if not found:
        found = [vectors.sparkSession.createDataFrame([], FOUND)]
    return best_per_query(reduce(DataFrame.unionAll, found), k)


def _distinct_sample(rows: DataFrame, sample_rows: int) -> np.ndarray:
    """At most sample_rows distinct vectors, those of the smallest hashes; only hashes are
    shuffled to find them, however often a vector stands in the table."""
    key = F.xxhash64("vec")
    few = cut_lineage(rows.select(key.alias("wanted")).distinct().orderBy("wanted").limit(sample_rows))
    held = rows.select("vec", key.alias("key")).join(F.broadcast(few), F.col("key") == F.col("wanted"), "left_semi")
    return np.array([r.vec for r in held.groupBy("key").agg(F.min("vec").alias("vec")).orderBy("key").collect()])


def _found(rows: DataFrame, is_query: Column, k: int, kind: str, longest: float, n_queries: int, trees: int,
           leaf_sample: int, search_share: float, sample_rows: int, shard_rows: int) -> DataFrame:
    """Candidates (FOUND) of the queries among ``rows``, vectors of one length."""
    forest = Forest(_distinct_sample(rows, sample_rows), longest, trees, leaf_sample)
    turns = -(-n_queries // QUERY_ROWS)  # blocks of queries; each meets a block of a leaf in a task of its own

    def count(it):
        n = np.zeros(len(forest.members), dtype=np.int64)
        for b in it:
            n += np.bincount(forest.leaves(matrix(b.column(0))).ravel(), minlength=len(n))
        yield pa.RecordBatch.from_pydict({"leaf": pa.array(np.arange(len(n))), "n": pa.array(n)})

    # Rows per leaf: as many rows as the forest has leaves.
    sizes = dict(rows.select("vec").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect())
    first_task, blocks = _deal_leaves(forest, sizes, shard_rows)

    def index(it):
        for b in it:
            ids, vec = b.column(0), b.column(1)
            leaves = forest.leaves(matrix(vec))
            for t in range(leaves.shape[1]):
                leaf = leaves[:, t]
                task = first_task[leaf] + np.arange(len(leaf)) % blocks[leaf]
                for turn in range(turns):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task * turns + turn), pa.array(leaf), ids, vec, pa.nulls(len(leaf), pa.int64())],
                        names=["task", "leaf", "vec_id", "vec", "query"])

    def ask(it):
        for b in it:
            opened = forest.search(matrix(b.column(1)), search_share)
            row = np.repeat(np.arange(len(opened)), [len(o) for o in opened])
            leaf = np.concatenate([np.array(o, dtype=np.int64) for o in opened])
            turn = (b.column(2).to_numpy() % turns)[row]
            for k_ in range(int(blocks[leaf].max(initial=0))):  # a query meets every block of a leaf
                on = blocks[leaf] > k_
                at = pa.array(row[on])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((first_task[leaf[on]] + k_) * turns + turn[on]), pa.array(leaf[on]), b.column(0).take(at),
                     b.column(1).take(at), b.column(2).take(at)], names=["task", "leaf", "vec_id", "vec", "query"])

    def score(key, part):
        is_q = part["query"].is_valid().to_numpy()
        leaf, ids, x = part["leaf"].to_numpy(), part["vec_id"].to_numpy(), matrix(part["vec"])
        asked = part["query"].filter(pa.array(is_q)).to_numpy()
        keys, at, which = np.unique(asked, return_index=True, return_inverse=True)
        q_ids, q_x = ids[is_q][at], x[is_q][at]
        best = Best(len(keys), k)
        c_leaf, c_ids, c_x = leaf[~is_q], ids[~is_q], x[~is_q]
        q_leaf = leaf[is_q]
        for one in np.unique(c_leaf):
            rows_in, qs = np.flatnonzero(c_leaf == one), np.unique(which[q_leaf == one])
            for i in range(0, len(rows_in), 1024):
                _score_block(best, q_x, q_ids, qs, c_x[rows_in[i:i + 1024]], c_ids[rows_in[i:i + 1024]])
        best.settle()
        return pa.table({"query_id": pa.array(q_ids[best.q], pa.int64()), "query": pa.array(keys[best.q], pa.int64()),
                         "vec_id": pa.array(best.ids, pa.int64()), "score": pa.array(best.scores, pa.float64())})

    held = f"task long, leaf long, vec_id long, vec {kind}, query long"
    sent = rows.withColumn("vec", F.col("vec").cast(kind))
    indexed = sent.select("vec_id", "vec").mapInArrow(index, held)
    asked = sent.where(is_query).select("vec_id", "vec", "query").mapInArrow(ask, held)
    return _once_per_tree(indexed.unionByName(asked).groupBy("task").applyInArrow(score, FOUND), trees)


def _once_per_tree(found: DataFrame, trees: int) -> DataFrame:
    """A candidate met in several trees counts once (the same rows give equal scores)."""
    return found.distinct() if trees > 1 else found


def _deal_leaves(forest: Forest, sizes: dict, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf its first task and its number of blocks: neighbouring leaves of a
    tree share a task up to ``shard_rows`` rows, a larger leaf has several."""
    n = len(forest.members)
    first, blocks, task, held = np.zeros(n, np.int64), np.ones(n, np.int64), 0, 0
    for leaf in range(n):
        size = sizes.get(leaf, 0)
        if leaf in forest.first or held + size > shard_rows:
            task, held = task + 1, 0
        first[leaf] = task
        held += size
        if size > shard_rows:
            blocks[leaf] = -(-size // shard_rows)
            task, held = task + int(blocks[leaf]) - 1, shard_rows
    return first, blocks


def _score_block(best: Best, q_x: np.ndarray, q_ids: np.ndarray, qs: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    for j in range(0, len(qs), 512):
        some = qs[j:j + 512]
        rough = q_x[some] @ x.T
        own = q_ids[some][:, None] == ids[None, :]
        rough[own] = -np.inf
        # The matrix product may differ in its last bits; it only preselects.
        slack = 1e-9 * (np.abs(rough, where=~own, out=np.zeros_like(rough)).max(initial=0) + 1)
        floor = best.floor[some].copy()
        if rough.shape[1] > best.k:
            floor = np.maximum(floor, np.partition(rough, -best.k, axis=1)[:, -best.k])
        p, c = np.nonzero((rough >= floor[:, None] - slack) & ~own)
        exact = (q_x[some[p]] * x[c]).sum(axis=1)
        best.add(some[p], ids[c], exact)
    if best.held > 2 * best.k * best.n:
        best.settle()
