"""Classes of near duplicates from a dense set of links.

The links of a similarity join grow with the square of a group; what a caller wants is
one row per document.  So links never leave the stage that finds them:

1. Each task thins the links that pass through it to a spanning forest, a run of at most
   FOREST_NODES nodes at a time, and counts the links of every node.  What it hands on is
   bounded by its nodes, not by its links.
2. The forests' edges, a few per node, are contracted to stars: every node is pointed at
   the smallest id in its reach by alternating two joins (to the larger neighbours, then
   to the smaller ones) until nothing changes.  A node's minimum is aggregated map-side
   and joined back, so no node's neighbours are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import shared_dir

#: Nodes of a forest that a task holds before it hands it on.
FOREST_NODES = 200_000
#: Links whose nodes are looked up together.
LINKS_AT_ONCE = 10_000
#: Columns of a forest's rows.
FOREST = "a bigint, b bigint, n bigint"


def spanning_forests(links: DataFrame) -> DataFrame:
    """(a, b, n) from links (a, b) of whole numbers, each link once: edges of spanning
    forests (n null), and links per node as (node, null, n) in parts to be added up."""
    pairs = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    return pairs.mapInArrow(thinned, FOREST)


def thinned(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``spanning_forests`` of the links in the first two columns, within a task.

    Most links of a dense group join what is joined already: a batch's links are compared
    by the tops of their nodes, and only those that differ are walked one by one."""
    above: dict[int, int] = {}
    degree: dict[int, int] = {}
    edges: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def handed_on() -> pa.RecordBatch:
        nodes = list(degree)
        a = [x for x, _ in edges] + nodes
        b = [y for _, y in edges] + [None] * len(nodes)
        n = [None] * len(edges) + [degree[x] for x in nodes]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    for whole in it:
        for at in range(0, whole.num_rows, LINKS_AT_ONCE):
            batch = whole.slice(at, LINKS_AT_ONCE)
            x, y = (batch.column(k).cast(pa.int64()).to_numpy() for k in (0, 1))
            nodes, of, n = np.unique(np.concatenate([x, y]), return_inverse=True, return_counts=True)
            for node, k in zip(nodes.tolist(), n.tolist()):
                degree[node] = degree.get(node, 0) + k
            tops = np.array([top(node) for node in nodes.tolist()], np.int64)[of]
            apart = tops[:len(x)] != tops[len(x):]
            for u, v in zip(x[apart].tolist(), y[apart].tolist()):
                p, q = top(u), top(v)
                if p != q:
                    above[max(p, q)] = min(p, q)
                    edges.append((u, v))
            if len(degree) > FOREST_NODES:
                yield handed_on()
                above.clear()
                degree.clear()
                edges.clear()
    yield handed_on()


def _kept(df: DataFrame, name: str) -> DataFrame:
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _turn(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction of edges (u, v) with u > v.  ``larger``: every node's larger
    neighbours are pointed at the smallest of it and its neighbours; otherwise its smaller
    neighbours and itself are."""
    if larger:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(_kept(least, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _kept(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def contract(edges: DataFrame) -> DataFrame:
    """(node, class) for every node of the edges (a, b): the smallest node it reaches."""
    now = _kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        after = _kept(_turn(_kept(_turn(now, True), "edges"), False), "edges")
        # stars: no node is both pointed at and pointing on
        if after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("class")).unionAll(roots)
        now = after


def components_and_links(links: DataFrame) -> DataFrame:
    """(node, class, links) of every node that stands in a link."""
    return components_of_forests(spanning_forests(links))


def components_of_forests(forests: DataFrame) -> DataFrame:
    """(node, class, links) from the rows of ``spanning_forests``."""
    found = _kept(forests, "forests")
    degrees = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    return contract(found.where(F.col("b").isNotNull()).select("a", "b")).join(degrees, "node")
