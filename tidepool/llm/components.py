"""Connected components of an edge table, as DataFrame jobs.

Alternating large-star and small-star steps (Kiveris et al., 2014): every node's
neighbours are re-linked to its smallest neighbour until all edges point at the
smallest node of their component.  Only minima are aggregated, so a hub never
gathers in one task, and edges never reach the driver.  Each round is written to
the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage


def _relink(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """(u, v) -> each kept v of u, linked to the smallest of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("at"), F.least("u", "low").alias("low"))
    near = edges.join(least, edges["u"] == least["at"])
    if keep_larger:
        return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    moved = near.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(least.select(F.col("at").alias("u"), F.col("low").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def smallest_reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node with an edge, the smallest node it reaches.
    Loops and repeated edges do no harm; edges with a null end are left out."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"),
                         F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = cut_lineage(links.where(links[links.columns[2]]).select("u", "v").distinct())
    before = _print(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = cut_lineage(_relink(_relink(both, keep_larger=True), keep_larger=False))
        after = _print(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
