"""Merkle manifest of a dataset with incremental witnesses.

A document is a leaf, the leaves of a group (language) form a binary tree, and the
groups' roots form one more above them.  A witness holds all that leads from a leaf to
the root: one step per level, either the sibling's side and digest or a mark that the
node had none.

Leaves are dealt into *aligned* blocks of ``1 << BLOCK_BITS``.  A task takes one block as
a stream of appends: a stack of open subtrees, each leaf below them carrying the partial
witness up to its subtree's root.  An append that completes a sibling merges the two
subtrees and extends the witnesses on both sides by the other's digest; what is open at
the block's end is closed in the same way.  The block's root is then an append to the
next level, in blocks of its own, until every group has one root.  A leaf's witness is
its part within the block, then its block's part, and so on: short byte strings joined
end to end, so no task ever holds more than one block.

``append`` adds later documents to a finished manifest: complete blocks keep their
witnesses, only each group's incomplete last block is opened again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import shuffle_partitions
from tidepool.session import shared_dir

#: Leaves of a block: 1024.
BLOCK_BITS = 10
#: Steps of a witness: the sibling stands left or right of the node, or there is none.
LEFT, RIGHT, ALONE = b"<", b">", b"-"


def node_digest(*parts: bytes) -> bytes:
    """H of child digests: sha256 over their lower-case hexadecimal text."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


class OpenSubtrees:
    """The open subtrees of a stream of appended nodes, with a witness for each node."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int, int]] = []  # height, digest, first node, end
        self.witnesses: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._push((0, digest, at, at + 1))

    def _push(self, node: tuple[int, bytes, int, int]) -> None:
        while self.open and self.open[-1][0] == node[0]:
            height, digest, first, end = self.open.pop()
            for w in self.witnesses[first:end]:
                w.append(RIGHT + node[1])
            for w in self.witnesses[node[2]:node[3]]:
                w.append(LEFT + digest)
            node = (height + 1, node_digest(digest, node[1]), first, node[3])
        self.open.append(node)

    def close(self, least_height: int) -> bytes:
        """The root once no more nodes come; nodes without a sibling rise alone."""
        while len(self.open) > 1 or self.open[0][0] < least_height:
            height, digest, first, end = self.open.pop()
            for w in self.witnesses[first:end]:
                w.append(ALONE)
            self._push((height + 1, node_digest(digest), first, end))
        return self.open[0][1]


def steps(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, sibling digest) from the leaf to the root; the digest is empty if alone."""
    at = 0
    while at < len(witness):
        side, at = witness[at:at + 1], at + 1
        size = 0 if side == ALONE else 32
        yield side, witness[at:at + size]
        at += size


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for side, sibling in steps(witness):
        leaf = node_digest(leaf, sibling) if side == RIGHT else node_digest(sibling, leaf) if side == LEFT else node_digest(leaf)
    return leaf


def proof_digest(witness: bytes) -> bytes:
    """H of all siblings from the leaf to the root."""
    return node_digest(*[sibling for _, sibling in steps(witness) if sibling])


def leaf_digest(fields: list[Column]) -> Column:
    """The 32 bytes of a leaf: sha256 over `-` for a null field, else its length in UTF-8
    bytes, a colon and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _kept(df: DataFrame, name: str) -> DataFrame:
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``idx``, their number within ``grp`` by ``order``, and ``n``, the group's
    rows.  Rows are sorted by ranges, so a large group fills many tasks; a range's first
    number comes from the counts of (range, group), a few rows per range."""
    ranges = shuffle_partitions(rows.sparkSession)
    by = ["grp", *order, "__row"]
    placed = (_kept(rows.withColumn("__row", F.monotonically_increasing_id()), "merkle-rows")
              .repartitionByRange(ranges, *by).sortWithinPartitions(*by))
    placed = _kept(placed.drop("__row").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "merkle-order")
    before = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (placed.groupBy(F.col("grp").alias("g"), F.col("part").alias("p"))
              .agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
              .withColumns({"ahead": F.coalesce(F.sum("rows").over(before), F.lit(0)),
                            "n": F.sum("rows").over(Window.partitionBy("g"))}))
    return (placed.join(firsts, (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p")))
            .withColumn("idx", F.col("seq") - F.col("first") + F.col("ahead"))
            .drop("g", "p", "part", "seq", "first", "rows", "ahead"))


def _append_blocks(nodes: DataFrame) -> DataFrame:
    """nodes (grp, idx, n, digest, ...) with ``witness``, the steps within their block, and
    ``block_root`` on each block's first row; written."""
    bits = BLOCK_BITS
    schema = nodes.schema.add("witness", "binary").add("block_root", "binary")

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["idx"].to_numpy(), kind="stable")))
        tree = OpenSubtrees()
        for digest in rows["digest"].to_pylist():
            tree.append(digest)
        root = tree.close(bits if rows["n"][0].as_py() > 1 << bits else 0)
        witnesses = pa.array([b"".join(w) for w in tree.witnesses], pa.binary())
        roots = pa.array([root] + [None] * (rows.num_rows - 1), pa.binary())
        return rows.drop_columns(["block"]).append_column("witness", witnesses).append_column("block_root", roots)

    with_block = nodes.withColumn("block", F.shiftright("idx", bits))
    return _kept(with_block.groupBy("grp", "block").applyInArrow(block, schema), "merkle-blocks")


def _roots_above(level: DataFrame) -> DataFrame:
    """The blocks' roots as the nodes of the next level."""
    return level.where(F.col("block_root").isNotNull()).select(
        "grp", F.shiftright("idx", BLOCK_BITS).alias("idx"), F.ceil(F.col("n") / (1 << BLOCK_BITS)).alias("n"),
        F.col("block_root").alias("digest"))


def _climb(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a level of blocks to every group's root: (grp, digest) of the roots, and
    (grp, block, above), the steps from each block of ``level`` to its group's root."""
    levels, nodes = [], _roots_above(level)
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(_append_blocks(nodes))
        nodes = _roots_above(levels[-1])
    roots = nodes.select("grp", "digest")
    above = nodes.select("grp", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("above"))
    for upper in reversed(levels):
        own = upper.select("grp", "idx", "witness").withColumn("block", F.shiftright("idx", BLOCK_BITS))
        above = own.join(above, ["grp", "block"]).select("grp", F.col("idx").alias("block"), F.concat("witness", "above").alias("above"))
    return roots, above


@dataclass
class Manifest:
    """Blocks of leaves (grp, idx, n, doc_id, digest, witness within the block, block_root
    and the carried columns), in the shared folder."""

    leaves: DataFrame

    def witnesses(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, witness, carried ...): digests as 32 bytes, one row
        per document row."""
        roots, above = _climb(self.leaves)
        roots = _kept(roots, "merkle-subroots")
        top = _append_blocks(_numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), [F.col("key")]))
        top_root, top_above = _climb(top)
        root = top_root.first()
        by_group = top.withColumn("block", F.shiftright("idx", BLOCK_BITS)).join(top_above.drop("grp"), "block").select(
            F.col("key").alias("grp"), F.col("digest").alias("subroot"), F.concat("witness", "above").alias("to_root"))
        paths = _kept(above.join(by_group, "grp").select(
            "grp", "block", "subroot", F.concat("above", "to_root").alias("above")), "merkle-paths")
        out = self.leaves.withColumn("block", F.shiftright("idx", BLOCK_BITS)).join(paths, ["grp", "block"])
        carried = [c for c in self.leaves.columns if c not in ("grp", "idx", "n", "doc_id", "digest", "witness", "block_root")]
        return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root and bytes(root["digest"])).cast("binary").alias("root"),
                          F.concat("witness", "above").alias("witness"), *carried)


def _leaves(docs: DataFrame, id_col: str, group_col: str, fields: tuple[str, ...], carried: dict[str, Column]) -> DataFrame:
    group = F.col(group_col).cast("string")
    return docs.select(F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group)).alias("grp"),
                       F.col(id_col).alias("doc_id"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
                       *[c.alias(name) for name, c in carried.items()])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
          carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table.  Within a group leaves ascend by id: null ids first, equal
    ids by digest; equal rows are leaves of their own.  A null group comes before all
    others.  ``carried`` columns (name to expression over docs) stay beside each leaf."""
    rows = _leaves(docs, id_col, group_col, fields, carried or {})
    return Manifest(_append_blocks(_numbered(rows, [F.col("doc_id"), F.col("digest")])))


def append(manifest: Manifest, docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
           fields: tuple[str, ...] = FIELDS, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest with the documents of ``docs`` behind those it has, in their groups.
    Only incomplete last blocks are opened again; the result equals a build from all."""
    size = 1 << BLOCK_BITS
    held = manifest.leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("held"))
    new = _numbered(_leaves(docs, id_col, group_col, fields, carried or {}), [F.col("doc_id"), F.col("digest")])
    grown = new.groupBy("grp").agg(F.count(F.lit(1)).alias("more"))
    sizes = _kept(held.join(grown, "grp", "full").fillna(0, ["held", "more"]), "merkle-sizes")
    old = manifest.leaves.drop("n").join(sizes, "grp").withColumn("n", F.col("held") + F.col("more"))
    opened = (F.col("more") > 0) & (F.col("idx") >= F.col("held") - F.col("held") % size)
    names = [c for c in manifest.leaves.columns if c not in ("witness", "block_root")]
    late = new.drop("n").join(sizes, "grp").withColumns({"n": F.col("held") + F.col("more"), "idx": F.col("idx") + F.col("held")})
    again = old.where(opened).select(*names).unionByName(late.select(*names))
    return Manifest(_kept(old.where(~opened).select(*manifest.leaves.columns).unionByName(
        _append_blocks(again).select(*manifest.leaves.columns)), "merkle-leaves"))


def audited(witnesses: DataFrame, now_col: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each witness folded
    from the digest ``now_col`` of the document as it is now (null: as it was); all digests
    as lower-case hexadecimal text."""
    rows = witnesses.select("doc_id", "leaf", "subroot", "root", "witness", F.coalesce(now_col, "leaf").alias("now"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            told = b.column(4).to_pylist()
            folded = [fold(now, w) for now, w in zip(b.column(5).to_pylist(), told)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array([proof_digest(w) for w in told], pa.binary()),
                 pa.array(folded, pa.binary())], names=["doc_id", "leaf", "subroot", "root", "proof", "folded"])

    out = rows.mapInArrow(batches, f"doc_id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")
    text = {name: F.lower(F.hex(name)) for name in ("leaf", "subroot", "root", "proof", "folded")}
    return out.select("doc_id", text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
                      text["proof"].alias("proof_sha256"), text["folded"].alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))
