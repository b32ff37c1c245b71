"""SimHash near-duplicates through vantage-point trees.

1. Each text's words give shingles, each shingle a 64-bit hash; a fingerprint bit
   is the majority of the shingles' bits.  Equal fingerprints collapse to one row.
2. The 64 bits are cut into ``bands``.  Two fingerprints at most ``max_bits``
   apart are at most ``max_bits // bands`` apart in some band, so a forest with
   one tree per band finds every pair, and its narrower balls prune far better
   than a single tree over 64 bits (``bands=1`` gives that one).
3. In a band's tree a node has a vantage point and a radius: fingerprints within
   the radius (Hamming distance in the band) go inside, others outside.  The upper
   levels are built on a bounded sample and cut the fingerprints into shards.  By
   the triangle inequality a fingerprint can only be linked across a boundary if
   its distance to the vantage point is within the band's radius of the boundary;
   it then visits both sides.
4. A shard goes on splitting by the same rule in its task, then compares the exact
   64-bit distance of residents and visitors in blocks.  Links are reduced to a
   spanning forest before they leave the task, so a group of n copies gives at
   most n edges a shard, never all pairs.
5. Components run over the fingerprints' edges as DataFrame jobs.

Shards with more residents or visitors than a task should hold are cut into
blocks, each pair of blocks a task of its own; no rows are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage, map_texts
from tidepool.llm.components import smallest_reachable

#: Fingerprints sampled to place vantage points; residents a shard should hold;
#: visitors a block may hold; residents below which a task stops splitting.
SAMPLE, SHARD_ROWS, VISITOR_ROWS, LEAF_ROWS = 8192, 16384, 262144, 64
SEED = 42


def simhash(text: str | None, shingle: int) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(shingle, len(words))
    starts = np.r_[0, ends[:-1]][:len(words) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, 65536):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + 65536], stops[i:i + 65536])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def hashes(texts: list) -> dict:
        fp = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64)
        return {"fp": pa.array(fp.view(np.int64))}

    return map_texts(docs, hashes, "fp long", id_col, text_col)


@dataclass
class Node:
    vantage: int = 0
    radius: int = -1
    inside: int = -1
    outside: int = -1
    shard: int = -1


def band_masks(bands: int) -> list[np.uint64]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def distances(fps: np.ndarray, vantage, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & mask)


def choose_split(fps: np.ndarray, mask: np.uint64, reach: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """Of some vantage points among the fingerprints the one whose median ball
    sends the fewest to both sides; None if no ball splits them."""
    best = None
    for v in rng.choice(fps, size=min(4, len(fps)), replace=False):
        count = np.bincount(distances(fps, v, mask), minlength=65)
        inside = np.cumsum(count)
        at = np.flatnonzero((inside > 0) & (inside < len(fps)))
        if not len(at):
            continue
        radius = int(at[np.argmin(np.abs(inside[at] - len(fps) / 2))])
        both = count[max(0, radius - reach + 1):radius + reach + 1].sum()
        cost = both + abs(2 * inside[radius] - len(fps))
        if best is None or cost < best[0]:
            best = (cost, int(v), radius)
    return best and best[1:]


class Forest:
    """The upper levels of each band's tree; its leaves are the shards."""

    def __init__(self, sample: np.ndarray, total: int, bands: int, max_bits: int, shard_rows: int):
        self.masks, self.reach = band_masks(bands), max_bits // bands
        self.nodes: list[Node] = []
        self.shards = 0
        rng = np.random.default_rng(SEED)
        scale = total / max(1, len(sample))
        self.roots = [self._grow(sample, m, scale, shard_rows, rng) for m in self.masks]

    def _grow(self, fps: np.ndarray, mask: np.uint64, scale: float, shard_rows: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(node := Node())
        split = choose_split(fps, mask, self.reach, rng) if len(fps) * scale > shard_rows and len(fps) > 1 else None
        if split is None:
            node.shard = self.shards
            self.shards += 1
        else:
            node.vantage, node.radius = split
            near = distances(fps, node.vantage, mask) <= node.radius
            node.inside = self._grow(fps[near], mask, scale, shard_rows, rng)
            node.outside = self._grow(fps[~near], mask, scale, shard_rows, rng)
        return at

    def place(self, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indices of the fingerprints that live there (reach 0) or visit)."""
        for root, mask in zip(self.roots, self.masks):
            todo = [(root, np.arange(len(fps)))]
            while todo:
                at, idx = todo.pop()
                if not len(idx):
                    continue
                node = self.nodes[at]
                if node.shard >= 0:
                    yield node.shard, idx
                    continue
                d = distances(fps[idx], node.vantage, mask).astype(np.int64)
                todo.append((node.inside, idx[d <= node.radius + reach]))
                todo.append((node.outside, idx[d > node.radius - reach]))


def forest_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest node it reaches) for all nodes but the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def shard_links(homes: np.ndarray, visitors: np.ndarray, mask: np.uint64, reach: int,
                max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of all links between residents and visitors of one shard."""
    rng = np.random.default_rng(SEED)
    found_a, found_b, held = [], [], 0
    todo = [(homes, visitors)]
    while todo:
        h, v = todo.pop()
        if not len(h) or not len(v):
            continue
        split = choose_split(h, mask, reach, rng) if len(h) > LEAF_ROWS else None
        if split is not None:
            dh, dv = distances(h, split[0], mask), distances(v, split[0], mask).astype(np.int64)
            todo.append((h[dh <= split[1]], v[dv <= split[1] + reach]))
            todo.append((h[dh > split[1]], v[dv > split[1] - reach]))
            continue
        for i in range(0, len(h), LEAF_ROWS):
            hb = h[i:i + LEAF_ROWS]
            for j in range(0, len(v), 4096):
                vb = v[j:j + 4096]
                apart = np.bitwise_count(hb[:, None] ^ vb[None, :])
                p, q = np.nonzero(apart <= max_bits)
                a, b = hb[p], vb[q]
                other = a != b
                a, b = a[other], b[other]
                if len(a) > len(hb) + len(vb):
                    a, b = forest_edges(a, b)
                if len(a):
                    found_a.append(a)
                    found_b.append(b)
                    held += len(a)
        if held > 4 * (len(homes) + len(visitors)):  # bounds what a dense shard holds
            a, b = forest_edges(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], len(a)
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest_edges(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, bands: int = 4, max_bits: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) spanning edges over a table of distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    if max_bits < 0 or not 1 <= bands <= 64:
        raise ValueError("max_bits must be 0 or more, bands 1 to 64")
    fps = distinct.select("fp")
    total = fps.count()
    sample = [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    forest = Forest(np.array(sample, dtype=np.int64).view(np.uint64), total, bands, max_bits, shard_rows)

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, come = Counter(), Counter()
        for b in it:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s, idx in forest.place(x, 0):
                live[s] += len(idx)
            for s, idx in forest.place(x, forest.reach):
                come[s] += len(idx)
        yield pa.RecordBatch.from_pydict({"shard": pa.array(list(come), pa.int64()),
                                          "n": pa.array([live[s] for s in come], pa.int64()),
                                          "m": pa.array(list(come.values()), pa.int64())})

    # One row per shard: a bounded table, for the number of blocks of each.
    sizes = fps.mapInArrow(count, "shard long, n long, m long").groupBy("shard").agg(F.sum("n"), F.sum("m")).collect()
    blocks = {s: (-(-n // (2 * shard_rows)) or 1, -(-m // VISITOR_ROWS)) for s, n, m in sizes}
    first = dict(zip(blocks, np.cumsum([0, *(h * v for h, v in blocks.values())]).tolist()))
    shard_of = {k: s for s, (h, v) in blocks.items() for k in range(first[s], first[s] + h * v)}
    band_of = _bands_of_shards(forest)

    def deal(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            x = signed.view(np.uint64)
            salt = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for home, reach in ((True, 0), (False, forest.reach)):
                for s, idx in forest.place(x, reach):
                    h, v = blocks[s]
                    for k in range(v if home else h):  # a copy for each block of the other side
                        key = salt[idx] % h * v + k if home else k * v + salt[idx] % v
                        yield pa.RecordBatch.from_pydict({
                            "task": pa.array(first[s] + key), "fp": pa.array(signed[idx]),
                            "home": pa.array(np.full(len(idx), home))})

    masks, within = forest.masks, forest.reach

    def compare(key, rows):
        fp = rows["fp"].to_numpy().view(np.uint64)
        home = rows["home"].to_numpy()
        mask = masks[band_of[shard_of[key[0].as_py()]]]
        a, b = shard_links(fp[home], fp[~home], mask, within, max_bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = fps.mapInArrow(deal, "task long, fp long, home boolean")
    return dealt.groupBy("task").applyInArrow(compare, "a long, b long")


def _bands_of_shards(forest: Forest) -> dict[int, int]:
    out, todo = {}, [(r, k) for k, r in enumerate(forest.roots)]
    while todo:
        at, k = todo.pop()
        node = forest.nodes[at]
        if node.shard >= 0:
            out[node.shard] = k
        else:
            todo += [(node.inside, k), (node.outside, k)]
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bands: int = 4,
                    shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row.

    component_id is the smallest doc_id that the row's fingerprint reaches over
    links of at most ``max_bits`` differing bits, its own rows included.  Texts that
    are null, empty or without words have fingerprint zero, linked like any other.
    Rows with a null doc_id are fingerprinted and linked too; they never name a
    component unless all its ids are null (then it is null).  Repeated ids and rows
    stay.  An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = cut_lineage(smallest_reachable(links(distinct, bands, max_bits, shard_rows)))
    named = roots.join(distinct.withColumnRenamed("fp", "node"), "node")
    lows = named.groupBy("root").agg(F.min("low").alias("reached"))
    reach = roots.join(lows, "root").select(F.col("node").alias("fp"), "reached")
    # Written down, so that the join below has a plain exchange on both sides and
    # Spark can split a fingerprint that very many rows share.
    classes = cut_lineage(distinct.join(reach, "fp", "left").select(
        F.col("fp"), F.coalesce("reached", "low").alias("component_id")))
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
