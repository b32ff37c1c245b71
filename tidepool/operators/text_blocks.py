"""Term vectors in blocks, and the near pairs of two blocks.

A join on tokens writes a row for every pair of texts that share one; in prose that is
nearly every pair.  Here the texts' vectors stand in block files in the shared folder,
and a task reads two blocks and finds their near pairs in memory:

1. Fold: the OWN heaviest tokens of all texts have a dimension each, the others share
   SHARED dimensions by hash, where a vector has the root of its squared mass.  By
   Cauchy-Schwarz the folded product is never below the cosine, so no pair is lost.
   It is taken tile by tile, in few dimensions, in more for what is left, then in all.
   A block is folded once for all blocks it meets.
2. Every pair whose folded product reaches the threshold is scored from integer sums
   over its whole vectors: tokens with dimensions of their own by the product of counts
   that the last look has taken, the others from the texts that hold the same token.

Nothing is written per pair of texts, and a block's tokens are numbered within the block
only: there is no table of all tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import checkpoint_root, open_store, shared_dir

#: Entries (distinct tokens of texts) of a block at most, unless one text has more.
BLOCK_ENTRIES = 3_000_000
#: Dimensions of tokens on their own, and shared ones.
OWN, SHARED = 1024, 512
#: Words that are counted together, unless one text has more.
WORDS_AT_ONCE = 1_000_000
#: Where the dimensions of the first and of the second look start.
FIRST_LOOK = [*range(64), *range(64, OWN, 60), *range(OWN, OWN + SHARED, 32)]
SECOND_LOOK = [*range(128), *range(128, OWN, 14), *range(OWN, OWN + SHARED, 8)]
#: Texts of a tile, places of the same token that are summed up at once, and pairs that
#: are scored or handed on at once.
TILE, AT_ONCE, PAIRS_AT_ONCE = 1024, 200_000, 1_000_000
#: Pairs of texts for each of which both hold a token, from which on it has a dimension.
DENSE = 900
#: More than the rounding of a product of folded vectors in single precision.
SLACK = 1e-4


def write_blocks(texts: DataFrame, block_texts: int) -> DataFrame:
    """(path, texts, entries, top), one row per block file, from texts (rep, copies, words:
    array<string>, one at least); written down, so that each later job sees the same files.
    ``top`` has the file's heaviest words and their squared mass."""
    spark = texts.sparkSession
    checkpoint_root(spark)
    folder = shared_dir(spark, "text-blocks")

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held: list[pa.RecordBatch] = []
        texts = entries = n_files = 0

        def written() -> pa.RecordBatch:
            return _filed(_as_row(pa.Table.from_batches(held)), folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{n_files:04d}")

        for batch in (part for whole in it for part in _counted(whole)):
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            at = done = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(ends, done + BLOCK_ENTRIES - entries, side="right"))
                stop = min(fit, at + block_texts - texts)
                if stop <= at and held:   # the block is full
                    yield written()
                    held, texts, entries, n_files = [], 0, 0, n_files + 1
                    continue
                stop = max(stop, at + 1)
                held.append(batch.slice(at, stop - at))
                texts, entries = texts + stop - at, entries + int(ends[stop - 1]) - done
                at, done = stop, int(ends[stop - 1])
        if held:
            yield written()

    def merge(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for batch in it:
            for k, files in enumerate(batch["files"].to_pylist()):
                yield _filed(_merged([_rows(path) for path in files]), folder, f"m{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}")

    files = texts.select("rep", "copies", "words").mapInArrow(write, _FILE).checkpoint()
    # a file is read as often as there are others: small ones are put together once
    blocks = _filled(files.select("path", "texts", "entries").orderBy("path").collect(), block_texts)   # a row per file
    small = [(b,) for b in blocks if len(b) > 1]
    if not small:
        return files
    merged = spark.createDataFrame(spark.sparkContext.parallelize(small, len(small)), "files array<string>").mapInArrow(merge, _FILE)
    alone = [b[0] for b in blocks if len(b) == 1]
    return merged.unionAll(files.where(F.col("path").isin(alone))).checkpoint() if alone else merged.checkpoint()


def _filled(files: list, block_texts: int) -> list[list[str]]:
    """The files (path, texts, entries) that fill a block together."""
    blocks: list[list[str]] = []
    texts = entries = 0
    for r in files:
        if not blocks or texts + r.texts > block_texts or entries + r.entries > BLOCK_ENTRIES:
            blocks.append([])
            texts = entries = 0
        blocks[-1].append(r.path)
        texts, entries = texts + r.texts, entries + r.entries
    return blocks


def _filed(block: pa.RecordBatch, folder: str, name: str) -> pa.RecordBatch:
    """Writes a block file; its row of the list of files."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with store.open_output_stream(f"{root}/{name}.arrow") as out, pa.ipc.new_stream(out, block.schema, options=options) as file:
        file.write_batch(block)
    return pa.RecordBatch.from_pydict({
        "path": [f"{folder}/{name}.arrow"], "texts": pa.array([len(block["size"].values)], pa.int64()),
        "entries": pa.array([len(block["token"].values)], pa.int64()), "top": pa.array([_heaviest(block)], _TOP)})


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(rep, copies, terms: list of (token, tf)) from (rep, copies, words), some texts at a time."""
    sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + WORDS_AT_ONCE, side="right")))
        part = batch.slice(lo, hi - lo)
        coded = part.column(2).flatten().dictionary_encode()
        n_words = max(1, len(coded.dictionary))
        key, tf = np.unique(np.repeat(np.arange(hi - lo), sizes[lo:hi]) * n_words + coded.indices.to_numpy(), return_counts=True)
        start = np.searchsorted(key, np.arange(hi - lo + 1) * n_words)
        term = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % n_words)), pa.array(tf, pa.int64())], names=["token", "tf"])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(start, pa.int32()), term)],
                                         names=["rep", "copies", "terms"])
        lo = hi


def _as_row(table: pa.Table) -> pa.RecordBatch:
    """Vectors as one row of arrays; tokens as numbers of the block's own list of words."""
    rep, copies, terms = (table.column(i).combine_chunks() for i in range(3))
    token, tf = terms.flatten().flatten()
    coded = token.dictionary_encode()
    hashes = pa.array((crc32(w.encode()) for w in coded.dictionary.to_pylist()), pa.int64(), size=len(coded.dictionary))
    columns = {"rep": rep, "copies": copies, "size": pc.list_value_length(terms).cast(pa.int64()),
               "token": coded.indices, "tf": tf, "words": coded.dictionary, "hashes": hashes}
    return _in_order(columns)


#: Columns of a list of files.
_FILE = "path string, texts long, entries long, top array<struct<word string, mass double>>"
_TOP = pa.list_(pa.struct([("word", pa.string()), ("mass", pa.float64())]))


def _heaviest(block: pa.RecordBatch) -> list[dict]:
    """The OWN words of a block file with the largest squared mass in its texts."""
    size, token, tf = (block[k].values.to_numpy() for k in ("size", "token", "tf"))
    text, words = np.repeat(np.arange(len(size)), size), block["words"].values
    squares = tf.astype(float) ** 2
    mass = np.bincount(token, squares / np.bincount(text, squares)[text], len(words))
    top = np.argsort(-mass, kind="stable")[:OWN]
    return [{"word": w, "mass": m} for w, m in zip(words.take(pa.array(top)).to_pylist(), mass[top].tolist())]


def heaviest_words(manifest: DataFrame) -> list[str]:
    """The words that get a dimension on their own: any will do, the heaviest tell most."""
    each = manifest.select(F.explode("top").alias("t")).groupBy(F.col("t.word").alias("word")).agg(F.sum("t.mass").alias("mass"))
    return [r.word for r in each.orderBy(F.col("mass").desc(), "word").limit(OWN).collect()]


@dataclass
class Block:
    rep: pa.Array
    copies: np.ndarray
    norm2: np.ndarray
    start: np.ndarray      # of a text's entries; one more than texts
    token: np.ndarray      # of an entry, a number into words
    tf: np.ndarray
    text: np.ndarray       # of an entry
    words: pa.Array
    hashes: np.ndarray     # of a word


def load(files: tuple[str, ...]) -> Block:
    """The texts of some block files as one block."""
    row = _merged([_rows(path) for path in files])
    size, tf = row["size"].values.to_numpy(), row["tf"].values.to_numpy()
    start = np.concatenate([[0], np.cumsum(size)])
    return Block(row["rep"].values, row["copies"].values.to_numpy(), np.add.reduceat(tf * tf, start[:-1]), start, row["token"].values.to_numpy(),
                 tf.astype(np.int32), np.repeat(np.arange(len(size), dtype=np.int32), size), row["words"].values, row["hashes"].values.to_numpy())


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Block files as one, texts with the same heaviest token together."""
    if len(parts) == 1:
        return parts[0]
    column = {k: pa.concat_arrays([row[k].values for row in parts]) for k in parts[0].schema.names}
    first = np.cumsum([0, *(len(row["words"].values) for row in parts)])
    token = np.concatenate([row["token"].values.to_numpy() + first[k] for k, row in enumerate(parts)])
    coded = column["words"].dictionary_encode()
    of = coded.indices.to_numpy()
    hashes = np.empty(len(coded.dictionary), np.int64)
    hashes[of] = column["hashes"].to_numpy()
    return _in_order({**column, "token": pa.array(of[token], pa.int32()), "words": coded.dictionary, "hashes": pa.array(hashes)})


def _in_order(column: dict[str, pa.Array]) -> pa.RecordBatch:
    """One row of arrays, texts with the same heaviest token together."""
    size, token, tf = (column[k].to_numpy() for k in ("size", "token", "tf"))
    start = np.cumsum(size) - size
    if len(size):
        most = np.repeat(np.maximum.reduceat(tf, start), size)
        heavy = np.minimum.reduceat(np.where(tf == most, token, len(column["words"])), start)
        order = np.argsort(heavy, kind="stable")
        entry = _ranges(start[order], size[order])
        column = {k: v.take(pa.array(order if k in ("rep", "copies", "size") else entry)) if k not in ("words", "hashes") else v for k, v in column.items()}
    return pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays([0, len(v)], v) for v in column.values()], names=list(column))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _looks() -> list[list[int]]:
    """Where the dimensions of a look start, of all dimensions."""
    return [[d for d in look if d < OWN + SHARED] for look in (FIRST_LOOK, SECOND_LOOK)]


class Folded:
    """A block's vectors in the dimensions of ``own`` words and in the shared ones."""

    def __init__(self, block: Block, own: Sequence[str]):
        n, every = len(block.norm2), OWN + SHARED
        at = pc.index_in(block.words, pa.array(own, block.words.type)).fill_null(-1).to_numpy()
        self.dim = np.where(at >= 0, at, OWN + block.hashes % max(1, SHARED)).astype(np.int32)   # of a word
        # counts are whole in single precision up to here
        self.counts = np.zeros((n, OWN), "f4" if int(block.norm2.max(initial=0)) < 2 ** 48 else "f8")
        self.shared = np.zeros((n, SHARED), "f4")
        self.norm = np.sqrt(block.norm2.astype(float))
        self.looks = [np.zeros((n, len(look)), "f4") for look in _looks()]
        for i in range(0, n, TILE):
            end = min(n, i + TILE)
            entries = slice(block.start[i], block.start[end])
            text, dim, tf = block.text[entries], self.dim[block.token[entries]], block.tf[entries]
            w2 = tf.astype(float) ** 2 / block.norm2[text]
            squares = np.bincount((text - i).astype(np.int64) * every + dim, w2, (end - i) * every).reshape(-1, every)
            self.shared[i:end] = np.sqrt(squares[:, OWN:])
            for seen, look in zip(self.looks, _looks()):
                seen[i:end] = np.sqrt(np.add.reduceat(squares, look, axis=1))
            on_own = dim < OWN
            self.counts[text[on_own], dim[on_own]] = tf[on_own]

    def holders(self, block: Block, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts and counts of the tokens that share dimensions (``every``: of all tokens),
        by token, and where a token's start."""
        if getattr(self, "_holders", (None,))[0] is not every:
            entry = np.arange(len(block.token)) if every else np.flatnonzero(self.dim[block.token] >= OWN)
            token = block.token[entry]
            entry = entry[np.argsort(token)]
            start = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(block.words)))])
            self._holders = every, (block.text[entry], block.tf[entry], start.astype(np.int32 if len(entry) < 2 ** 31 else np.int64))
        return self._holders[1]


def folded(block: Block, own: Sequence[str]) -> Folded:
    """The block folded; kept as long as the block is, for the same list of words."""
    if getattr(block, "_folded", (None,))[0] is not own:
        block._folded = own, Folded(block, own)
    return block._folded[1]


def _own_words(a: Block, b: Block) -> list[str]:
    """The heaviest words of two blocks."""
    mass: dict[str, float] = {}
    for block in (a, b):
        of = np.bincount(block.token, block.tf.astype(float) ** 2 / block.norm2[block.text], len(block.words))
        top = np.argsort(-of, kind="stable")[:OWN]
        for w, m in zip(block.words.take(pa.array(top)).to_pylist(), of[top].tolist()):
            mass[w] = mass.get(w, 0) + m
    return sorted(mass, key=lambda w: (-mass[w], w))[:OWN]


def near(a: Block, b: Block, min_cos: float, own: Sequence[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts of a, texts of b, cosines) of all pairs of at least ``min_cos``, in parts; of
    a block with itself, each pair once.  ``own``: words with a dimension on their own, OWN
    at most."""
    own = _own_words(a, b) if own is None else own
    fold_a, fold_b = folded(a, own), folded(b, own)
    scores = _Scores(a, b, fold_a, fold_b)
    least = np.float32(min_cos - SLACK)
    for i in range(0, len(a.norm2), TILE):
        held: list[tuple[np.ndarray, ...]] = []
        for j in range(i if a is b else 0, len(b.norm2), TILE):
            rows, cols = np.arange(i, min(i + TILE, len(a.norm2))), np.arange(j, min(j + TILE, len(b.norm2)))
            for look_a, look_b in zip(fold_a.looks, fold_b.looks):
                seen = look_a[rows] @ look_b[cols].T >= least
                rows, cols = rows[seen.any(1)], cols[seen.any(0)]
                if not len(rows):
                    break
            else:
                dot = scores.on_own(rows, cols)
                bound = dot / (fold_a.norm[rows].astype("f4")[:, None] * fold_b.norm[cols].astype("f4"))
                bound += fold_a.shared[rows] @ fold_b.shared[cols].T
                seen = bound >= least
                if a is b and i == j:
                    seen &= rows[:, None] < cols
                x, y = np.nonzero(seen)
                if len(x):
                    held.append((rows[x], cols[y], dot[x, y]))
            if held and (sum(len(h[0]) for h in held) > PAIRS_AT_ONCE or j + TILE >= len(b.norm2)):
                x, y, dot = (np.concatenate(c) for c in zip(*held))
                held = []
                dot = scores.whole(x, y, dot)
                cosine = dot / (fold_a.norm[x] * fold_b.norm[y])
                kept = (dot > 0) & (cosine >= min_cos)
                if kept.any():
                    yield x[kept], y[kept], cosine[kept]


class _Scores:
    """Integer products of pairs of two blocks' texts: of the tokens with a dimension on
    their own by matrices, of the others from b's texts that hold a's token."""

    def __init__(self, a: Block, b: Block, fold_a: Folded, fold_b: Folded):
        self.a, self.b, self.fold_a, self.fold_b = a, b, fold_a, fold_b
        # doubles hold every sum up to this; beyond, all tokens are summed as whole numbers
        self.by_matrix = max(int(a.norm2.max(initial=0)), int(b.norm2.max(initial=0))) < 2 ** 53
        self.in_b = None

    def on_own(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Products over the tokens with a dimension on their own; no sum is above the
        product of two norms, and single precision holds whole numbers below 2^24."""
        x, y = self.fold_a.counts[rows], self.fold_b.counts[cols]
        if self.fold_a.norm[rows].max() * self.fold_b.norm[cols].max() >= 2 ** 24:
            x, y = x.astype("f8"), y.astype("f8")
        return x @ y.T

    def whole(self, x: np.ndarray, y: np.ndarray, dot: np.ndarray) -> np.ndarray:
        """The products over all tokens of pairs (x, y), from those of ``on_own``."""
        a, b = self.a, self.b
        if self.in_b is None:
            self.in_b = np.arange(len(a.words)) if a is b else pc.index_in(a.words, b.words).fill_null(-1).to_numpy()
        text, tf, start = self.fold_b.holders(b, not self.by_matrix)
        rows, row_of = _numbered(x, len(a.norm2))
        cols, col_of = _numbered(y, len(b.norm2))
        col = col_of[text]
        there = col >= 0
        before = np.zeros(len(there) + 1, start.dtype)
        np.cumsum(there, dtype=start.dtype, out=before[1:])
        there, start = np.flatnonzero(there), before[start]
        col, tf = col[there], tf[there]
        entry = _ranges(a.start[rows], a.start[rows + 1] - a.start[rows])
        if self.by_matrix:
            entry = entry[self.fold_a.dim[a.token[entry]] >= OWN]
        token = self.in_b[a.token[entry]]
        n = np.where(token >= 0, start[token + 1] - start[token], 0)
        entry, token, n = entry[n > 0], token[n > 0], n[n > 0]
        row = row_of[a.text[entry]].astype(np.int64)
        mine = a.tf[entry].astype("f8" if self.by_matrix else "i8")
        sums = np.zeros((len(rows), len(cols)), mine.dtype)
        if self.by_matrix:
            # what many of both hold: a matrix is cheaper than a place for each two holders
            many = np.bincount(token, minlength=len(start) - 1) * np.diff(start) * DENSE > sums.size
            kind = "f4" if self.fold_a.norm[rows].max() * self.fold_b.norm[cols].max() < 2 ** 24 else "f8"
            dims = np.flatnonzero(many)
            dim_of = np.zeros(len(many), np.int64)
            dim_of[dims] = np.arange(len(dims))
            heavy = many[token]
            dim, row_at, count = dim_of[token[heavy]], row[heavy], mine[heavy]
            for lo in range(0, len(dims), OWN):
                part = dims[lo:lo + OWN]
                here = (dim >= lo) & (dim < lo + OWN)
                left, right = np.zeros((len(rows), len(part)), kind), np.zeros((len(cols), len(part)), kind)
                left[row_at[here], dim[here] - lo] = count[here]
                sizes = start[part + 1] - start[part]
                place = _ranges(start[part], sizes)
                right[col[place], np.repeat(np.arange(len(part)), sizes)] = tf[place]
                sums += left @ right.T
            row, mine, token, n = row[~heavy], mine[~heavy], token[~heavy], n[~heavy]
        first = start[token]
        ends = np.searchsorted(row, np.arange(len(rows)), side="right")   # of a row's entries
        done = np.concatenate([[0], np.cumsum(n)])
        lo = 0
        while lo < len(rows):
            at = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(done[ends], done[at] + AT_ONCE, side="right")))
            part = slice(at, int(ends[hi - 1]))
            place = _ranges(first[part], n[part])
            key = np.repeat((row[part] - lo) * len(cols), n[part]) + col[place]
            product = np.repeat(mine[part], n[part]) * tf[place]
            if self.by_matrix:
                sums[lo:hi] += np.bincount(key, product, (hi - lo) * len(cols)).reshape(-1, len(cols))
            else:
                np.add.at(sums[lo:hi].reshape(-1), key, product)
            lo = hi
        found = sums[row_of[x], col_of[y]].astype(np.int64)
        return found + dot.astype(np.int64) if self.by_matrix else found


def _numbered(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (below n) in order, and the number of each value, or -1."""
    there = np.zeros(n, bool)
    there[values] = True
    distinct = np.flatnonzero(there)
    number = np.full(n, -1, np.int32)
    number[distinct] = np.arange(len(distinct))
    return distinct, number


def block_files(manifest: DataFrame) -> list[str]:
    return [r.path for r in manifest.select("path").orderBy("path").collect()]   # a row per file


def block_pairs(spark: SparkSession, n: int) -> DataFrame:
    """(i, first, stop): two of n blocks, i and i + 1, and the run of blocks that they meet
    in a task.  Every two blocks meet once, each with itself too; a few runs for each
    partition of a shuffle, and one for each two blocks at least."""
    run = max(1, -(-n * (n + 1) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    runs = [(i, j, min(j + run, n)) for i in range(0, n, 2) for j in range(i, n, run)]
    return spark.createDataFrame(spark.sparkContext.parallelize(runs, max(1, len(runs))), "i int, first int, stop int")


def near_in_blocks(it: Iterable[pa.RecordBatch], min_cos: float, files: Sequence[str], own: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(a_id, b_id, cosine, a_copies, b_copies) with a_id < b_id, from ``block_pairs``."""
    for batch in it:
        for i, first, stop in zip(*(batch[k].to_pylist() for k in ("i", "first", "stop"))):
            two = {k: load((files[k],)) for k in range(i, min(i + 2, stop))}
            for j in range(first, stop):
                b = two[j] if j in two else load((files[j],))
                for k in range(i, min(i + 2, j + 1)):
                    yield from _pairs_of(two[k], b, min_cos, own)
                del b   # before the next one comes


def _pairs_of(a: Block, b: Block, min_cos: float, own: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for found in near(a, b, min_cos, own):
        for at in range(0, len(found[0]), PAIRS_AT_ONCE):
            x, y, cosine = (v[at:at + PAIRS_AT_ONCE] for v in found)
            ids = a.rep.take(pa.array(x)), b.rep.take(pa.array(y))
            copies = pa.array(a.copies[x]), pa.array(b.copies[y])
            turned = pc.greater(*ids)
            out = pa.RecordBatch.from_arrays(
                [pc.if_else(turned, ids[1], ids[0]), pc.if_else(turned, ids[0], ids[1]), pa.array(cosine),
                 pc.if_else(turned, copies[1], copies[0]), pc.if_else(turned, copies[0], copies[1])],
                names=["a_id", "b_id", "cosine", "a_copies", "b_copies"])
            yield out.filter(pc.less(out["a_id"], out["b_id"]))


def _rows(path: str) -> pa.RecordBatch:
    store, name = open_store(path)
    with store.open_input_stream(name) as file:
        return pa.ipc.open_stream(file).read_all().combine_chunks().to_batches()[0]


def scores_of(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, class: ids of texts, whole numbers) with the cosine of each pair.

    A class's vector travels once to every file that holds a node of it, and a task scores
    the nodes of one file."""
    def places(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch["path"].to_pylist():
                ids = _rows(path)["rep"].values.cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([path] * len(ids), pa.string())], names=["id", "path"])

    def vectors(key, ids):
        row = _rows(key[0].as_py())
        size, tf = row["size"].values.to_numpy(), row["tf"].values
        ends = np.cumsum(size)
        at = pc.index_in(ids["class"].combine_chunks(), row["rep"].values.cast(pa.int64())).to_numpy()
        entry = pa.array(_ranges(ends[at] - size[at], size[at]))
        offsets = pa.array(np.concatenate([[0], np.cumsum(size[at])]), pa.int32())
        words = row["words"].values.take(row["token"].values.take(entry))
        return pa.table({"class": ids["class"], "words": pa.ListArray.from_arrays(offsets, words.cast(pa.string())),
                         "tfs": pa.ListArray.from_arrays(offsets, tf.take(entry))})

    def score(key, nodes, classes):
        row = _rows(key[0].as_py())
        size, token, tf = (row[k].values.to_numpy() for k in ("size", "token", "tf"))
        ends, words = np.cumsum(size), row["words"].values
        at = pc.index_in(nodes["node"].combine_chunks(), row["rep"].values.cast(pa.int64())).to_numpy()
        of = pc.index_in(nodes["class"].combine_chunks(), classes["of"].combine_chunks()).to_numpy()
        w, k = classes["words"].combine_chunks(), classes["tfs"].combine_chunks()
        here = pc.index_in(w.flatten(), words.cast(pa.string())).fill_null(len(words)).to_numpy().astype(np.int64)
        counts, stops = k.flatten().to_numpy(), np.cumsum(pc.list_value_length(w).to_numpy())
        count, out, last = np.zeros(len(words) + 1, np.int64), np.zeros(len(at)), None
        for i in np.argsort(of, kind="stable").tolist():
            if of[i] != last:
                count[:] = 0
                last = of[i]
                own = slice(stops[last - 1] if last else 0, stops[last])
                count[here[own]] = counts[own]
                count[-1] = 0
                norm = np.sqrt(float((counts[own] * counts[own]).sum()))
            entries = slice(ends[at[i]] - size[at[i]], ends[at[i]])
            mine = tf[entries]
            out[i] = float((count[token[entries]] * mine).sum()) / (np.sqrt(float((mine * mine).sum())) * norm)
        return pa.table({"node": nodes["node"], "class": nodes["class"], "cosine": pa.array(out)})

    places_of = manifest.select("path").mapInArrow(places, "id bigint, path string").groupBy("id").agg(F.min("path").alias("path"))
    at_node = wanted.join(places_of.withColumnRenamed("id", "node"), "node").select("path", "node", "class").checkpoint()
    classes = at_node.select("class").distinct().join(places_of.withColumnRenamed("id", "class"), "class")
    found = classes.groupBy("path").applyInArrow(vectors, "class bigint, words array<string>, tfs array<bigint>")
    needed = at_node.select("path", "class").distinct().join(found, "class").select(
        F.col("path").alias("file"), F.col("class").alias("of"), "words", "tfs")
    return at_node.groupBy("path").cogroup(needed.groupBy("file")).applyInArrow(score, "node bigint, class bigint, cosine double")
