"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch of texts stand as ragged numpy arrays: one
flat array of symbols, one of sequence numbers.  In each round every sequence
finds its own lowest-rank pair and merges it at all places at once; a sequence
leaves when it has no pair left.  What survives is counted, and a text's count
is the sum over its pre-tokens.

One narrow pass, no shuffle.  Memory: one Arrow batch, its distinct pre-tokens
and a bounded table of counts already known.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.byte_bpe import ByteBpe, load_byte_bpe
from tidepool.llm.common import map_texts

NO_PAIR = np.iinfo(np.int32).max


class RankSyncCounter:
    #: Known pre-tokens kept between batches, their length at most (long ones hardly
    #: repeat), and symbols merged at once.
    KNOWN, LONG, SYMBOLS = 400_000, 100, 4_000_000

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        pairs = np.array(list(bpe.pair_rank), dtype=np.int64).reshape(-1, 2)
        ranks = np.array(list(bpe.pair_rank.values()), dtype=np.int32)
        # An open table over the pair's key: a multiplicative hash, linear probing.
        self.shift = np.uint64(64 - 18)
        self.keys = np.full(1 << 18, -1, dtype=np.int64)
        self.ranks = np.full(1 << 18, NO_PAIR, dtype=np.int32)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        self.probes = 1
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(left), dtype=bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.ranks[slot[take]] = key[left[take]], ranks[left[take]]
            left, slot = left[~take], (slot[~take] + 1) & (len(self.keys) - 1)
            self.probes += 1
        self.merged = np.array(bpe.merged, dtype=np.int64)
        self.byte_id = np.array(bpe.byte_id, dtype=np.int64)
        self.known: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NO_PAIR)
        open_ = np.flatnonzero((out == NO_PAIR) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def survivors(self, raws: list[bytes], left: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Number of symbols left in each sequence after all merges.  ``left`` takes the
        symbols themselves: arrays (sequence, symbol) as sequences finish, each sequence
        in one of them, in order."""
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        counts = sizes.copy()
        sym = self.byte_id[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(raws)), sizes)
        rank = self._ranks_within(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest != NO_PAIR
            if not alive.all():  # finished sequences leave
                lens = np.diff(np.r_[starts, len(seq)])
                keep = np.repeat(alive, lens)
                if left is not None:
                    left.append((seq[~keep], sym[~keep]))
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                if not len(sym):
                    break
                lowest, lens = lowest[alive], lens[alive]
            else:
                lens = np.diff(np.r_[starts, len(seq)])
            hit = rank == np.repeat(lowest, lens)
            # In a run of the same symbol hits overlap: every second one counts.
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
            first = at[np.r_[True, np.diff(at) != 1]]
            at = at[(at - first[run]) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[at + 1] = True
            counts -= np.bincount(seq[at], minlength=len(counts))
            touched = np.zeros(len(sym), dtype=bool)
            touched[at] = True
            keep = ~gone
            sym, seq, rank, touched = sym[keep], seq[keep], rank[keep], touched[keep]
            redo = touched.copy()
            redo[:-1] |= touched[1:]
            i = np.flatnonzero(redo)
            rank[i] = NO_PAIR
            i = i[i < len(sym) - 1]
            i = i[seq[i] == seq[i + 1]]
            rank[i] = self.pair_ranks(sym[i], sym[i + 1])
        return counts

    def _ranks_within(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), NO_PAIR, dtype=np.int32)
        i = np.flatnonzero(seq[1:] == seq[:-1])
        rank[i] = self.pair_ranks(sym[i], sym[i + 1])
        return rank

    def count(self, texts: list) -> np.ndarray:
        out, part, held = [], [], 0
        for t in texts:
            part.append(self.bpe.pieces(t or ""))
            held += len(t or "")
            if held > self.SYMBOLS:  # bounds the arrays, not the texts
                out += self._count(part)
                part, held = [], 0
        return np.array(out + self._count(part), dtype=np.int64)

    def _count(self, texts: list[list[str]]) -> list[int]:
        known = self.known
        if len(known) > self.KNOWN:
            known.clear()
        fresh = [p for p in dict.fromkeys(p for t in texts for p in t if p not in known)]
        ordinary = [p for p in fresh if p not in self.bpe.specials]
        if ordinary:
            known.update(zip(ordinary, self.survivors([p.encode("utf-8") for p in ordinary]).tolist()))
        known.update((p, 1) for p in fresh if p in self.bpe.specials)
        get = known.__getitem__
        counts = [sum([get(p) for p in t]) for t in texts]
        for p in fresh:
            if len(p) > self.LONG:
                del known[p]
        return counts


@lru_cache(maxsize=4)
def counter(path: str) -> RankSyncCounter:
    return RankSyncCounter(load_byte_bpe(path))


def token_counts(docs: DataFrame, vocab_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row.  Null text counts
    as empty (0 bytes, 0 tokens); ids, nulls and repeats are carried as they are."""

    def count(texts: list) -> dict:
        n = counter(vocab_path).count(texts)
        return {"n_bytes": pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)}

    return map_texts(docs, count, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
