"""Phrases in the words of many texts at once, within a task.

A word is a number here, and a batch of texts one array of numbers.  Phrases that fit in a
task stand in a trie: all places of a batch go down it together, a word at a time, and few
are left after the second word.  Of phrases that do not fit, a table of bits tells which
n-grams may be one; what it lets through is verified by the join that follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of texts that are looked at together, unless one text has more.
WORDS_AT_ONCE = 1_000_000
#: The table of bits has 2 ** MOST_BITS bits at most, and two of BITS_A_KEY for each key.
MOST_BITS, BITS_A_KEY = 28, 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Trie:
    """Phrases by their words; several may have the same."""

    def __init__(self, phrases: pa.Array, ids: np.ndarray):
        """``phrases``: a list of words each, one at least; ``ids``: their numbers."""
        size = pc.list_value_length(phrases).to_numpy().astype(np.int64)
        coded = phrases.flatten().dictionary_encode()
        word, start = coded.indices.to_numpy().astype(np.int64), np.cumsum(size) - size
        self.words, self.n_words = coded.dictionary, max(1, len(coded.dictionary))
        self.first = np.full(self.n_words + 1, -1, np.int64)   # node of a first word; the last is of no word
        node = np.zeros(len(size), np.int64)
        n_nodes, edges, depth, rows = 0, [], 0, np.arange(len(size))
        while len(rows):
            keys, of = np.unique(node[rows] * self.n_words + word[start[rows] + depth], return_inverse=True)
            node[rows] = n_nodes + of
            if depth:
                edges.append((keys, n_nodes + np.arange(len(keys))))
            else:
                self.first[keys] = np.arange(len(keys))
            n_nodes, depth = n_nodes + len(keys), depth + 1
            rows = rows[size[rows] > depth]
        keys, child = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]
        self.shift = np.uint64(64 - max(1, (16 * len(keys)).bit_length()))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)   # of a key's hash: most that lead nowhere end here
        self.there[self._slot(self.keys)] = True
        order = np.argsort(node, kind="stable")
        self.ids, self.n_ids = np.asarray(ids)[order], np.bincount(node, minlength=n_nodes)
        self.start = np.cumsum(self.n_ids) - self.n_ids

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD[0]) >> self.shift

    def places(self, words: pa.Array, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, phrase numbers) in parts; ``left``: words of its text from a place on."""
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, self.words).fill_null(-1).to_numpy()
        word = known[coded.indices.to_numpy()].astype(np.int64)
        node = self.first[word]
        at, depth = np.flatnonzero(node >= 0), 1
        node = node[at]
        while len(at):
            n = self.n_ids[node]
            if n.any():
                yield np.repeat(at, n), self.ids[_ranges(self.start[node], n)]
            more = left[at] > depth
            at, node = at[more], node[more]
            next_word = word[at + depth]
            key = node * self.n_words + next_word
            may = np.flatnonzero((next_word >= 0) & self.there[self._slot(key)])
            at, key = at[may], key[may]
            edge = np.searchsorted(self.keys, key)
            same = self.keys[np.minimum(edge, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
            at, node, depth = at[same], self.child[edge[same]], depth + 1


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, text, position, left) of some of a batch's texts (id, words) at a time;
    the last three of each word."""
    size = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for some in _runs(size):
        part, n = batch.slice(some.start, some.stop - some.start), size[some]
        position = _ranges(np.zeros(len(n), np.int64), n)
        yield part.column(0), part.column(1).flatten(), np.repeat(np.arange(len(n)), n), position, np.repeat(n, n) - position


def hits_of(trie: Trie) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(__id, position, phrase_id) of texts (id, words)."""
    def find(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, words, text, position, left in _parts(batch):
                for at, phrase in trie.places(words, left):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text[at])), pa.array(position[at], pa.int32()), pa.array(phrase, pa.int64())],
                        names=["__id", "position", "phrase_id"])
    return find


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, of its bytes by place."""
    words = pa.concat_arrays([words.cast(pa.large_string())])   # from its buffer's start
    ends = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    chars = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + _ODD[1]
    size = np.diff(ends)
    powers = np.cumprod(np.full(int(size.max()), _ODD[0]), dtype=np.uint64)
    out = np.add.reduceat(chars * powers[_ranges(np.zeros(len(size), np.int64), size)], ends[:-1] - ends[0])
    return (out ^ (out >> np.uint64(29))) * _ODD[2]


def _keys(hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, keys of the n-grams from each word on): of the hashes of words."""
    key = hashes
    for n in range(1, longest + 1):
        if n > 1:
            key = key[:-1] * _ODD[0] + hashes[n - 1:]
            key = (key ^ (key >> np.uint64(31))) * _ODD[1]
        yield n, key


def _slots(keys: np.ndarray, n_bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - n_bits)
    return [(keys * _ODD[2]) >> shift, ((keys ^ (keys >> np.uint64(33))) * _ODD[1]) >> shift]


def n_bits_for(n_keys: int) -> int:
    return max(6, min(MOST_BITS, (max(1, n_keys) * BITS_A_KEY - 1).bit_length()))


def bits_of(n_bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, bits) of the table, for keys (lists of words); not summed up yet."""
    def find(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size = pc.list_value_length(batch.column(0)).to_numpy().astype(np.int64)
            hashes, start = _hashes(batch.column(0).flatten()), np.cumsum(size) - size
            slots = [np.zeros(0, np.uint64)]
            for n, key in _keys(hashes, int(size.max(initial=0))):
                slots += _slots(key[start[size == n]], n_bits)
            slot = np.unique(np.concatenate(slots))
            if len(slot):
                word, first = np.unique(slot >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])
    return find


def table_of(found: pa.Table, n_bits: int) -> np.ndarray:
    """The table of bits from (word, bits), a row per word."""
    table = np.zeros(1 << (n_bits - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def maybe_of(table: np.ndarray, longest: dict[int, int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(__id, position, __n, __ahead) of texts (id, words): where an n-gram, n of
    ``longest``, has its bits in the table; with the longest[n] words from there on at most,
    joined by spaces."""
    n_bits = len(table).bit_length() + 5

    def find(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, words, text, position, left in _parts(batch):
                coded = words.dictionary_encode()
                word = coded.indices.to_numpy()
                for n, key in _keys(_hashes(coded.dictionary)[word], min(len(word), max(longest, default=0))):
                    if n not in longest:
                        continue
                    at = np.flatnonzero(left[:len(key)] >= n)
                    for k in range(2):
                        slot = _slots(key[at], n_bits)[k]
                        at = at[(table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
                    if not len(at):
                        continue
                    for some in _runs(np.minimum(left[at], longest[n])):
                        yield _ahead(ids, coded.dictionary, word, text, position, at[some], np.minimum(left[at[some]], longest[n]), n)
    return find


def _runs(size: np.ndarray) -> Iterator[slice]:
    """Runs of WORDS_AT_ONCE words at most, or of one row."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + WORDS_AT_ONCE, side="right")))
        yield slice(lo, hi)
        lo = hi


def _ahead(ids: pa.Array, words: pa.Array, word: np.ndarray, text: np.ndarray, position: np.ndarray, at: np.ndarray,
           size: np.ndarray, n: int) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), words.take(pa.array(word[_ranges(at, size)])))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(text[at])), pa.array(position[at], pa.int32()), pa.array(np.full(len(at), n), pa.int32()),
         pc.binary_join(lists, " ")], names=["__id", "position", "__n", "__ahead"])
