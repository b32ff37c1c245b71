"""BPE encoding and decoding by forced-boundary splitting.

A byte pair (a, b) that stands nowhere inside any vocabulary token can never be
inside a merged symbol, so a cut between a and b is certain.  Each pre-token is
cut at all such pairs, the fragments are merged independently and the ids are
concatenated.  The result equals the library's for the same vocabulary file.

The work is one narrow pass over the texts (no shuffle, nothing broadcast but
the file's path).  The distinct fragments of a run of texts are merged together,
as ragged arrays; a long one goes through a heap over a linked list instead, so it
costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.byte_bpe import ByteBpe, load_byte_bpe
from tidepool.llm.common import map_texts
from tidepool.llm.token_counts import RankSyncCounter

#: Pieces of a generation of the known ones, characters of a run of texts whose unknown
#: pieces are merged together, pieces merged at once, and bytes of a short fragment.
KNOWN, RUN_CHARS, MISSES_AT_ONCE, SHORT = 150_000, 2_000_000, 20_000, 64


class ForcedBoundaryEncoder:
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        #: joinable[a * 256 + b]: the pair stands inside some ordinary token.
        inside = np.zeros(65536, dtype=bool)
        for t in bpe.token_bytes[:bpe.ordinary]:
            raw = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            inside[raw[:-1] * 256 + raw[1:]] = True
        self.joinable = inside
        self._inside = inside.tolist()
        self.arrays = RankSyncCounter(bpe)
        self.held: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def cuts(self, raw: bytes) -> list[bytes]:
        """The fragments between certain cuts, in order."""
        inside, out, start = self._inside, [], 0
        for i in range(1, len(raw)):
            if not inside[raw[i - 1] << 8 | raw[i]]:
                out.append(raw[start:i])
                start = i
        out.append(raw[start:])
        return out

    def table(self, wanted: set[str]) -> dict[str, bytes]:
        """A table piece -> ids as bytes that has all wanted pieces; it holds until the next
        call.  Known pieces stay in two generations of about KNOWN, long ones do not."""
        for p in self.long:
            del self.held[p]
        if len(self.held) > KNOWN:
            self.old, self.held = self.held, {}
        held, old = self.held, self.old
        rest = wanted.difference(held)
        kept = {p: old[p] for p in rest if p in old}
        held.update(kept)
        missing = list(rest.difference(kept))
        self.long = [p for p in missing if len(p) >= 100]
        for i in range(0, len(missing), MISSES_AT_ONCE):
            part = missing[i:i + MISSES_AT_ONCE]
            cut = {p: self.cuts(p.encode("utf-8")) for p in part if p not in self.bpe.specials}
            ids = self._merge_all(list({f for fragments in cut.values() for f in fragments}))
            for p in part:
                fragments = cut.get(p)
                held[p] = b"".join([ids[f] for f in fragments]) if fragments else \
                    np.array([self.bpe.specials[p]], dtype="<u4").tobytes()
        return held

    def _merge_all(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """fragment -> ids as bytes."""
        out = {f: self._merge(f) for f in fragments if len(f) > SHORT}
        short = [f for f in fragments if len(f) <= SHORT]
        if not short:
            return out
        left: list[tuple[np.ndarray, np.ndarray]] = []
        counts = self.arrays.survivors(short, left)
        seq, sym = (np.concatenate(x) for x in zip(*left))
        raw = sym[np.argsort(seq, kind="stable")].astype("<u4").tobytes()
        ends = [0, *(np.cumsum(counts) * 4).tolist()]
        out.update(zip(short, map(raw.__getitem__, map(slice, ends, ends[1:]))))
        return out

    def _merge(self, raw: bytes) -> bytes:
        ids = [self.bpe.byte_id[b] for b in raw]
        if len(ids) > 1:
            ids = self._merge_long(ids)
        return np.array(ids, dtype="<u4").tobytes()

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, merged = self.bpe.pair_rank.get, self.bpe.merged
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank_of((ids[i], ids[j])) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank_of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := rank_of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), a run of about RUN_CHARS characters at a time."""
        run, size = [], 0
        for text in texts:
            run.append(self.bpe.pieces(text or ""))
            size += len(text or "")
            if size > RUN_CHARS:
                yield from self._settled(run)
                run, size = [], 0
        yield from self._settled(run)

    def _settled(self, run: list[list[str]]) -> Iterator[np.ndarray]:
        ids_of = self.table(set().union(*run)).__getitem__
        for pieces in run:
            yield np.frombuffer(b"".join(map(ids_of, pieces)), dtype="<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(load_byte_bpe(path))


def _ragged(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids array<int>), one row per row; null text counts as empty
    and gives an empty array.  Repeated and null ids are carried as they are."""

    def encode(texts: list) -> dict:
        enc = encoder(vocab_path)
        return {"token_ids": _ragged(list(enc.encode_all(texts)))}

    return map_texts(docs, encode, "token_ids array<int>", id_col, text_col)


def decode_documents(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id",
                     ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) from token ids; bytes that are no UTF-8 become U+FFFD, null
    ids an empty text.  An id outside the vocabulary is an error."""
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def decode(it):
        for b in it:
            bpe = load_byte_bpe(vocab_path)
            texts = [bpe.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(decode, f"doc_id {id_type}, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                       text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, then
    decoded from its ids, and both are digested in the same task, so that neither
    ids nor texts leave it (``keep_ids``: with a column token_ids array<int> after
    the id).  Null text counts as empty."""

    def digest(texts: list) -> dict:
        enc = encoder(vocab_path)
        decimal = _decimal_commas(vocab_path)
        n, of_ids, of_text, kept = [], [], [], []
        for array in enc.encode_all(texts):
            ids = array.tolist()
            kept += [array] if keep_ids else []
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b"".join([decimal[i] for i in ids])[:-1]).hexdigest())
            of_text.append(hashlib.sha256(enc.bpe.decode(ids).encode("utf-8")).hexdigest())
        return {**({"token_ids": _ragged(kept)} if keep_ids else {}),
                "n_tokens": pa.array(n, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_text}

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, digest, "token_ids array<int>, " * keep_ids + fields, id_col, text_col)


@lru_cache(maxsize=4)
def _decimal_commas(path: str) -> list[bytes]:
    return [b"%d," % i for i in range(len(load_byte_bpe(path).token_bytes))]
