"""Token ids as binary files of independent zstandard frames.

File layout (all numbers little-endian):

1. zstandard frames, each the ids (uint32) of a run of ``frame_tokens`` ids (the
   last one shorter), compressed on its own;
2. a skippable frame with the document index: one record of ``DOC`` per document
   in order (id, has an id, first token within the file, number of tokens);
3. a skippable frame with the seek table of the public seekable format: per data
   frame its compressed size, its raw size and the low 32 bits of the XXH64 of
   the raw bytes, then the number of frames, a flag byte and a magic number.

A plain zstandard reader sees one valid stream.  A reader of single documents
takes the tail, then reads and checks only the frames that its documents touch.

Writing: documents are range-partitioned by id, each partition encodes its texts
and writes one file in the shared folder under a temporary name that is moved to
the final name at the end, so a lost or repeated task leaves whole files only.
The driver sees one row per file (path and counts).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.byte_bpe import load_byte_bpe
from tidepool.llm.common import cut_lineage, id_and_text, shuffle_partitions
from tidepool.session import open_store

# Fixed values of the public seekable zstandard format.
SEEK_MAGIC, SKIPPABLE_SEEK, SKIPPABLE_DOCS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
SEEK_ENTRY, SEEK_FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
SKIPPABLE_HEADER = struct.Struct("<II")
#: Characters of a run of texts whose unknown pieces are encoded together, pieces of one
#: call, and words of one text of it.
RUN_CHARS, MISSES_AT_ONCE, JOINED = 4_000_000, 16_384, 50
DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("n_tokens", "<u8")])


class FrameWriter:
    """Writes one file; memory is one frame plus the document index."""

    def __init__(self, out, frame_tokens: int, level: int = 3):
        self.out, self.frame_tokens = out, frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.docs: list[tuple] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        while self.n_held >= self.frame_tokens:
            ids = np.concatenate(self.held)
            self._frame(ids[:self.frame_tokens])
            rest = ids[self.frame_tokens:]
            self.held, self.n_held = [rest], len(rest)

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held))
        index = np.array(self.docs, dtype=DOC).tobytes()
        self.out.write(SKIPPABLE_HEADER.pack(SKIPPABLE_DOCS, len(index)) + index)
        table = b"".join(SEEK_ENTRY.pack(*e) for e in self.entries)
        table += SEEK_FOOTER.pack(len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(SKIPPABLE_HEADER.pack(SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to the documents of one file (a seekable binary stream)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - SEEK_FOOTER.size)
        n, flags, magic = SEEK_FOOTER.unpack(stream.read(SEEK_FOOTER.size))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - SEEK_FOOTER.size - n * SEEK_ENTRY.size
        stream.seek(table_at)
        self.entries = list(SEEK_ENTRY.iter_unpack(stream.read(n * SEEK_ENTRY.size)))
        self.offsets = np.cumsum([0, *(e[0] for e in self.entries)])
        self.token_ends = np.cumsum([e[1] // 4 for e in self.entries])
        docs_at = int(self.offsets[-1])
        stream.seek(docs_at)
        kind, length = SKIPPABLE_HEADER.unpack(stream.read(SKIPPABLE_HEADER.size))
        if kind != SKIPPABLE_DOCS or docs_at + length + 2 * SKIPPABLE_HEADER.size != table_at:
            raise ValueError("the document index is damaged")
        self.docs = np.frombuffer(stream.read(length), dtype=DOC)
        self.zstd = zstandard.ZstdDecompressor()
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            packed, raw_size, check = self.entries[k]
            self.stream.seek(int(self.offsets[k]))
            raw = self.zstd.decompress(self.stream.read(packed), max_output_size=raw_size)
            if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: checksum mismatch")
            self._last = (k, np.frombuffer(raw, dtype="<u4"))
        return self._last[1]

    def tokens(self, doc: int) -> np.ndarray:
        """Ids of the doc-th document of the file; only its frames are read."""
        start, n = int(self.docs[doc]["start"]), int(self.docs[doc]["n_tokens"])
        if not n:
            return np.empty(0, "<u4")
        k, parts, at = int(np.searchsorted(self.token_ends, start, side="right")), [], start
        while at < start + n:
            begin = int(self.token_ends[k]) - self.entries[k][1] // 4
            stop = min(start + n, int(self.token_ends[k]))
            parts.append(self.frame(k)[at - begin:stop - begin])
            at, k = stop, k + 1
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


class LibraryPieces:
    """piece -> ids as bytes, by the library.  The unknown pieces of a run of texts are
    encoded in a few calls; known ones are kept in two generations of about ``limit``
    pieces, so frequent pieces stay.  Long pieces hardly repeat and go with their run."""

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.lib, self.limit = Tokenizer.from_file(path), limit
        self.token_size = np.array([len(t) for t in load_byte_bpe(path).token_bytes])
        self.held: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def of(self, wanted: set[str]) -> dict[str, bytes]:
        """A table that has all wanted pieces; it holds until the next call."""
        for p in self.long:
            del self.held[p]
        if len(self.held) > self.limit:
            self.old, self.held = self.held, {}
        held, old = self.held, self.old
        rest = wanted.difference(held)
        kept = {p: old[p] for p in rest if p in old}
        held.update(kept)
        missing = list(rest.difference(kept))
        self.long = [p for p in missing if len(p) >= 100]
        for i in range(0, len(missing), MISSES_AT_ONCE):
            self._encode(missing[i:i + MISSES_AT_ONCE])
        return held

    def _encode(self, missing: list[str]) -> None:
        """Words behind a space are encoded JOINED at a time, since the library parts them
        there in any case; the bytes of their tokens tell where each one ends."""
        words, other = [], []
        for p in missing:
            (words if p[0] == " " and p[1:].isalpha() else other).append(p)
        for p, e in zip(other, self.lib.encode_batch_fast(other, add_special_tokens=False)):
            ids = e.ids
            self.held[p] = struct.pack(f"<{len(ids)}I", *ids)
        if not words:
            return
        texts = ["".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        flat = np.array([i for e in self.lib.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.cumsum(self.token_size[flat])
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)))
        at = np.searchsorted(ends, stops)
        if (ends[np.minimum(at, len(ends) - 1)] != stops).any():
            raise ValueError("a token of the library spans two words")
        raw, cuts = flat.tobytes(), [0, *((at + 1) * 4).tolist()]
        self.held.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))


@lru_cache(maxsize=2)
def _library_pieces(path: str) -> LibraryPieces:
    # Spark runs a worker per core: the library's own threads would only compete.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryPieces(path)


def encoded(texts: Iterable[str], vocab_path: str) -> Iterator[np.ndarray]:
    """The ids of each text, a run of about RUN_CHARS characters at a time."""
    bpe, library = load_byte_bpe(vocab_path), _library_pieces(vocab_path)
    run, size = [], 0

    def settled() -> Iterator[np.ndarray]:
        ids_of = library.of(set().union(*run)).__getitem__
        for pieces in run:
            yield np.frombuffer(b"".join(map(ids_of, pieces)), dtype="<u4")

    for text in texts:
        run.append(bpe.pieces(text))
        size += len(text)
        if size > RUN_CHARS:
            yield from settled()
            run, size = [], 0
    yield from settled()


def write_token_files(docs: DataFrame, folder: str, vocab_path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text",
                      frame_tokens: int = 32768, n_files: int | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending id order (null ids first, equal
    ids by text hash, then text) and returns the manifest, one row per file:
    (part, path, n_docs, n_tokens), already written down in the shared folder.

    Null text counts as empty: the document is its end id alone.  An empty table
    gives an empty manifest.  Ids must be whole numbers.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    n = n_files or shuffle_partitions(spark)
    parts = rows.repartitionByRange(n, order[0], order[1]).sortWithinPartitions(*order)

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in it if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        part = task.partitionId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}.tokens.zst"
        draft = f"{name}.{task.taskAttemptId()}.draft"
        end = np.array([end_id], "<u4")
        with store.open_output_stream(draft) as out:
            writer = FrameWriter(out, frame_tokens)
            b: pa.RecordBatch | None = first
            while b is not None:
                texts = (text or "" for text in b.column(1).to_pylist())
                for doc_id, ids in zip(b.column(0).to_pylist(), encoded(texts, vocab_path)):
                    writer.add(doc_id, np.concatenate([ids, end]))
                b = next(batches, None)
            writer.close()
        store.move(draft, name)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "path": [f"{folder}/part-{part:06d}.tokens.zst"],
            "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    return cut_lineage(parts.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the
    files; ``start`` counts the ids of all documents before it over all files.

    The first ids of the files come from the manifest's counts, one row per file
    (metadata that the driver adds up); each task reads one file, frame by frame.
    """
    spark = manifest.sparkSession
    start, bases = 0, []
    for r in manifest.orderBy("part").select("part", "n_tokens").collect():
        bases.append((r.part, start))
        start += r.n_tokens
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row per file on both sides; the map of first ids has a few bytes a file.
    files = manifest.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part")

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist()):
                store, name = open_store(path)
                with store.open_input_file(name) as stream:
                    reader = FrameReader(stream, stream.size())
                    docs = reader.docs
                    for i in range(0, len(docs), 4096):
                        part = docs[i:i + 4096]
                        crc = [zlib.crc32(reader.tokens(k).tobytes()) for k in range(i, i + len(part))]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(part["doc_id"].astype(np.int64), mask=part["has_id"] == 0),
                            "start": pa.array(part["start"].astype(np.int64) + base),
                            "n_tokens": pa.array(part["n_tokens"].astype(np.int64)),
                            "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, token_ids) of the wanted ids only: every file's index is read, and
    of its frames only those that hold a wanted document.

    The wanted ids are spread over the files by an id-range join with what each
    file holds, so nothing is broadcast but the manifest.
    """
    spans = manifest.select("path").mapInArrow(_spans, "path string, doc_id long, at long")
    hits = spans.join(wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id")

    def fetch(key, rows):
        store, name = open_store(key[0].as_py())
        with store.open_input_file(name) as stream:
            reader = FrameReader(stream, stream.size())
            rows = rows.sort_by("at")
            ids = [reader.tokens(k).astype(np.int64) for k in rows["at"].to_pylist()]
        return pa.table({"doc_id": rows["doc_id"], "token_ids": pa.array(ids, pa.list_(pa.int64()))})

    return hits.groupBy("path").applyInArrow(fetch, "doc_id long, token_ids array<long>")


def _spans(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for path in b["path"].to_pylist():
            store, name = open_store(path)
            with store.open_input_file(name) as stream:
                docs = FrameReader(stream, stream.size()).docs
            at = np.flatnonzero(docs["has_id"])
            yield pa.RecordBatch.from_pydict({"path": [path] * len(at), "doc_id": docs["doc_id"][at].astype(np.int64),
                                              "at": at.astype(np.int64)})
