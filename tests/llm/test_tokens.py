"""BPE encoding and decoding, token counts and token files against the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from tidepool.llm import bpe_forced, token_counts, token_frames
from tidepool.llm.byte_bpe import PieceCache, load_byte_bpe
from tidepool.llm.common import parts_of
from tidepool.session import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "B", " ", "  ", "\n", "'s", "'", "é", "ß", "9", "²", "日", "٣", "😀", "\x85", "\x1c", "!", "<|endoftext|>",
         "the", "_", "-", "ि", "<|endof", "​", "　"]


def odd_texts(n=400):
    rng = random.Random(3)
    texts = ["", " ", "\n\n a", "a" * 20000, "ab" * 9000, "x<|endoftext|>y  <|endoftext|> ", "it's I'll 'S don't",
             "日本語 ½ Ⅷ", "\x00\x01", "ǅ ʰ ƻ", "İſK", "a\r\n\r\n  b\t\t c", "   x", " " * 3000 + "y"]
    for _ in range(n):
        texts.append("".join(rng.choice([*PARTS, chr(rng.randrange(0x20, 0x3000))]) for _ in range(rng.randint(1, 25))))
    return texts


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_encoder_equals_library_on_odd_texts():
    enc = bpe_forced.encoder(PATH)
    for t in odd_texts():
        want = ids_of(t)
        assert enc.encode(t).tolist() == want, t[:80]
        assert enc.bpe.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_forced_cuts_never_split_a_token():
    enc = bpe_forced.encoder(PATH)
    for token in enc.bpe.token_bytes[:enc.bpe.ordinary]:
        assert enc.cuts(token) == [token]
    assert enc.cuts("ßz日".encode()) != ["ßz日".encode()]   # and some pairs are cut


def test_counter_equals_library_with_small_tables():
    counter = token_counts.RankSyncCounter(load_byte_bpe(PATH))
    counter.KNOWN, counter.SYMBOLS = 50, 2000
    texts = [*odd_texts(), None]
    assert counter.count(texts).tolist() == [len(ids_of(t)) for t in texts]
    assert counter.count(texts[:9]).tolist() == [len(ids_of(t)) for t in texts[:9]]   # and again


def test_counter_keeps_no_long_pieces():
    counter = token_counts.RankSyncCounter(load_byte_bpe(PATH))
    texts = ["x" * 5000 + " ab", "y" * 101, "z" * 100, "a b"]
    assert counter.count(texts).tolist() == [len(ids_of(t)) for t in texts]
    assert max(map(len, counter.known)) == 100


def test_batches_of_unknown_pieces_equal_the_library(monkeypatch):
    texts = [*odd_texts(), "", "z" * 300]
    want = [ids_of(t) for t in texts]
    monkeypatch.setattr(token_frames, "MISSES_AT_ONCE", 7)
    for run_chars in (1, 500, 10**7):
        monkeypatch.setattr(token_frames, "RUN_CHARS", run_chars)
        token_frames._library_pieces.cache_clear()
        token_frames._library_pieces(PATH).limit = 40
        assert [ids.tolist() for ids in token_frames.encoded(texts, PATH)] == want
        kept = token_frames._library_pieces(PATH)
        assert max(map(len, kept.old), default=0) < 100 and (run_chars > 1 or len(kept.held) < 40 + 300)
    token_frames._library_pieces.cache_clear()


def test_known_pieces_of_many_batches_stay():
    library = token_frames.LibraryPieces(PATH)
    first = {f" {i}" for i in range(300_000)}
    library.held = dict.fromkeys(first, b"1234")
    library.held.update(dict.fromkeys((f"x{i}" for i in range(300_000)), b"1234"))
    library.of({" 1", " 2"})
    assert not library.old   # 600,000 pieces are one generation


def test_a_batch_is_worked_on_in_parts_by_bytes():
    import pyarrow as pa

    texts = ["a" * 30, None, "é" * 30, "", "b" * 500, "c", None, "d" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(parts_of(batch, 100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
    assert [p.num_rows for p in parts] == [4, 1, 3]
    assert list(parts_of(batch.slice(0, 0), 100)) == []


def test_piece_cache_is_bounded():
    cache = PieceCache(len, limit=10)
    assert [cache["x" * (i % 37)] for i in range(200)] == [i % 37 for i in range(200)]
    assert len(cache) <= 10 and len(cache.old) <= 10


def test_round_trip_query_on_whole_table(spark):
    from tidepool.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_bpe_round_trip"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = ids_of(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    counts = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, SF_SMALL).collect()}
    for r in rows:
        c = counts[r.doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(docs[r.doc_id].encode()), r.n_tokens, r.n_tokens > 512)


def test_encode_decode_tables_with_nulls_and_clashing_columns(spark):
    df = table(spark, ["hello wörld", None, "", "hello wörld"]).union(spark.createDataFrame([(None, "x")], "i long, t string"))
    df = df.withColumn("token_ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    enc = bpe_forced.encode_documents(df, PATH)
    assert enc.columns == ["doc_id", "token_ids"]
    got = sorted((r.doc_id is None, r.doc_id, r.token_ids) for r in enc.collect())
    assert [g[2] for g in got] == [ids_of("hello wörld"), [], [], ids_of("hello wörld"), ids_of("x")]
    back = {r.doc_id: r.text for r in bpe_forced.decode_documents(enc, PATH).collect()}
    assert back == {0: "hello wörld", 1: "", 2: "", 3: "hello wörld", None: "x"}
    digests = bpe_forced.round_trip_digests(df, PATH, keep_ids=True)
    assert digests.columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: r.n_tokens for r in digests.collect()} == {g[1]: len(g[2]) for g in got}
    counts = token_counts.token_counts(df, PATH, 2)
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in counts.collect()} == {g[1]: (len(g[2]), len(g[2]) > 2) for g in got}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for df in (bpe_forced.encode_documents(empty, PATH), bpe_forced.round_trip_digests(empty, PATH),
               token_counts.token_counts(empty, PATH, 5)):
        assert df.count() == 0
    manifest = token_frames.write_token_files(empty, shared_dir(spark, "t"), PATH, 2)
    assert manifest.count() == 0 and token_frames.read_token_files(manifest).count() == 0


def expected_files(texts):
    """texts in file order -> (start, n, crc) of each."""
    out, start = [], 0
    for t in texts:
        a = np.array(ids_of(t) + [2], "<u4")
        out.append((start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    return out


def test_token_files_of_whole_table(spark):
    from tidepool.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    rows = QUERIES["op9_token_files"](spark, SF_SMALL).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected_files([d.text for d in docs])
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]


def test_token_files_random_access_and_checksums(spark):
    texts = [*odd_texts(60), None]
    manifest = token_frames.write_token_files(table(spark, texts), shared_dir(spark, "t"), PATH, 2,
                                              frame_tokens=100, n_files=3)
    wanted = spark.createDataFrame([(3,), (4,), (17,), (999,), (len(texts) - 1,)], "doc_id long")
    got = {r.doc_id: r.token_ids for r in token_frames.read_documents(manifest, wanted).collect()}
    assert got == {i: ids_of(texts[i]) + [2] for i in (3, 4, 17, len(texts) - 1)}
    path = manifest.orderBy("part").first()["path"].replace("file:", "")
    raw = open(path, "rb").read()
    with open(path, "rb") as f:
        reader = token_frames.FrameReader(f, len(raw))
        plain = b"".join(reader.frame(k).tobytes() for k in range(len(reader.entries)))
        assert all(len(reader.frame(k)) == 100 for k in range(len(reader.entries) - 1))
    # a plain decompressor reads the same stream
    stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    assert stream.read(len(plain)) == plain
    # a damaged frame is found
    at = int(reader.offsets[1]) + 12
    import io
    broken = io.BytesIO(raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1:])
    bad = token_frames.FrameReader(broken, len(raw))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.frame(1)
    bad.frame(0)


def test_token_files_order_of_null_and_repeated_ids(spark):
    rows = [(5, "b"), (None, "n"), (5, "b"), (1, None), (5, "a much longer text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0)).withColumn("part", F.lit(0))
    manifest = token_frames.write_token_files(df, shared_dir(spark, "t"), PATH, 2, n_files=2)
    got = token_frames.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(t)) + 1 for _, t in rows)
