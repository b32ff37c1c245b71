"""The pipeline, stage by stage, against brute-force versions on a small table."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.conftest import SF_SMALL
from tests.llm.test_mixing import best_miss, brute_targets
from tests.llm.test_simhash import brute_components, brute_print
from tidepool.llm import secret_lexer, toxicity_channel
from tidepool.session import shared_dir

EXTRA = {"row_id": "7", "row": "1", "size": "x", "turns": "0", "turn": "0", "masked": "m", "fp": "f", "copies": "9"}


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's output, from documents with clashing columns, nulls and repeats."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", None, None), (900002, "", "en", "src1", 0), (None, "no id here at all", None, "src1", 17),
                                 (900003, 'a token = "2abc3ff2ca8fb1e4c565" b', "en", "src2", 34), (900003, "another text, same id", "en", "src2", 21)],
                                docs.schema)
    docs = docs.unionByName(odd)
    for c, v in EXTRA.items():
        docs = docs.withColumn(c, F.lit(v))
    out = [docs]
    for name, stage in C.STAGES:
        at = shared_dir(spark, f"test-{name}")
        stage(spark, out[-1], SF_SMALL).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    model = toxicity_channel.train(stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = [r for r in stages[0].collect() if model.score(r.text) < C.TOXIC_AT]
    assert sorted(map(tuple, want), key=repr) == rows_of(stages[1])
    clean = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert len(clean - kept) <= 0.05 * len(clean)    # learnt from some seventy labels


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, repr(r)))
    groups = brute_components([brute_print(r.text) for r in rows])
    want = [rows[c] for c in sorted(set(groups))]     # the smallest id of each group
    assert sorted(map(tuple, want), key=repr) == rows_of(stages[2])


def test_secrets_are_masked_and_all_documents_stay(stages):
    want = []
    for r in stages[2].collect():
        text = secret_lexer._masked(r.text, "[SECRET]") if r.text is not None else None
        want.append(tuple(r[:1]) + (text, *r[2:4], r.n_chars if text == r.text else len(text), *r[5:]))
    assert sorted(want, key=repr) == rows_of(stages[3])
    assert any("[SECRET]" in (r.text or "") for r in stages[3].collect())


def test_sources_come_near_their_targets(stages):
    def words(r):
        return len((r.text or "").encode().split())

    before, after = stages[3].collect(), stages[4].collect()
    sizes, taken = {}, {}
    for r in before:
        sizes.setdefault(r.source, []).append(words(r))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + words(r)
    for s, t in brute_targets({s: sum(x) for s, x in sizes.items()}).items():
        assert abs(taken.get(s, 0) - t) <= best_miss(sizes[s], t) + 0.5
    times = {}
    for r in after:
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert set(times) <= {tuple(r) for r in before} and max(times.values()) == 2


def test_every_document_is_encoded(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in stages[4].collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert stages[5].columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(want, key=repr) == rows_of(stages[5])


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        at = shared_dir(spark, "test-empty")
        stage(spark, docs, SF_SMALL).write.parquet(at)
        docs = spark.read.parquet(at)
        assert docs.count() == 0


def test_run_writes_all_stages(spark):
    import __spark_entry__ as E

    out = E.queries()["pipeline"](spark, SF_SMALL)
    assert out.count() > 0 and out.where("n_tokens <> size(token_ids)").count() == 0
