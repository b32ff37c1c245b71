"""Key indexes in buckets and phrase tables: results and plans."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.functions.text import first_words, tokens
from tidepool.operators import gates, phrase_scan, phrases
from tidepool.operators.key_index import KeyIndex
from tidepool.sources.tables import Tables


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in held.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_index_answers_with_nulls_repeats_and_later_keys(spark):
    history = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "h string")
    index = KeyIndex(spark).build(history, "h")
    asked = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "c"), (5, "b")], "id long, k string")
    assert sorted(r["id"] for r in index.unseen(asked, "k").collect()) == [2, 3, 4]
    assert sorted(r["id"] for r in index.seen(asked, "k").collect()) == [1, 5]
    index.append(spark.createDataFrame([("c",), ("a",), (None,)], "h string"), "h")
    assert index.table().count() == 3
    assert index.unseen(asked, "k").columns == ["id", "k"]
    assert sorted(r["id"] for r in index.unseen(asked, "k").collect()) == [3]
    assert KeyIndex(spark).build(history.limit(0), "h").unseen(asked, "k").count() == 5


def test_the_history_is_not_exchanged(spark, no_broadcast):
    t = Tables(spark, SF_SMALL)
    index = KeyIndex(spark).build(t.replied_tweets, "input_tweet_hash")
    asked = t.posts.select("post_id", F.sha2("full_text", 256).alias("k"))
    for df in (index.unseen(asked, "k"), index.seen(asked, "k")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"\bExchange ", plan)) == 1, plan           # the candidates only
        assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    plain = asked.join(t.replied_tweets.select("input_tweet_hash"), F.col("k") == F.col("input_tweet_hash"), "left_anti")
    assert sorted(r["post_id"] for r in index.unseen(asked, "k").collect()) == sorted(r["post_id"] for r in plain.collect())


TEXTS = [(1, "One two THREE, four"), (2, "two three"), (3, None), (4, ""), (5, "three two three two three"), (None, "two three"),
         (6, "one two three four five six seven"), (6, "one two three four five six eight"), (7, "été déjà vu"), (8, "x two-three")]
PHRASES = ["two three", "Two  three", "two three", None, "", "!?", "three two three", "one two three four five six seven", "déjà vu",
           "not there", "été", "four"]


def brute(texts, table, fold):
    words = lambda t: re.findall(r"\w+", (t or "").lower() if fold else t or "")
    out = []
    for i, text in texts:
        w = words(text)
        for p in {p for p in table if words(p)}:
            k = words(p)
            out += [(i, p, at) for at in range(len(w) - len(k) + 1) if w[at:at + len(k)] == k]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fold", [True, False])
def test_phrase_hits_against_plain_search(spark, fold):
    texts = spark.createDataFrame(TEXTS, "id long, t string").withColumn("key", F.lit("x")).withColumn("phrase", F.lit(1))
    table = spark.createDataFrame([(p,) for p in PHRASES], "p string")
    got = sorted(map(tuple, phrases.phrase_hits(texts, "id", "t", table, "p", fold).collect()), key=repr)
    assert got == brute(TEXTS, PHRASES, fold) and got
    assert phrases.phrase_hits(texts, "id", "t", table.limit(0), "p").count() == 0
    assert phrases.phrase_hits(texts.limit(0), "id", "t", table, "p").count() == 0


def test_thousands_of_phrases_in_one_join(spark, no_broadcast):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    table = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 7))) for _ in range(5000)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(60)]
    df, ps = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(p,) for p in table], "p string")
    hits = phrases.phrase_hits(df, "id", "t", ps, "p")
    assert sorted(map(tuple, hits.collect()), key=repr) == brute(texts, table, True)
    assert len(re.findall("Join", hits._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_frequent_phrases_are_found_in_the_scan_and_few_other_places_shuffled(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 40)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    table = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 7))) for _ in range(400)]
    texts = [(i % 50 or None, " ".join(rng.choices(vocabulary, k=40))) for i in range(60)] + [(7, None)]
    df, ps = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(p,) for p in table], "p string")
    hits = phrases.phrase_hits(df, "id", "t", ps, "p")
    want = brute([t for t in texts if t[1]], table, True)
    assert sorted(map(tuple, hits.collect()), key=repr) == want
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2   # frequent phrases, and the bits of the others
    index = phrases.phrase_index(ps, "p")
    grams = phrases._grams(df, "id", "t", {1: 1, 2: 2, 3: 3, 4: 7}, True)
    assert phrases._with_bit(grams, index, index.count()).count() < grams.count() / 2


def test_equal_to_the_inline_form_where_both_apply(spark):
    posts = Tables(spark, SF_SMALL).posts.select("post_id", F.regexp_replace(F.lower("full_text"), r"[^\p{L}\p{N}_]+", " ").alias("full_text"))
    some = [r[0] for r in posts.select(F.array_join(F.slice(F.split("full_text", " "), 3, 2), " ")).limit(15).collect()]
    padded = posts.withColumn("full_text", F.concat(F.lit(" "), "full_text", F.lit(" ")))
    inline = gates.post_blocklist(padded, phrases=[f" {p} " for p in some])
    rest = gates.post_blocklist(padded, phrases=())   # its other rules
    table = phrases.phrase_gate(rest, "post_id", "full_text", spark.createDataFrame([(p,) for p in some], "p string"), "p")
    both = [sorted(r["post_id"] for r in df.select("post_id").collect()) for df in (inline, table)]
    assert both[0] == both[1] and len(both[0]) < rest.count()


def test_the_first_words_are_those_of_the_whole_text(spark):
    texts = ["one two three four", "  ?! one\n\ttwo--three", "one", "", "?!", None, "été déjà_vu Ⅷ x\U0001d400 y", "a" * 5000 + " b c d", "- " * 5000 + "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 20):
        got = df.select(tokens(first_words("t", n)).alias("a"), F.slice(tokens("t"), 1, n).alias("b"), F.length(first_words("t", n)).alias("n")).collect()
        assert all(r["a"] == r["b"] for r in got) and any(r["b"] for r in got)


def test_phrases_are_found_without_a_row_for_each_n_gram(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 2)
    monkeypatch.setattr(phrase_scan, "WORDS_AT_ONCE", 7)
    texts = [(i, "a b, c d a b c " + "x " * i + "d e f g h i") for i in range(9)] + [(20, None), (21, "")]
    table = ["a b", "a-b", "a", "c d a", "b c", "d e f g h i", "d e f g h j", "x x x x x", "x d", "no"]
    df, ps = spark.createDataFrame(texts, "id string, t string"), spark.createDataFrame([(p,) for p in table], "p string")
    hits = phrases.phrase_hits(df, "id", "t", ps, "p")
    assert sorted(map(tuple, hits.collect()), key=repr) == brute([(str(i), t) for i, t in texts], table, True)
    assert "Generate " not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_trie_and_a_table_of_bits():
    rng = random.Random(3)
    some = [[rng.choice("abcdé") * rng.randint(1, 3) for _ in range(rng.randint(1, 6))] for _ in range(300)]
    text = [rng.choice("abcdé") * rng.randint(1, 3) for _ in range(3000)]
    trie = phrase_scan.Trie(pa.array(some), np.arange(len(some)))
    left = len(text) - np.arange(len(text))
    got = sorted((int(a), int(p)) for at, ids in trie.places(pa.array(text), left) for a, p in zip(at, ids))
    assert got == sorted((a, p) for p, w in enumerate(some) for a in range(len(text)) if text[a:a + len(w)] == w)
    keys = [w[:4] for w in some]
    n_bits = phrase_scan.n_bits_for(len(keys))
    parts = pa.Table.from_batches(phrase_scan.bits_of(n_bits)([pa.RecordBatch.from_arrays([pa.array(keys)], names=["words"])]))
    table = phrase_scan.table_of(parts, n_bits)
    batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([text])], names=["__id", "__words"])
    rows = [r for b in phrase_scan.maybe_of(table, {1: 1, 2: 2, 3: 3, 4: 6})([batch]) for r in b.to_pylist()]
    there = {(r["position"], r["__n"]): r["__ahead"] for r in rows}
    true = {(a, len(k)) for k in map(tuple, keys) for a in range(len(text)) if tuple(text[a:a + len(k)]) == k}
    assert true <= there.keys() and len(there) < 1.1 * len(true) + 100
    assert all(v.split(" ") == text[a:a + {1: 1, 2: 2, 3: 3, 4: 6}[n]] for (a, n), v in there.items())
