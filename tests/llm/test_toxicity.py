"""Toxicity: decoding cases, held-out accuracy, folds, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tidepool.llm import toxicity_channel as T

TOXIC = ["scum", "idiot", "moron", "trash", "loser", "clown", "stupid", "pathetic", "worthless", "disgusting"]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet"), spark.read.parquet(f"{SF_CHECK}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return T.train(*tables)


@pytest.mark.parametrize("written,meant", [
    ("1d10t", "idiot"), ("m0r0n!!", "moron"), ("$cum", "scum"), ("tr@sh", "trash"), ("looooser", "loser"),
    ("MOOOORON", "moron"), ("5tup1d", "stupid"), ("st-up-id", "stupid"), ("p4th3t1c", "pathetic"), ("plain", "plain"),
    ("4550829304294745", "4550829304294745"), ("the&&&", "the"), ("108.51.216.133", "108.51.216.133"), ("été", "été"),
    ("idio+", "idiot"), ("idio+.", "idiot"), ("(lown", "clown"), ("|diot", "idiot"), ("tras#", "trash"), ("a$$", "as"),
    ("moroon", "moron"), ("iddiot", "idiot"), ("MOROON!", "moron"), ("(loser)", "loser"), ("*loser*", "loser"),
    ("#loser", "loser"), ("loser!", "loser"), ("loser.!!", "loser"), ("the$$$", "the"), ("(the", "the"), ("|", ""),
])
def test_restored_words(model, written, meant):
    assert model.restored(written) == meant


def test_ordinary_doubled_letters_and_numbers_count_as_written_too(model):
    for word in ("good", "ass", "1990s"):
        assert word in model.reader.forms(word)
    assert model.reader.forms("moroon!") == ("moron", "moroon") and model.reader.forms("(the)") == ("the",)


@pytest.mark.parametrize("spaced", ["i d i o t", "i - d - i - o - t", "i  d  i  o  t", "i\nd\ni\no\nt", "I. d. 1. 0. t"])
def test_spaced_letters_are_joined(model, spaced):
    assert "idiot" in model.restored(f"you {spaced} you").split()


def test_repeats_are_decoded_as_in_the_whole_word(spark, tables, model):
    words = {w.lower() for r in tables[0].limit(300).collect() for w in (r.text or "").split()}
    words = [w for w in words if w.isalpha() and T._REPEAT.search(w)]
    words += ["aab", "baa", "aa", "aabb", "aaab", "mmoroonn", "xaaay", "iddiot", "moooooooron", "ssttuuppiidd", "ééa"]
    assert len(words) > 100
    for w in words:
        assert model.channel.restore_letters(w) == model.channel.restore(w)


def test_viterbi_finds_the_cheapest_reading(model):
    # against all readings of a short word, scored one by one
    channel = model.channel

    def price(parts):
        text = "".join(t for t, _ in parts)
        total, x, y = sum(c for _, c in parts), 0, 0
        for ch in [*text, None]:
            z = T.code_of(ch) if ch else 0
            if ch is None or not (z == 0 and y == 0):
                total += float(channel.cost[x, y, z])
            x, y = y, z
        return total, " ".join(text.split())

    def readings(word):
        options = [[]]
        for i, j in T._runs(word):
            options = [o + [r] for o in options for r in T._readings(word[i], j - i)]
        return options

    for word in ("m0r0n", "1d.1ot", "loooser", "$tu.p1d", "a1b2"):
        assert channel.restore(word) == min(price(o) for o in readings(word))[1]


def test_held_out_accuracy_and_fold(spark, tables, model):
    docs, labels = tables
    rows = T.score_documents(docs, model).collect()
    assert len(rows) == docs.count()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    right = sum((s >= 0.5) == bool(t) for s, t in held)
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert right / len(held) >= 0.93 and auc >= 0.9


def test_held_out_labels_are_never_learnt(spark, tables, model):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(T.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.train(docs, turned)
    assert again.weights == model.weights and again.bias == model.bias


def test_planted_disguised_documents(model):
    clean = "Thent ereding of that inon heer and the thing with esea ndre on for whou "
    for words in (["idio+", "(lown", "|diot", "tras#"], ["moroon", "iddiot", "clownn", "trrash"]):
        assert model.score(clean + " ".join(words) + " " + clean) > model.score(clean + " ".join(["thon"] * 4) + " " + clean)
    disguised = ["1d10t", "m0r0n", "tr@sh", "l0ser", "cl0wn", "stup1d"]
    assert model.score(clean * 3) < 0.5
    assert model.score(clean + " ".join(TOXIC) + " " + clean) >= 0.5
    assert model.score(clean + " ".join(disguised) + " " + clean) >= 0.5


def test_edges(spark, tables, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None), (3, "a1" * 20000), (4, "w " * 50000)],
                                 "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    out = T.score_documents(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 6
    empty = 1 / (1 + np.exp(-model.bias))
    assert all(abs(r.score - empty) < 1e-12 for r in out.where("doc_id <= 2").collect())
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    assert T.score_documents(none, T.train(none, labels)).count() == 0
    one_class = T.train(tables[0], labels)
    assert one_class.weights == {} and 0 < one_class.score("anything") < 1


def test_a_task_leaves_no_known_words_behind():
    model = T.Model(T.Channel(np.ones(T.LETTERS ** 3, dtype=np.int64)), 0.0, {"idiot": 1.0})
    texts = ["an idi0t, goood", "a b c d", "plain words"]
    scores = [model.score(t) for t in texts]
    assert model.votes
    model.forget()
    assert not any((model.votes, model.votes.old, model.reader.plain, model.reader.read, model.channel._repeats))
    assert [model.score(t) for t in texts] == scores
