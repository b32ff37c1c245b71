"""Near pairs by blocks against plain scores of every two texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidepool.operators import similarity as SIM
from tidepool.operators import text_blocks as T


def made(n, seed):
    """Texts over few common words, so most pairs share a word, with near copies and odd ones."""
    r = random.Random(seed)
    texts = [" ".join(r.choices(["the", "of", "and", *(f"w{i}" for i in range(200))], [40, 20, 10] + [1] * 200, k=r.randint(1, 90))) for _ in range(n)]
    texts += [t + f" more{i}" for i, t in enumerate(texts[::3])] + texts[:5] + ["", "?!", "é ß é", "é ß é ß", None]
    return list(enumerate(texts, 7))


def plain(rows, least):
    reps = {}
    for i, t in rows:
        if t is not None:
            reps.setdefault(t, []).append(i)
    vectors = {min(ids): (Counter("".join(c if c.isalnum() else " " for c in t).split()), len(ids)) for t, ids in reps.items()}
    norm = {i: math.sqrt(sum(k * k for k in v.values())) for i, (v, _) in vectors.items()}
    out = {}
    for a, (u, n) in vectors.items():
        for b, (v, m) in vectors.items():
            dot = sum(k * v[w] for w, k in u.items())
            if a < b and dot and dot / (norm[a] * norm[b]) >= least:
                out[a, b] = (dot / (norm[a] * norm[b]), n, m)
    return out


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_pairs_of_blocks_are_all_pairs(spark, least):
    rows = made(90, 8)
    df = spark.createDataFrame(rows, "id long, t string")
    want = plain(rows, least)
    for hot in (30, 8192):
        got = {(r["a_id"], r["b_id"]): (r["cosine"], r["a_copies"], r["b_copies"]) for r in SIM.near_dup_pairs(df, "id", "t", least, hot_df=hot).collect()}
        assert got.keys() == want.keys() and len(want) > 10
        assert all(v[1:] == want[k][1:] and abs(v[0] - want[k][0]) < 1e-12 for k, v in got.items())


def block(texts, tmp_path, name):
    import pyarrow as pa
    terms = [[{"token": w, "tf": k} for w, k in Counter(t.split()).items()] for t in texts]
    table = pa.table({"rep": pa.array(range(len(texts)), pa.int64()), "copies": pa.array([1] * len(texts), pa.int64()),
                      "terms": pa.array(terms, pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64())])))})
    row = T._as_row(table)
    with pa.OSFile(f"{tmp_path}/{name}", "wb") as out, pa.ipc.new_stream(out, row.schema) as file:
        file.write_batch(row)
    return T.load((f"{tmp_path}/{name}",))


@pytest.mark.parametrize("own,shared,tile", [(256, 1024, 1024), (4, 8, 5), (1, 1, 3)])
def test_the_bound_loses_no_pair(monkeypatch, tmp_path, own, shared, tile):
    monkeypatch.setattr(T, "OWN", own)
    monkeypatch.setattr(T, "SHARED", shared)
    monkeypatch.setattr(T, "TILE", tile)
    monkeypatch.setattr(T, "FIRST_LOOK", [0, *([own] if own + shared > own > 0 else [])])
    monkeypatch.setattr(T, "AT_ONCE", 40)
    texts = [t for _, t in made(60, 1) if t and t[0] not in "?é"]
    a, b = block(texts[:40], tmp_path, "a"), block(texts[40:], tmp_path, "b")
    for x, y in ((a, a), (a, b)):
        vectors = [[{x_.words[k].as_py(): int(n) for k, n in zip(x_.token[s:e], x_.tf[s:e])} for s, e in zip(x_.start, x_.start[1:])] for x_ in (x, y)]
        want = set()
        for i, u in enumerate(vectors[0]):
            for j, v in enumerate(vectors[1]):
                dot = sum(k * v.get(w, 0) for w, k in u.items())
                if (x is not y or i < j) and dot / math.sqrt(sum(k * k for k in u.values()) * sum(k * k for k in v.values())) >= 0.7:
                    want.add((i, j))
        got = [(int(i), int(j)) for part in T.near(x, y, 0.7) for i, j in zip(*part[:2])]
        assert set(got) == want and len(got) == len(want) > 10


def test_counts_beyond_doubles_are_still_whole(tmp_path):
    a = block(["x y z", "x y"], tmp_path, "a")
    b = block(["x y z q", "y z"], tmp_path, "b")
    for one, k in ((a, 3 * 10 ** 8 + 1), (b, 10 ** 8 + 7)):
        one.tf *= k
        one.norm2 *= k * k
    got = sorted((int(i), int(j), c) for part in T.near(a, b, 0.1) for i, j, c in zip(*part))
    sizes = {(0, 0): (3, 3, 4), (0, 1): (2, 3, 2), (1, 0): (2, 2, 4), (1, 1): (1, 2, 2)}
    order = [(a.rep[i].as_py(), b.rep[j].as_py()) for i, j, _ in got]
    assert sorted(order) == sorted(sizes)
    assert all(abs(c - sizes[k][0] / math.sqrt(sizes[k][1] * sizes[k][2])) < 1e-12 for k, (_, _, c) in zip(order, got))


def test_scoring_visits_shared_tokens_only(monkeypatch, tmp_path):
    # 40 texts near each other, each with 60 words of its own: no text's words are walked for each of its pairs
    monkeypatch.setattr(T, "OWN", 4)
    same = ["the"] * 30 + ["of"] * 20 + [f"c{i}" for i in range(4)]
    texts = [" ".join(same + [f"own{i}_{k}" for k in range(60)]) for i in range(40)]
    a, b = block(texts[:20], tmp_path, "a"), block(texts[20:], tmp_path, "b")
    visited, ranges = [], T._ranges
    monkeypatch.setattr(T, "_ranges", lambda starts, sizes: visited.append(int(np.sum(sizes))) or ranges(starts, sizes))
    assert sum(len(x) for x, _, _ in T.near(a, b, 0.9)) == 400
    shared = 20 * 20 * 4
    assert sum(visited) <= shared + 2 * len(a.token) + 2 * len(b.token) < 400 * 60


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_every_two_blocks_meet_once_in_few_runs(spark, n):
    runs = [tuple(r) for r in T.block_pairs(spark, n).collect()]
    pairs = [(k, j) for i, first, stop in runs for j in range(first, stop) for k in range(i, min(i + 2, j + 1))]
    assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i, n)]
    assert len(runs) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) + n


def test_small_files_are_put_together_once(spark):
    rows = made(60, 3)
    docs = spark.createDataFrame(rows, "id long, t string").repartition(9)
    assert docs.count() == len(rows)
    many = SIM._text_blocks(docs, "id", "t", 2)
    one = SIM._text_blocks(docs, "id", "t", 8192)
    assert many.count() >= 40 and one.count() == 1
    reps = [sorted(x for r in m.collect() for x in T.load((r.path,)).rep.to_pylist()) for m in (many, one)]
    assert reps[0] == reps[1] and [r.texts for r in one.collect()] == [len(reps[0])]
    assert set(T.heaviest_words(one)) == set(T.heaviest_words(many)) and T.heaviest_words(one)[0] == "the"


def test_words_are_counted_many_texts_at_once(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(T, "WORDS_AT_ONCE", 50)
    texts = [t.split() for _, t in made(40, 5) if t and t.split()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([1] * len(texts)), pa.array(texts)], names=["rep", "copies", "words"])
    parts = list(T._counted(batch.slice(3)))
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["rep"] for r in rows] == list(range(3, len(texts))) and len(parts) > 5
    assert [{t["token"]: t["tf"] for t in r["terms"]} for r in rows] == [dict(Counter(w)) for w in texts[3:]]
    # no array function of Spark walks the words of a text
    docs = spark.createDataFrame(made(20, 6), "id long, t string")
    plans, write = [], SIM.write_blocks
    monkeypatch.setattr(SIM, "write_blocks", lambda df, n: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, n))
    SIM.near_dup_classes(docs, "id", "t", 0.9)
    assert plans and all("lambda" not in p for p in plans)
