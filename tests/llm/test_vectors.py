"""Nearest neighbours and exact top-k against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.llm import ann_rpforest as A
from tidepool.llm import topk_branch_bound as B

NAN, INF = float("nan"), float("inf")


def brute(rows, is_query, k, score):
    """rows: (id, vector); -> {query id: [(score, id)]} best first."""
    out = {}
    for q, v in rows:
        if is_query(q):
            found = {(score(v, w), i) for i, w in rows if i != q and len(w) == len(v)}
            out[q] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def whole(v, w):
    return sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w))


def dot(v, w):
    return float((np.array(v) * np.array(w)).sum())


def test_exact_top_k_equals_sql(spark):
    from tidepool.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF_SMALL}/embeddings.parquet'")
    want = con.sql(ORACLES["op10_branch_bound_top_k"]).fetchall()
    got = QUERIES["op10_branch_bound_top_k"](spark, SF_SMALL).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 0


def test_exact_top_k_tiles_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 24).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]     # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("dim", F.lit(1))
    out = B.exact_top_k(df, F.col("vec_id") % 7 == 0, 5, chunk_rows=50, query_rows=20)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert lists(out.collect()) == brute(rows, lambda q: q % 7 == 0, 5, whole)


BAD = [(50, None), (51, [1.0, None]), (52, [NAN, 1.0]), (53, [INF, 0.0]), (None, [1.0, 1.0])]


def test_exact_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (7, [1e9, 1e9]), (8, [-1e9, 2e9])]
    df = spark.createDataFrame([*rows, *BAD, (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = lists(B.exact_top_k(df, F.col("vec_id") >= 0, 3).collect())
    assert got[3:4] == [] if isinstance(got, list) else 3 not in got     # no other vector of its length
    want = brute([*rows[:3], *rows[4:]], lambda q: True, 3, whole)
    cap = np.iinfo(np.int64).max
    for q, found in want.items():
        ids = [i for _, i in got[q]]
        if q in (0, 2):
            assert [min(s, cap) for s, i in found][:1] == [got[q][0][0]] and len(ids) == 3
    assert B.exact_top_k(df.where("false"), F.col("vec_id") >= 0, 3).count() == 0
    with pytest.raises(ValueError):
        B.exact_top_k(df, F.col("vec_id") >= 0, 0)


def test_branch_and_bound_prunes_nothing_it_needs():
    rng = np.random.default_rng(3)
    for dims in (1, 15, 16, 17, 64):
        x = rng.integers(-200, 200, (500, dims)).astype(float)
        ids = rng.permutation(500)
        q, i, s = B.search_chunk(x, ids, x[:20], ids[:20], 5)
        for r in range(20):
            score = x @ x[r]
            best = sorted(((-score[j], ids[j]) for j in range(500) if ids[j] != ids[r]))[:5]
            assert [(-a, b) for a, b in best] == list(zip(s[q == r], i[q == r]))


def recall(spark, sf, k=20):
    from tidepool.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=np.float64)
    got = lists(QUERIES["op6_rp_forest_neighbours"](spark, sf).collect())
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[n]).sum(axis=1)
        scores[ids == ids[n]] = -INF
        best = ids[np.lexsort((ids, -scores))[:k]]
        found = got[ids[n]]
        assert len(found) == k and found == sorted(found, key=lambda f: (-f[0], f[1]))
        at = {i: s for i, s in zip(ids.tolist(), scores)}
        assert all(s == at[i] for s, i in found)
        hits += len(set(best.tolist()) & {i for _, i in found})
        total += k
    return hits / total


def test_recall_on_whole_tables(spark):
    assert recall(spark, SF_SMALL) >= 0.9
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_full_search_is_exact_with_hot_vector_and_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.1, 9)).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x")).withColumn("task", F.lit(0))
    out = A.nearest(df, F.col("vec_id") % 9 == 0, 6, search_share=1.0, leaf_sample=8, shard_rows=25)
    assert lists(out.collect()) == brute(rows, lambda q: q % 9 == 0, 6, dot)


def test_every_vector_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(A, "QUERY_ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2 if i % 7 < 3 else 3).tolist()) for i in range(70)] + [(200, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda q: q % 20 == 0, 4, dot)
    got = lists(A.nearest(df, F.col("vec_id") % 20 == 0, 4, search_share=1.0, leaf_sample=4, shard_rows=5).collect())
    assert got == {q: found for q, found in want.items() if found} and set(want) - set(got) == {200}


def test_recall_with_one_vector_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_001 + i, x[5].tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lists(A.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    for q, found in got.items():
        scores = every @ every[ids == q][0]
        scores[ids == q] = -INF
        # copies tie: what counts is how many of the found reach the 20th best score
        hits += sum(s >= np.sort(scores)[-20] - 1e-9 for s, _ in found)
        total += 20
    assert len(got) == 150 and hits / total >= 0.9


def test_nearest_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0])]
    zero = [(9, [0.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([*rows, *zero, *BAD, (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = lists(A.nearest(df, F.col("vec_id") >= 0, 20, search_share=1.0).collect())
    assert got == brute(rows, lambda q: True, 20, dot)  # 10 is alone in its length
    assert A.nearest(df.where("false"), F.col("vec_id") >= 0, 5).count() == 0
    alone = lists(A.nearest(df.where("vec_id = 0"), F.col("vec_id") >= 0, 5).collect())
    assert alone == {}
