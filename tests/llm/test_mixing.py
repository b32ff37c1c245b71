"""Mixing: targets, the knapsack, and which documents are taken."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.llm import mixing as M


def brute_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """sizes: source -> words; reshare until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        t = {s: cap * sizes[s] if s in capped else w[s] / open_w * rest for s in names}
        over = {s for s in names if t[s] > cap * sizes[s]}
        if not over:
            return t
        capped |= over


def check(rows, docs):
    """rows: result; docs: list of (id, source, text)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in docs}
    sources = {}
    for d, s, _ in docs:
        sources[s] = sources.get(s, 0) + size[d]
    want = brute_targets(sources)
    source_of = {d: s for d, s, _ in docs}
    taken = dict.fromkeys(sources, 0)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        s = source_of[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sources[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    return {s: taken[s] - want[s] for s in sources}


def best_miss(sizes, target):
    """How near the words of whole passes and one more partial pass can come."""
    passes = int(target // sum(sizes)) if sum(sizes) else 0
    sums = {0}
    for x in sizes:
        sums |= {y + x for y in sums}
    return min(abs(passes * sum(sizes) + y - target) for y in sums)


def test_whole_table_and_reruns(spark):
    from tidepool.llm.queries import QUERIES

    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = QUERIES["op5_mix_to_targets"](spark, SF_SMALL).collect()
    misses = check(rows, docs)
    for s in misses:    # few documents a source: no choice of them comes nearer
        sizes = [r["size"] for r in rows for d, x, _ in docs if d == r.doc_id and x == s]
        target = next(r.target for r in rows for d, x, _ in docs if d == r.doc_id and x == s)
        assert abs(misses[s]) <= best_miss(sizes, target) + 0.5
    assert sorted(rows) == sorted(QUERIES["op5_mix_to_targets"](spark, SF_SMALL).collect())


def test_hot_group_nulls_and_clashes(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)   # many buckets of the hot group
    docs = [(i, "hot", "a b c") for i in range(400)] + [(1000 + i, f"s{i % 3}", "w " * (i % 40)) for i in range(300)]
    docs += [(2000, None, "x y"), (2001, None, None), (2002, "empty", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    df = df.withColumn("size", F.lit("x")).withColumn("target", F.lit(0)).withColumn("bucket", F.lit(1)).withColumn("n", F.lit(1))
    out = M.mix(df)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    misses = check(out.collect(), docs)
    assert all(abs(m) <= 3 for m in misses.values())
    assert M.mix(df.where("false")).count() == 0


def test_repeated_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y")] * 5 + [(None, "a", "z")], "doc_id long, source string, text string")
    rows = M.mix(df).collect()
    assert len(rows) == 6 and sum(r.taken for r in rows) <= 2 * 11


def test_knapsack_is_exact_on_small_cases():
    rng = random.Random(2)
    for _ in range(200):
        sizes = np.array(rng.sample(range(1, 30), rng.randint(1, 5)))
        counts = np.array([rng.randint(0, 4) for _ in sizes])
        budget = rng.randint(0, 80)
        take = M._knapsack(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * int(s) for x in sums for k in range(c + 1)}
        assert (take <= counts).all() and (take >= 0).all()
        got = int((take * sizes).sum())
        assert got in sums and abs(got - budget) == min(abs(x - budget) for x in sums)


@pytest.mark.parametrize("budget_share", [0.0, 0.013, 0.5, 0.97, 1.0])
def test_budget_is_met(budget_share):
    rng = np.random.default_rng(4)
    sizes = np.r_[0, np.unique(rng.integers(5, 3000, 800))]
    counts = rng.integers(1, 50, len(sizes))
    budget = int((sizes * counts).sum() * budget_share)
    take = M.fit_budget(sizes, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    assert abs(int((take * sizes).sum()) - budget) <= 1
