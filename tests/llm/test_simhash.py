"""SimHash near-dedup against brute force; components against union-find."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.llm import simhash_vptree as S
from tidepool.llm.components import smallest_reachable


def brute_print(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(prints):
    links = [(i, j) for i, a in enumerate(prints) for j in range(i) if bin(a ^ prints[j]).count("1") <= 4]
    return union_find(len(prints), links)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_of_whole_table(spark):
    from tidepool.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(d.text) for d in docs]
    want = brute_components(prints)
    got = {r.doc_id: r for r in QUERIES["op1_simhash_near_dedup"](spark, SF_SMALL).collect()}
    assert len(got) == len(docs) and len(set(want)) < len(docs)
    for d, p, c in zip(docs, prints, want):
        assert got[d.doc_id].fingerprint == f"{p:016x}" and got[d.doc_id].component_id == docs[c].doc_id


def flip(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def clustered(rng, n):
    """Random prints, chains of near ones, and one dense group."""
    prints = {rng.getrandbits(64) for _ in range(n)}
    for seed in list(prints)[:n // 10]:
        x = seed
        for _ in range(4):
            x = flip(rng, x, rng.randint(1, 5))
            prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {flip(rng, centre, rng.randint(1, 6)) for _ in range(n // 3)}
    return [0, *prints]


def check_links(spark, prints, **kw):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = S.links(df, **kw)
    got = {r.node & (2 ** 64 - 1): r.root for r in smallest_reachable(edges).collect()}
    want = brute_components(prints)
    groups = {}
    for p, c in zip(prints, want):
        groups.setdefault(c, []).append(signed(p))
    for g in groups.values():
        roots = {got.get(x & (2 ** 64 - 1), x) for x in g}
        assert roots == {min(g)}


def test_every_link_is_found_by_deep_trees(spark):
    prints = clustered(random.Random(5), 900)
    check_links(spark, prints, shard_rows=40)          # many shards
    check_links(spark, prints, shard_rows=100000)      # one shard a band


def test_one_tree_over_all_bits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "VISITOR_ROWS", 64)         # visitors cut into blocks, too
    check_links(spark, clustered(random.Random(6), 300), bands=1, shard_rows=20)


def test_dense_shard_emits_a_forest():
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = np.array(sorted({flip(rng, centre, 2) for _ in range(3000)}), dtype=np.uint64)
    a, b = S.shard_links(fps, fps, S.band_masks(1)[0], 4, 4)
    assert len(a) == len(fps) - 1 and set(b.tolist()) == {int(fps.min())}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, None), (1, ""), (7, " \t"), (None, "the same four words here"), (9, "the same four words here"),
            (9, "the same four words here"), (4, "one"), (None, "alone entirely by itself now yes")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(0)).withColumn("root", F.lit(0))
    out = S.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == len(rows)
    got = sorted((r.fingerprint, str(r.doc_id), r.component_id) for r in out.collect())
    zero = [g for g in got if g[0] == "0" * 16]
    assert [g[1:] for g in zero] == [("1", 1), ("3", 1), ("7", 1)]
    same = f"{brute_print(rows[3][1]):016x}"
    assert [g[1:] for g in got if g[0] == same] == [("9", 9), ("9", 9), ("None", 9)]
    assert [g[2] for g in got if g[0] == f"{brute_print(rows[7][1]):016x}"] == [None]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0


def test_very_long_text():
    text = "w1 w2 w3 w4 w5 " * 60000
    assert S.simhash(text, 4) == S.simhash("w1 w2 w3 w4 w5 " * 60000, 4) != 0
    short = "Abc déf ghi jkl mno pqr"
    assert S.simhash(short, 4) == brute_print(short)


def test_components_on_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 190), (300, 20)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        links += [(i, i + 1) for i in range(n // 3)]          # a path, the slowest shape
        links += [(n - 1, i) for i in range(n // 2, n - 1)]   # a hub
        got = dict(smallest_reachable(spark.createDataFrame([*links, (None, 1), (2, None), (5, 5)], "a long, b long")).collect())
        want = union_find(n, links)
        ends = {x for e in links for x in e if e[0] != e[1]}
        assert got == {x: want[x] for x in ends}
