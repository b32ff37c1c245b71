"""Classes of near duplicates against plain union-find."""

import random

import pyarrow as pa
import pytest

from tidepool.operators import classes as C
from tidepool.operators import similarity as SIM


def plain(links):
    """node -> (class, links)"""
    reach, count = {}, {}
    for a, b in links:
        for x in (a, b):
            reach.setdefault(x, {x})
            count[x] = count.get(x, 0) + 1
        if reach[a] is not reach[b]:
            reach[a] |= reach[b]
            for x in reach[b]:
                reach[x] = reach[a]
    return {x: (min(r), count[x]) for x, r in reach.items()}


def found(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    return {r["node"]: (r["class"], r["links"]) for r in C.components_and_links(df).collect()}


CASES = {
    "chain": [(i, i + 1) for i in range(60)],
    "backward chain": [(i + 1, i) for i in range(30)],
    "star": [(7, 100 + i) for i in range(50)],
    "clique": [(i, j) for i in range(25) for j in range(i + 1, 25)],
    "random": [tuple(random.Random(s).sample(range(120), 2)) for s in range(90)],
}


@pytest.mark.parametrize("name,nodes", [("chain", 8), ("backward chain", 200_000), ("star", 200_000), ("clique", 5), ("random", 20)])
def test_components_and_links(spark, monkeypatch, name, nodes):
    monkeypatch.setattr(C, "FOREST_NODES", nodes)
    links = sorted({(min(x), max(x)) for x in CASES[name]})
    assert found(spark, links) == plain(links)


def test_a_forest_is_bounded_by_its_nodes(spark):
    links = spark.createDataFrame(CASES["clique"], "a long, b long").coalesce(1)
    rows = C.spanning_forests(links).collect()
    assert sum(r["b"] is not None for r in rows) == 24 and sum(r["n"] or 0 for r in rows) == 2 * len(CASES["clique"])


def test_documents_in_classes(spark):
    base = [f"w{i}" for i in range(20)]
    text = lambda skip, *more: " ".join([w for w in base if w not in skip] + list(more))
    docs = [(5, text([])), (9, text([])), (3, text(["w0"], "x0")), (8, text(["w0", "w1"], "x0", "x1")), (1, "something else entirely"),
            (2, None), (4, ""), (6, text([])), (7, "something else entirely")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["rep"], r["class"], round(r["cosine"], 6) if r["cosine"] is not None else None, r["links"])
           for r in SIM.near_dup_classes(df, "doc_id", "text", 0.93).collect()}
    # 5 = 6 = 9 is linked to 3, 3 to 8; 5 and 8 are too far apart for a link of their own
    assert got == {3: (3, 3, 1.0, 2), 5: (5, 3, 0.95, 1), 6: (5, 3, 0.95, 1), 9: (5, 3, 0.95, 1), 8: (8, 3, 0.95, 1),
                   1: (1, 1, 1.0, 0), 7: (1, 1, 1.0, 0), 2: (None, None, None, None), 4: (4, 4, 1.0, 0)}


def test_no_links_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    assert sorted(r["class"] for r in SIM.near_dup_classes(docs, "doc_id", "text", 0.9).collect()) == [1, 2]
    assert SIM.near_dup_classes(docs.limit(0), "doc_id", "text", 0.9).count() == 0


def test_links_are_thinned_where_a_task_finds_them(spark, monkeypatch):
    monkeypatch.setattr(C, "LINKS_AT_ONCE", 7)
    links = sorted({(min(x), max(x)) for x in CASES["random"]} | {(a + 500, b + 500) for a, b in CASES["clique"]})
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
    rows = [r for out in C.thinned([batch, batch.slice(0, 0)]) for r in out.to_pylist()]
    df = spark.createDataFrame([(r["a"], r["b"], r["n"]) for r in rows], C.FOREST)
    assert {r["node"]: (r["class"], r["links"]) for r in C.components_of_forests(df).collect()} == plain(links)
    assert sum(r["b"] is not None for r in rows) < sum(r["b"] is None for r in rows) < len(links)


def test_scores_against_the_class_text_by_files(spark):
    # a file per text: a class vector travels to the file of each of its nodes
    from tidepool.operators import text_blocks as T
    docs = spark.createDataFrame([(i, " ".join(["same"] * 9 + ["a"] * i)) for i in range(12)], "doc_id long, text string")
    manifest = SIM._text_blocks(docs, "doc_id", "text", 1)
    wanted = spark.createDataFrame([(i, c) for i in range(1, 12) for c in (0, 5) if c < i], "node long, class long")
    got = {(r["node"], r["class"]): r["cosine"] for r in T.scores_of(manifest, wanted).collect()}
    cos = lambda a, b: (81 + a * b) / ((81 + a * a) ** 0.5 * (81 + b * b) ** 0.5)
    assert manifest.count() == 12 and got == {(i, c): pytest.approx(cos(i, c), abs=1e-12) for i in range(1, 12) for c in (0, 5) if c < i}
