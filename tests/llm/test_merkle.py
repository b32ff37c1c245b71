"""The Merkle manifest against a tree built level by level, and appends against builds."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.oracle_check import compare
from tidepool.llm import merkle_witness as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    doc_id, source, lang, n_chars, text = row
    return h(*map(part, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def rise(nodes, paths):
    """Root of [(digest, rows below)]; adds (side, sibling) to the rows' paths."""
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), 2):
            run = nodes[i:i + 2]
            for k, (_, rows) in enumerate(run):
                for r in rows:
                    paths[r].append((k, run[1 - k][0]) if len(run) == 2 else (0, None))
            above.append((h(*[d for d, _ in run]), [r for _, rows in run for r in rows]))
        nodes = above
    return nodes[0]


def brute(rows):
    paths, groups = [[] for _ in rows], {}
    for i, r in enumerate(rows):
        groups.setdefault(r[2], []).append(i)
    subs = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        order = sorted(groups[lang], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf_of(rows[i])))
        subs.append(rise([(leaf_of(rows[i]), [i]) for i in order], paths))
    subroot = {i: d for d, below in subs for i in below}
    root = rise(subs, paths)[0] if rows else None
    out = []
    for i, r in enumerate(rows):
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        acc = leaf_of(r, int(touched))
        for side, sibling in paths[i]:
            acc = h(acc) if sibling is None else h(sibling, acc) if side else h(acc, sibling)
        proof = h(*[s for _, s in paths[i] if s])
        out.append((r[0], leaf_of(r), subroot[i], root, proof, acc, acc == root))
    return sorted(out, key=repr)


def audit(manifest):
    return sorted(map(tuple, M.audited(manifest.witnesses(), "now").collect()), key=repr)


def carried():
    one_more = [F.col(f).cast("decimal(38,0)") + 1 if f == "n_chars" else F.col(f) for f in M.FIELDS]
    return {"now": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, M.leaf_digest(one_more))}


def rows_of(n, start=0):
    return [(start + i, f"s{i % 3}" if i % 5 else None, ["en", "fr", None, "é", ""][min(i % 11, 4)], i if i % 4 else None,
             None if i % 13 == 0 else "" if i % 13 == 1 else f"text é {i}") for i in range(n)]


ODD = [(None, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 1, "x"), (3, "a", "en", 9223372036854775807, "long " * 20000),
       (3, "a", "en", 9223372036854775807, "long " * 20000), (3, "b", "en", 2, "tie"), (-4, "b", "zz", 0, "alone")]


@pytest.mark.parametrize("bits", [1, 10])
def test_against_a_tree_built_level_by_level(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BLOCK_BITS", bits)
    rows = [*rows_of(70), *ODD]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "idx", "digest", "witness", "block", "part", "seq"):
        df = df.withColumn(name, F.lit("x"))
    got = audit(M.build(df, carried=carried()))
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("cut", [0, 8, 37])
def test_append_equals_a_build_from_all(spark, monkeypatch, cut):
    monkeypatch.setattr(M, "BLOCK_BITS", 2)
    rows = rows_of(65)
    first, later = (spark.createDataFrame(x, SCHEMA) for x in (rows[:cut], rows[cut:]))
    grown = M.append(M.build(first, carried=carried()), later, carried=carried())
    assert audit(grown) == brute(rows)


def test_one_row_and_empty_table(spark):
    df = spark.createDataFrame(rows_of(1), SCHEMA)
    (row,) = audit(M.build(df, carried=carried()))
    assert row[1] == row[2] == row[3] and row[4] == h() and [row] == brute(rows_of(1))
    empty = M.audited(M.build(df.limit(0), carried=carried()).witnesses(), "now")
    assert empty.count() == 0 and empty.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_row_repeated_in_a_third_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BITS", 3)
    rows = [*rows_of(60), *[(7, "s", "en", 1, "same")] * 30]
    assert audit(M.build(spark.createDataFrame(rows, SCHEMA), carried=carried())) == brute(rows)


def test_a_changed_witness_or_leaf_does_not_fold_to_the_root():
    tree = M.OpenSubtrees()
    leaves = [sha256(bytes([i])).digest() for i in range(5)]
    for d in leaves:
        tree.append(d)
    root = tree.close(0)
    for leaf, w in zip(leaves, tree.witnesses):
        witness = b"".join(w)
        assert M.fold(leaf, witness) == root
        assert M.fold(root, witness) != root
        assert M.fold(leaf, witness[:-1] + bytes([witness[-1] ^ 1])) != root


def test_query_matches_its_sql(spark):
    status = compare(spark, SF_SMALL, keys=["op12_merkle_manifest"], verbose=False)["op12_merkle_manifest"]
    assert status[0] == "OK" and not status[3], status
