"""Decontamination against a direct search; native plan; null, empty, short and repeated rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.oracle_check import compare
from tidepool.llm import decontaminate_prefix as D


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def windows_of(words, window):
    return {tuple(words[i:i + window]) for i in range(max(len(words) - window, 0) + 1)} if words else set()


def brute(docs, items, window=10, shingle=3, containment=1.0):
    """docs and items: lists of (id, text); one row per document."""
    by_window = {}
    for item, text in items:
        for w in windows_of(words_of(text), window):
            by_window.setdefault(w, set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found, spans = words_of(text), set(), set(), set()
        here = {tuple(words[s:s + n]) for n in {len(w) for w in by_window} for s in range(len(words) - n + 1)}
        for w, ids in by_window.items():
            if containment == 1 and w not in here:
                continue
            k = min(shingle, len(w))
            m = len(w) - k + 1
            for s in range(len(words) - len(w) + 1):
                same = sum(tuple(words[s + i:s + i + k]) == w[i:i + k] for i in range(m))
                if same >= containment * m - 1e-9 and (containment < 1 or tuple(words[s:s + len(w)]) == w):
                    hit |= set(range(s, s + len(w)))
                    spans.add((s, s + len(w)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((doc, len(words), len(hit), sorted(spans), sorted(found)))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted([(r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r.items)) for r in found.collect()], key=repr)


NUMBERS = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [
    (7, NUMBERS), (10, "Alpha beta"), (10, "gamma"), (9, None), (8, ""), (8, " .,-! "), (6, NUMBERS), (None, "delta epsilon zeta"),
    (5, "a a a a a a a a a a a"), (4, "Éa éa " * 6), (3, "x y x y x y x y x y x y x"),
]
DOCS = [
    (1, None), (2, ""), (3, "?!"), (4, NUMBERS.upper()), (5, f"start {NUMBERS}, and {NUMBERS}"), (5, f"start {NUMBERS}, and {NUMBERS}"),
    (None, "alpha BETA gamma"), (6, "alpha. beta"), (7, "one two three four five six seven eight nine"), (8, "a " * 40),
    (9, "éa éa " * 6), (10, "Éa éa " * 6), (11, "x y " * 9), (12, "delta epsilon zeta"), (13, "gamma " * 3000 + NUMBERS),
    (14, "two three four five six seven eight nine ten eleven"), (15, "zero two three four five six seven eight nine ten eleven zero"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("window_id", F.lit(1)).withColumn("doc_id", F.lit(2))
    return d, i


def test_cases_and_clashing_columns(spark):
    found = D.find_items(*frames(spark))
    assert found.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    assert rows_of(found) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("window,shingle,containment", [(4, 2, 1.0), (10, 1, 1.0), (6, 3, 0.5), (5, 2, 0.75), (1, 3, 1.0)])
def test_other_windows_and_containment(spark, window, shingle, containment):
    docs = [*DOCS, (20, "one two three nil five six seven eight nil ten eleven twelve"), (21, "a a b a a a b a a a")]
    found = D.find_items(*frames(spark, docs), window=window, shingle=shingle, containment=containment)
    assert rows_of(found) == brute(docs, ITEMS, window, shingle, containment)


def test_blocks_of_the_prefix_table_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 8)
    assert rows_of(D.find_items(*frames(spark))) == brute(DOCS, ITEMS)


def test_a_passage_in_a_third_of_the_documents(spark):
    docs = [(i, f"w{i} {NUMBERS} v{i}" if i % 3 == 0 else f"w{i} other words here") for i in range(900)]
    rows = rows_of(D.find_items(*frames(spark, docs)))
    assert rows == brute(docs, ITEMS) and sum(r[2] == 12 for r in rows) == 300


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.find_items(docs.limit(0), items).count() == 0
    rows = rows_of(D.find_items(docs, items.limit(0)))
    assert rows == brute(DOCS, [])


def test_query_matches_its_sql_and_a_direct_search(spark):
    from tidepool.llm.queries import QUERIES

    status = compare(spark, SF_SMALL, keys=["op11_decontaminate_items"], verbose=False)["op11_decontaminate_items"]
    assert status[0] == "OK" and not status[3], status
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    df = QUERIES["op11_decontaminate_items"](spark, SF_SMALL)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    want = [(d, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0)
            for d, n, h, _, ids in brute(docs, items)]
    assert sorted(map(tuple, df.collect())) == sorted(want) and any(r[-1] for r in want)
