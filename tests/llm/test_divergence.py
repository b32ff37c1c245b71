"""The divergence audit against plain counting, over several stretches and group blocks."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.oracle_check import compare
from tidepool.llm import divergence_bitmaps as V

SCHEMA = "doc_id long, lang string, source string, text string"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=10, top=10):
    docs = [((lang or ""), (source or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))))
            for _, lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in in_docs.items() if n >= min_docs]
        counts = {s: Counter() for s in {d[1] for d in mine}}
        whole = Counter()
        for _, s, c in mine:
            part = Counter({t: c[t] for t in kept if t in c})
            counts[s] += part
            whole += part
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        by = lambda x: (-x[1], x[0].encode())
        for s in counts:
            pairs = sorted([(o, sum(f(share(counts[s], t), share(counts[o], t)) for t in kept)) for o in counts if o != s], key=by)
            terms = sorted([(t, f(share(counts[s], t), share(whole, t))) for t in kept
                            if counts[s][t] and share(counts[s], t) > share(whole, t)], key=by)[:top]
            out += [(lang, s, "pair", i, v, r) for r, (i, v) in enumerate(pairs, 1)]
            out += [(lang, s, "term", i, v, r) for r, (i, v) in enumerate(terms, 1)]
    return sorted(out)


def audit(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "n", "no", "word", "bits", "item", "value"):
        df = df.withColumn(name, F.lit("x"))
    out = V.audit(df, **kw)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def texts(n, sources, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abcdeé" for b in "xyzÉ日" for c in "klmnopqrs"]
    return [(i, rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(sources),
             " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60)))) for i in range(n)]


ODD = [(1, "de", "a", None), (1, "de", "a", None), (2, "de", "b", ""), (3, None, None, "..."), (4, "it", "only", "Uno due UNO 7tre tre_quattro"),
       (5, "en", "hot", "word " * 50000), (6, "en", "hot", "WORD k KK É é")]


@pytest.mark.parametrize("min_docs", [1, 3])
def test_against_plain_counts(spark, monkeypatch, min_docs):
    monkeypatch.setattr(V, "CHUNK", 64)
    monkeypatch.setattr(V, "HELD_ENTRIES", 100)
    rows = [*texts(400, ["a", "b", "c", None, "é", "zz"]), *ODD]
    assert audit(spark, rows, min_docs=min_docs) == brute(rows, min_docs)


def test_many_sources_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUP_BLOCK", 3)
    rows = texts(300, [f"s{i}" for i in range(10)])
    assert audit(spark, rows, min_docs=5, top=3) == brute(rows, 5, 3)


def test_ties_copies_and_a_hot_source(spark):
    rows = [(i, "en", "hot" if i % 3 else f"s{i % 5}", "b a c a b c" if i % 2 else "z y x") for i in range(120)]
    assert audit(spark, rows) == brute(rows)


def test_no_kept_terms_and_empty_table(spark):
    rows = [(1, "en", "a", "x"), (2, "en", "b", "y")]
    assert audit(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert V.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    assert V.share(10**12, 3 * 10**12, 5) == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 10)


def test_query_matches_its_sql(spark):
    status = compare(spark, SF_SMALL, keys=["op13_source_divergence"], verbose=False)["op13_source_divergence"]
    assert status[0] == "OK" and not status[3], status


def test_terms_meet_in_one_shuffle_and_handed_on_parts_add_up(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD_ENTRIES", 20)
    monkeypatch.setattr(V, "HANDED_ON", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", None]), rng.choice(["a", "b"]), " ".join(f"t{'x' * rng.randint(0, 9)}" for _ in range(12))) for i in range(60)]
    counted = V.term_counts(spark.createDataFrame(rows, SCHEMA))
    want: dict = {}
    for _, lang, source, text in rows:
        for word, n in Counter(text.split()).items():
            at = want.setdefault((lang or "", source, word), [0, 0])
            at[0] += n
            at[1] += 1
    assert {tuple(r)[:3]: list(r)[3:] for r in counted.collect()} == want
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(lang#\d+, source", plan)   # no sums of single tasks on the way
