"""License scans against a direct search; native plan."""

import re

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.llm import license_positional as L


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def places(words, phrase):
    key = phrase.split()
    return [i for i in range(len(words) - len(key) + 1) if words[i:i + len(key)] == key]


def check(rows, texts):
    for r in rows:
        words = words_of(texts[r.doc_id])
        base = {t.label: places(words, t.key) for t in L.BASE}
        every = sorted(p for ps in base.values() for p in ps)
        assert (r.n_words, r.n_base) == (len(words), len(every)), r
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted(k for k, p in base.items() if p))
        labels = {t.label for t in (*L.BASE, *L.MORE) if places(words, t.key)}
        assert r.labels == ",".join(sorted(labels))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


TEXTS = [
    None, "", "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license under the mit, license",
    "under the mit the mit license under the under the mit license", "cc by nc cc by cc-by-nc/4.0 CC  BY\nNC", "cc by nd",
    "Apache License, Version 2.0 apache license version 2 apache license version 20 version 2 apache license",
    "mit license the under", "under the mit licenseé", "under the mitK license K mit", "İ under the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "license " * 30000 + "under the mit license",
    "permission is hereby granted, free of charge, to any person", "日本 cc by nc 日本", "all rights reserved",
]


def test_cases_and_clashing_columns(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (2, TEXTS[2]), (None, "cc by nc")], "doc_id long, text string")
    df = df.withColumn("words", F.lit("x")).withColumn("held", F.lit(1)).withColumn("p0", F.lit(1))
    out = L.scan(df)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    check(rows, {**dict(enumerate(TEXTS)), None: "cc by nc"})


def test_whole_table(spark):
    from tidepool.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    df = QUERIES["op7_license_labels"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = df.collect()
    assert len(rows) == len(texts) and any(r.labels for r in rows)
    check(rows, texts)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_postings_are_the_rarest_words_of_the_key():
    idf = {"under": 0.1, "the": 0.01, "mit": 5.0, "license": 4.0}
    assert L.rare_postings(L.BASE[0], idf) == [("mit", 2), ("license", 3)]
