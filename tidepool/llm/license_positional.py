"""License scans by a positional index of rare licence words, in Spark SQL only.

1. One pass counts, over all texts, how many hold each word of the licence
   templates; that gives the words' inverse document frequencies.
2. The index keeps, per template, the postings (offset in the template) of the two
   highest-IDF words of its mandatory key phrase.
3. A text's licence words are looked up in the index, rarest first; where both words
   of a template occur, their positions minus their offsets are intersected, which
   leaves the places where the template can start.
4. A place counts if every word of the key phrase stands there.  The rest of the
   template's words, weighted by IDF, give the score.

All work stays inside the row, as built-in array functions: no join, no explode but
of a text's few licence words, and one small shuffle of counts.  The index is as
large as the template list and is part of the query's plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between two words: ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"  # the one sign beyond ASCII whose lower case is an ASCII letter


@dataclass(frozen=True)
class Template:
    """A notice: its label, its mandatory key phrase, and what usually stands before
    and after it.  Words are lower-case and separated by single spaces."""

    label: str
    key: str
    before: str = ""
    after: str = ""

    @property
    def words(self) -> list[str]:
        return f"{self.before} {self.key} {self.after}".split()


# The phrases that every scan must find, fixed values.
BASE = (
    Template("mit", "under the mit license", "released"),
    Template("apache-2", "apache license version 2", "licensed under the", "0"),
    Template("cc-by-nc", "cc by nc", "licensed under", "4 0"),
)
# Further public notices.
MORE = (
    Template("gpl-3", "gnu general public license version 3", "this work is licensed under the"),
    Template("gpl-2", "gnu general public license version 2", "this program is licensed under the"),
    Template("gpl", "terms of the gnu general public license", "redistribute it and or modify it under the"),
    Template("lgpl", "gnu lesser general public license", "under the terms of the"),
    Template("agpl", "gnu affero general public license", "under the terms of the"),
    Template("mit", "permission is hereby granted free of charge", "", "to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms", "", "with or without modification are permitted"),
    Template("isc", "permission to use copy modify and or distribute this software", "", "for any purpose"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the", "v 2 0"),
    Template("epl", "eclipse public license", "available under the terms of the", "v 2 0"),
    Template("cc-by-sa", "cc by sa", "licensed under", "4 0"),
    Template("cc-by-nd", "cc by nd", "licensed under", "4 0"),
    Template("cc-by", "cc by 4 0", "licensed under"),
    Template("cc-by", "creative commons attribution", "licensed under a", "4 0 international license"),
    Template("cc0", "cc0 1 0", "", "universal"),
    Template("unlicense", "free and unencumbered software released into the public domain", "this is"),
    Template("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null counts as empty.  lower() also
    changes signs beyond ASCII, but none of those becomes an ASCII letter except the
    Kelvin sign, which is therefore replaced by another letter first."""
    plain = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(KELVIN), F.lit("é")))
    return F.array_remove(F.split(plain, BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each word of the vocabulary (at most one
    row per word comes back)."""
    held = F.array_intersect(words_of(F.col(text_col)), _array(vocabulary))
    counts = dict(docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count().collect())
    return counts.pop("", 0), counts


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def inverse_frequencies(n: int, counts: dict[str, int], vocabulary: list[str]) -> dict[str, float]:
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def rare_postings(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """(word, offset in the key phrase) of its two highest-IDF words (one, if the
    phrase has only one word); ties to the earlier word."""
    key = t.key.split()
    first = {w: key.index(w) for w in key}
    return [(w, first[w]) for w in sorted(first, key=lambda w: (-idf[w], first[w]))[:2]]


def _places(t: Template, idf: dict[str, float]) -> Column:
    """Starts of the key phrase in ``words``; the empty array unless the text holds
    the phrase's rare words."""
    key, rare = t.key.split(), rare_postings(t, idf)

    def starts_by(word: str, offset: int) -> Column:
        shifted = F.transform("words", lambda x, i: F.when(x == word, i - F.lit(offset)).otherwise(F.lit(-1)))
        return F.filter(shifted, lambda s: s >= 0)

    starts = [starts_by(w, o) for w, o in rare]
    common = reduce(F.array_intersect, starts)
    sure = F.filter(common, lambda s: F.slice("words", s + 1, F.lit(len(key))) == _array(key))
    seen = reduce(Column.__and__, [F.array_contains("held", w) for w, _ in rare])
    return F.when(seen, sure).otherwise(F.array().cast("array<int>"))


def _likeness(t: Template, places: Column, idf: dict[str, float]) -> Column:
    """IDF share of the template's words that stand around its first place; 0 if it
    has none."""
    ahead = len(t.before.split())
    total = sum(idf[w] for w in t.words)
    at = F.element_at(places, 1)
    parts = [F.when(F.get("words", at + F.lit(i - ahead)) == w, F.lit(idf[w] / total)).otherwise(F.lit(0.0))
             for i, w in enumerate(t.words)]
    return F.when(F.size(places) > 0, reduce(Column.__add__, parts)).otherwise(F.lit(0.0))


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score),
    one row per row.

    ``n_base`` counts all places of base phrases, overlapping ones too; first_word and
    last_word are their smallest and largest start (null without any).  Labels are
    distinct, sorted and joined by commas ('' without any); ``labels`` has those of all
    templates.  ``score`` is the best likeness of a found template, 0 without one.  A
    null text counts as empty; ids, nulls and repeats are carried as they are.
    """
    templates = [*base, *more]
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = inverse_frequencies(*document_frequencies(docs, vocabulary, text_col), vocabulary)
    looked_up = sorted({w for t in templates for w, _ in rare_postings(t, idf)}, key=lambda w: -idf[w])
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("held", F.array_intersect(_array(looked_up), F.col("words")))
    rows = rows.withColumns({f"p{i}": _places(t, idf) for i, t in enumerate(templates)})
    at = [F.col(f"p{i}") for i in range(len(templates))]
    starts = F.concat(*at[:len(base)])
    found = [F.when(F.size(p) > 0, F.lit(t.label)) for t, p in zip(templates, at)]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(found[:len(base)]).alias("base_labels"), joined(found).alias("labels"),
        F.least(F.lit(1.0), F.greatest(*[_likeness(t, p, idf) for t, p in zip(templates, at)])).alias("score"))
