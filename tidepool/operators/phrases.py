"""Texts against a table of phrases.

Given as a list, each phrase is a test of its own in the plan, and a text is searched once
per phrase.  Here the phrases are a table, and the words of many texts are looked up
together (``phrase_scan``); a hit has its position.  The work per text does not depend on
the number of phrases.

Most places in texts are of few phrases.  Beyond HOT phrases, the most frequent ones (of a
sample of texts) go to each task as a trie and are found in the scan; for the others two
bit tables of their hashes, one in the scan and one before the shuffle, drop n-grams that
are none of them.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import tokens
from tidepool.operators.phrase_scan import Trie, bits_of, hits_of, maybe_of, n_bits_for, table_of
from tidepool.session import shared_dir

#: Phrases of more words are looked up by their first KEY_WORDS words.
KEY_WORDS = 4
#: Phrases that each task has, and texts whose places tell which ones.
HOT, SAMPLE = 100_000, 1000
#: Bits of the table a phrase has, and 64-bit words of the table at most (beyond, it lets
#: more through).
BITS_A_KEY, MOST_WORDS = 32, 1 << 20


def _words(text: str, fold_case: bool) -> Column:
    return tokens(F.lower(text) if fold_case else text)


def _gram(words: str, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, at + F.lit(i)) for i in range(n)])


def _written(df: DataFrame, name: str) -> DataFrame:
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def phrase_index(phrases: DataFrame, phrase_col: str, fold_case: bool = True) -> DataFrame:
    """(phrase, phrase_words, key_len, key, phrase_id), one row per distinct phrase that has
    a word."""
    each = phrases.select(F.col(phrase_col).alias("phrase")).distinct().withColumn("phrase_words", _words("phrase", fold_case))
    each = each.where(F.size("phrase_words") > 0).withColumn("key_len", F.least(F.size("phrase_words"), F.lit(KEY_WORDS)))
    key = reduce(lambda rest, n: F.when(F.col("key_len") == n, _gram("phrase_words", F.lit(0), n)).otherwise(rest),
                 range(1, KEY_WORDS + 1), F.lit(None).cast("bigint"))
    # written: its size is known when the join is planned
    return _written(each.withColumn("key", key).withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")


def _grams(texts: DataFrame, id_col: str, text_col: str, longest: dict[int, int], fold_case: bool) -> DataFrame:
    """(__id, __words, position, __words_ahead, __key) of every n-gram of the texts, for each
    key length n of ``longest``: the most words of a phrase of it."""
    rows = texts.select(F.col(id_col).alias("__id"), _words(text_col, fold_case).alias("__words"))
    places = rows.select("__id", "__words", F.posexplode("__words").alias("position", "__word"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(longest[n]).alias("ahead"), _gram("__words", F.col("position"), n).alias("key"))
                      for n in sorted(longest)]) if longest else F.array().cast("array<struct<n:int,ahead:int,key:bigint>>")
    gram = F.col("gram")
    return places.select("__id", "__words", "position", F.explode(grams).alias("gram")).where(
        F.col("position") + gram["n"] <= F.size("__words")).select(
        "__id", "__words", "position", gram["ahead"].alias("__words_ahead"), gram["key"].alias("__key"))


def _by_heat(index: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The HOT phrases most frequent in a sample of n-grams, and the others."""
    seen = sample.groupBy("__key").agg(F.count(F.lit(1)).alias("seen"))
    hot = _written(index.join(seen, F.col("key") == F.col("__key")).orderBy(F.col("seen").desc(), "phrase_id").limit(HOT)
                   .select(*index.columns), "hot-phrases")
    return hot, _written(index.join(hot.select("phrase_id"), "phrase_id", "left_anti").select(*index.columns), "cold-phrases")


def _with_bit(grams: DataFrame, index: DataFrame, n_keys: int) -> DataFrame:
    """The n-grams whose key has its bit in a table of the index's keys."""
    n_words = min(MOST_WORDS, max(1, n_keys * BITS_A_KEY // 64))
    word = lambda key: F.shiftright(F.pmod(F.col(key), F.lit(64 * n_words)), 6)
    bits = index.groupBy(word("key").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("__bits"))
    # MOST_WORDS rows at most
    return grams.join(F.broadcast(bits), word("__key") == F.col("__word")).where(F.expr("getbit(__bits, cast(__key & 63 as int)) = 1"))


def phrase_hits(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_col: str,
                fold_case: bool = True, phrase_ids: bool = False) -> DataFrame:
    """(``id_col``, phrase, position), a row for every place where a phrase's words stand
    one after the other; positions count words (``\\w+``) from 0.  ``phrase_ids``: with a
    number of each phrase, phrase_id.

    Up to HOT phrases go to each task; of more, the others' n-grams are shuffled.
    Null texts and phrases have no words; repeated phrases count once.
    """
    index = phrase_index(phrases, phrase_col, fold_case)
    sizes = index.groupBy("key_len").agg(F.max(F.size("phrase_words")), F.count(F.lit(1))).collect()   # KEY_WORDS rows at most
    longest, n = {r[0]: r[1] for r in sizes}, sum(r[2] for r in sizes)
    words = texts.select(F.col(id_col).alias("__id"), _words(text_col, fold_case).alias("__words"))
    id_type = words.schema["__id"].dataType.simpleString()
    names = [F.col("__id").alias(id_col), "phrase", "position", *["phrase_id"] * phrase_ids]

    def in_scan(of: DataFrame) -> DataFrame:
        few = of.select("phrase_words", "phrase_id").toArrow().combine_chunks()   # HOT rows at most
        trie = Trie(_column(few, "phrase_words"), few["phrase_id"].to_numpy())
        found = words.mapInArrow(hits_of(trie), f"__id {id_type}, position int, phrase_id bigint")
        return found.join(F.broadcast(of.select("phrase_id", "phrase")), "phrase_id").select(*names)

    if n <= HOT:
        return in_scan(index)
    hot, cold = _by_heat(index, _grams(texts.limit(SAMPLE), id_col, text_col, longest, fold_case))
    # What may be a phrase from here on is all that a row carries of its text, as a string
    # (words hold no space); its first KEY_WORDS words are the key.
    n_bits = n_bits_for(n)
    bits = cold.select(F.slice("phrase_words", 1, KEY_WORDS).alias("words")).mapInArrow(bits_of(n_bits), "word long, bits long")
    table = table_of(bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow(), n_bits)   # 2 ** (MOST_BITS - 6) rows at most
    rest = words.mapInArrow(maybe_of(table, longest), f"__id {id_type}, position int, __n int, __ahead string")
    start = lambda c: F.substring_index(c, " ", KEY_WORDS)
    first = F.split(start(F.col("__ahead")), " ")
    key = reduce(lambda rest, k: F.when(F.col("__n") == k, _gram(first, F.lit(0), k)).otherwise(rest), sorted(longest), F.lit(None).cast("bigint"))
    rest = _with_bit(rest.withColumn("__key", key), cold, n).select("__id", "position", "__ahead")
    cold = cold.select("phrase", "phrase_id", F.array_join("phrase_words", " ").alias("__joined"))
    found = rest.join(cold, start(F.col("__ahead")) == start(F.col("__joined")))
    whole = F.startswith(F.concat("__ahead", F.lit(" ")), F.concat("__joined", F.lit(" ")))
    return in_scan(hot).unionAll(found.where(whole).select(*names))


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].chunk(0) if table[name].num_chunks else pa.array([], table.schema.field(name).type)


def phrase_gate(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_col: str,
                fold_case: bool = True) -> DataFrame:
    """Rows of ``texts`` that hold none of the phrases (a null id is no row's id)."""
    hit = phrase_hits(texts, id_col, text_col, phrases, phrase_col, fold_case).select(F.col(id_col).alias("__hit")).distinct()
    return texts.join(hit, F.col(id_col) == F.col("__hit"), "left_anti")
