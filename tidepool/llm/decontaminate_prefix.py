"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every benchmark text is cut into windows of ``window`` consecutive words (one shorter
window, if it has fewer words), and every window is the set of its shingles with their
offsets.  The join that finds the windows in the documents:

1. *Order by rarity.*  All occurrences of benchmark shingles in all documents are
   counted; a window's shingles are put in that order, rarest first.
2. *Prefix.*  A document window that holds at least ``ceil(containment * m)`` of a
   window's m shingles at their offsets holds one of its ``m - ceil(containment * m) + 1``
   rarest.  Only these are joined with the documents; at containment 1 it is one shingle
   a window, and common wording never makes a candidate.
3. *Length and position.*  A shingle at document word p and window offset o means that
   the window starts at word p - o; starts before the text or windows that run past its
   last word are dropped.
4. *Verify.*  The document's words there are compared with the window's words
   (containment 1), or the shingles at equal offsets are counted.

Documents are cut into words once, written to the shared folder, and travel through the
join as one row per word inside one stage (exploded, looked up and verified without a
shuffle); only found windows are shuffled, to their own document.  The prefix table is broadcast in blocks of at most BLOCK_ROWS
rows, one scan of the words each, so its size never depends on the benchmark's.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import shared_dir

#: Rows of a broadcast block: some 200 bytes each with a window of ten words.
BLOCK_ROWS = 1 << 18
#: What stands between two words, a fixed value: ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, CAPITALS.lower())
    return F.array_remove(F.split(plain, BETWEEN), "")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window_id, win) and which items hold them (window_id, item_id)."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(window), F.lit(0)))
    cut = (rows.where(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("at"))
           .select("item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("win")).distinct())
    windows = _kept(cut.select("win").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    return windows, _kept(cut.join(windows, "win").select("window_id", "item_id"), "window-items")


def _shingle(words: Column | str, at: Column, length: int) -> Column:
    """A 64-bit token of the ``length`` words from ``at``."""
    return F.xxhash64(F.lit(length), *[F.get(words, at + F.lit(i)) for i in range(length)])


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window_id, offset, length, token): every shingle of every window; a window of
    fewer words than ``shingle`` is one shingle."""
    each = windows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("win") - F.lit(shingle), F.lit(0))))
                          .alias("offset")).withColumn("length", F.least(F.size("win"), F.lit(shingle)))
    token = reduce(lambda rest, k: F.when(F.col("length") == k, _shingle("win", F.col("offset"), k)).otherwise(rest),
                   range(1, shingle + 1), F.lit(None).cast("long"))
    return each.select("window_id", "offset", "length", token.alias("token"))


def document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, words) of every document row, cut into words once and written."""
    return _kept(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                             words_of(F.col(text_col)).alias("words")), "words")


def _exploded(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, doc_id, words, n_words, at, token): one row per word and shingle length; a
    text without words has one row with a null ``at``."""
    each = rows.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("at", "word"))
    tokens = [_shingle("words", F.col("at"), k) for k in lengths]
    if len(tokens) == 1:
        return each.select("row", "doc_id", "words", "n_words", "at", tokens[0].alias("token"))
    return each.select("row", "doc_id", "words", "n_words", "at", F.explode(F.array(*tokens)).alias("token"))


def _blocks(table: DataFrame, key: str, n_rows: int) -> list[DataFrame]:
    """The table in parts of about BLOCK_ROWS rows at most, cut by the key's hash."""
    n = math.ceil(n_rows / (BLOCK_ROWS * 3 // 4)) or 1
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)] if n > 1 else [table]


def shingle_counts(rows: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """(token, n): occurrences in all documents of each shingle that any window holds."""
    wanted = _kept(shingles.select(F.col("token").alias("wanted")).distinct(), "shingles")
    found = [_exploded(rows, lengths).join(F.broadcast(part), F.col("token") == F.col("wanted"))
             for part in _blocks(wanted, "wanted", wanted.count())]
    return reduce(DataFrame.unionAll, [f.groupBy("token").agg(F.count(F.lit(1)).alias("n")) for f in found])


def prefixes(windows: DataFrame, shingles: DataFrame, counts: DataFrame, containment: float) -> DataFrame:
    """(window_id, win, offset, token): each window's rarest shingles, as many as a match
    cannot avoid.  Shingles that no document holds need no lookup."""
    m = F.count(F.lit(1)).over(Window.partitionBy("window_id"))
    order = Window.partitionBy("window_id").orderBy("n", "token", "offset")
    ranked = (shingles.join(counts, "token", "left").fillna(0, ["n"]).withColumn("m", m)
              .withColumn("rank", F.row_number().over(order)))
    needed = F.col("m") - F.ceil(F.col("m") * F.lit(containment) - F.lit(1e-9)) + 1
    kept = ranked.where((F.col("rank") <= needed) & (F.col("n") > 0)).select("window_id", "offset", F.col("token").alias("rare"))
    return _kept(kept.join(windows, "window_id"), "prefixes")


def _verified(shingle: int, containment: float) -> Column:
    """Whether the document's window at ``start`` holds enough of the window ``win``."""
    here = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("win"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n_words"))
    if containment >= 1:
        return inside & (here == F.col("win"))
    length, of = F.least(F.size("win"), F.lit(shingle)), F.greatest(F.size("win") - F.lit(shingle), F.lit(0)) + 1
    equal = F.filter(F.sequence(F.lit(1), of), lambda i: F.slice(here, i, length) == F.slice("win", i, length))
    return inside & (F.size(equal) >= F.ceil(of * F.lit(containment) - F.lit(1e-9)))


def matched_rows(rows: DataFrame, rare: DataFrame, lengths: list[int], shingle: int, containment: float) -> DataFrame:
    """(row, doc_id, n_words, spans, windows): every document with its found windows, the
    spans [first, end) of their words and their ids, both sorted and without repeats."""
    parts = []
    for block, part in enumerate(_blocks(rare, "window_id", rare.count())):
        looked = (_exploded(rows, lengths)
                  .join(F.broadcast(part), F.col("token") == F.col("rare"), "left")
                  .withColumn("start", F.col("at") - F.col("offset")))
        sure = F.coalesce(_verified(shingle, containment), F.lit(False))
        # the first word stands for the document, found or not
        own = F.coalesce(F.col("at") == 0, F.lit(True)) if block == 0 else F.lit(False)
        span = F.struct(F.col("start").alias("first"), (F.col("start") + F.size("win")).alias("end"))
        parts.append(looked.withColumn("sure", sure).where(F.col("sure") | own).select(
            "row", "doc_id", "n_words", F.when(F.col("sure"), span).alias("span"),
            F.when(F.col("sure"), F.col("window_id")).alias("window_id")))
    return (reduce(DataFrame.unionAll, parts).groupBy("row")
            .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
                 F.array_sort(F.collect_set("span")).alias("spans"),
                 F.array_sort(F.collect_set("window_id")).alias("windows")))


def _covered(spans: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["first"], acc["end"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, containment: float = 1.0,
               doc_id_col: str = "doc_id", doc_text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): one row per document row.

    ``spans`` are the sorted [first, end) word spans of found windows, ``n_hit`` the words
    inside any of them, ``items`` the distinct ids (as strings, sorted) of the items whose
    windows were found.  With ``containment`` below 1 a window also counts as found where
    that share of its shingles stands at the same offsets.  Null texts have no words; an
    item without words has no window; items with equal ids are one item; an item whose id
    is null marks words but is not listed.  Repeated rows and null document ids stay.
    """
    if not 0 < containment <= 1 or window < 1 or shingle < 1:
        raise ValueError("containment is in (0, 1], window and shingle at least 1")
    windows, members = item_windows(items, window, item_id_col, item_text_col)
    shingles = _kept(window_shingles(windows, shingle), "window-shingles")
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect()) or [shingle]  # shingle values at most
    rows = document_words(docs, doc_id_col, doc_text_col)
    counts = shingle_counts(rows, shingles, lengths)
    rare = prefixes(windows, shingles, counts, containment)
    found = _kept(matched_rows(rows, rare, lengths, shingle, containment)
                  .withColumn("held", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256)), "found")
    # documents with the same windows (copies, shared passages) have the same items: listed once
    kinds = found.where(F.size("windows") > 0).groupBy("held").agg(F.first("windows").alias("windows"))
    listed = (kinds.select("held", F.explode("windows").alias("window_id")).join(members, "window_id")
              .where(F.col("item_id").isNotNull()).select("held", "item_id").distinct()
              .groupBy("held").agg(F.array_sort(F.collect_list("item_id")).alias("listed")))
    none = F.array().cast("array<string>")
    clean = found.where(F.size("windows") == 0).withColumn("items", none)
    hit = found.where(F.size("windows") > 0).join(listed, "held", "left").withColumn("items", F.coalesce("listed", none))
    columns = ["doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items"]
    return clean.select(*columns).unionAll(hit.select(*columns))


def digests(found: DataFrame) -> DataFrame:
    """find_items' rows with counts and a digest in place of its lists."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
