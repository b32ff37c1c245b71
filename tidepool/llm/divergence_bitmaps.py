"""How far the sources of a language differ in their words, by count-level bitmaps.

Kept terms get ids in UTF-8 order.  A group (one source of a language, or the whole
language) is stored as bitsets of term ids, one per count that occurs in it: which terms
it holds exactly so often.  A term's share p in a group depends on its count alone, so
two groups' terms are compared level by level: the AND of two bitsets has the terms with
count a here and count b there, its population count times f(p(a), p(b)) is what they
add.  Terms that a group never holds are the complement of its bitsets' union within the
kept terms; they are one more level, of count 0.

The store is a table of 64-bit words; a task compares a stretch of CHUNK terms for a
block of GROUP_BLOCK groups against another, so neither a long vocabulary nor many
sources meet in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import shuffle_partitions
from tidepool.session import shared_dir

#: Terms of a stretch (64 a word), and groups of a block.
CHUNK, GROUP_BLOCK = 256, 32
#: (group, term) entries that a task counts in memory before it hands them on.
HELD_ENTRIES = 600_000
#: Entries of a batch.
HANDED_ON = 50_000
#: Shares are whole numbers of parts of this.
SCALE = 1_000_000_000
#: Bytes of a term: A-Z become a-z, other ASCII signs part terms, the rest stays.
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_PART = bytes(b for b in range(128) if b not in _LETTERS)
_AS_TERMS = bytes.maketrans(bytes(range(65, 91)) + _PART, bytes(range(97, 123)) + b" " * len(_PART))
#: In place of a group's number: the whole language, and the set of its kept terms.
WHOLE, KEPT = -1, -2


def _kept(df: DataFrame, name: str) -> DataFrame:
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group;
    counted within the tasks first.  Nulls are empty strings."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"))],
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def handed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            for i in range(0, len(n), HANDED_ON):
                words = list(islice(n, i, i + HANDED_ON))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(words)), pa.repeat(source, len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                     *(pa.array(list(map(x.__getitem__, words)), pa.int64()) for x in (n, in_docs))],
                    names=["lang", "source", "term", "n", "docs"])

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in it:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.as_py().translate(_AS_TERMS).split()
                size -= len(n)
                n.update(words)
                in_docs.update(set(words))
                size += len(n)
                if size > HELD_ENTRIES:
                    yield from handed_on(held)
                    held, size = {}, 0
        yield from handed_on(held)

    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # A task has summed up most of what it can: the rest is summed where a term's rows meet.
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, id, n): terms in at least min_docs documents of their language with
    their occurrences there; ids ascend by language and term."""
    kept = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "n"))
    ranges = shuffle_partitions(counts.sparkSession)
    return _kept(_kept(kept, "kept-terms").repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
                 .withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def groups_of(docs: DataFrame, counted: DataFrame, terms: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, no, total, size): every occurring group with its number within the
    language, the occurrences of kept terms in it, and the language's kept terms; the
    language itself as number WHOLE with a null source."""
    empty = F.lit("")
    seen = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("whole"))
    numbered = (seen.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size", "whole"])
                .withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    whole = numbered.where(F.col("no") == 0).select(
        "lang", F.lit(None).cast("string").alias("source"), F.lit(WHOLE).alias("no"), F.col("whole").alias("total"), "size")
    return _kept(numbered.select("lang", "source", "no", "total", "size").unionAll(whole), "groups")


def count_levels(counted: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """The bitmap store (lang, no, n, word, bits): word number ``word`` (ids from 64 * word)
    of the set of terms that group ``no`` holds exactly ``n`` times."""
    named = counted.join(groups.select("lang", "source", "no"), ["lang", "source"])
    entries = named.select("lang", "no", "n", "id").unionAll(terms.select("lang", F.lit(WHOLE).alias("no"), "n", "id"))
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return _kept(entries.groupBy("lang", "no", "n", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "levels")


def share(n: int, total: int, size: int) -> int:
    """The smoothed share of a term with n of a group's total occurrences."""
    return 1 + SCALE * (n + 2) // (total + 2 * size)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of whole shares: at most SCALE + 1 each, so 64 bits hold the square."""
    return (p - q) ** 2 // (p + q)


class Levels:
    """One group's stretch of the store: a row of words and a share per count, count 0
    (the complement of the others) first."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, bits: np.ndarray, kept: np.ndarray, total: int, size: int):
        held, row = np.unique(counts, return_inverse=True)
        sets = np.zeros((len(held), len(kept)), np.uint64)
        np.bitwise_or.at(sets, (row, words), bits)
        rest = kept & ~np.bitwise_or.reduce(sets, axis=0) if len(held) else kept
        self.sets = np.vstack([rest[None, :], sets])
        self.shares = np.array([share(n, total, size) for n in [0, *held.tolist()]], np.int64)

    def joint(self, other: "Levels") -> np.ndarray:
        """Number of terms at each pair of levels."""
        return np.bitwise_count(self.sets[:, None, :] & other.sets[None, :, :]).sum(-1, dtype=np.int64)


def _ids(words: np.ndarray, first: int) -> list[int]:
    return [first + 64 * k + b for k, w in enumerate(words.tolist()) for b in range(64) if w >> b & 1]


def _top_terms(group: Levels, whole: Levels, top: int, first: int) -> list[tuple[int, int]]:
    """(value, id) of the stretch's best terms: held by the group and more frequent there."""
    f = divergence(group.shares[:, None], whole.shares[None, :])
    wanted = (group.shares[:, None] > whole.shares[None, :]) & (group.joint(whole) > 0)
    wanted[0] = False
    rows, columns = np.nonzero(wanted)
    best: list[tuple[int, int]] = []
    last = None
    for k in np.argsort(-f[rows, columns], kind="stable"):
        value = int(f[rows[k], columns[k]])
        if len(best) >= top and value != last:
            break
        best += [(value, i) for i in _ids(group.sets[rows[k]] & whole.sets[columns[k]], first)]
        last = value
    return sorted(best, key=lambda x: (-x[0], x[1]))[:top]


def _stretches(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the store dealt to the tasks (lang, chunk, left, right), pairs of group blocks
    with left <= right, each with the rows of both blocks, one row per group with its
    total, and the words of the kept terms; the whole language goes to left = right."""
    per = CHUNK // 64
    block = lambda no: F.floor(no / GROUP_BLOCK).cast("int")
    chunked = levels.select("lang", F.floor(F.col("word") / per).alias("chunk"), "no", "n",
                            (F.col("word") % per).cast("int").alias("word"), "bits")
    kept = (chunked.where(F.col("no") == WHOLE).groupBy("lang", "chunk", "word").agg(F.bit_or("bits").alias("bits"))
            .select("lang", "chunk", F.lit(KEPT).alias("no"), F.lit(0).cast("long").alias("n"), "word", "bits"))
    blocks = groups.groupBy("lang").agg((block(F.max("no")) + 1).alias("blocks"))
    rows = chunked.unionByName(kept).withColumns({c: F.lit(None).cast("long") for c in ("total", "size")})
    roster = kept.select("lang", "chunk").distinct().join(groups, "lang").select(
        "lang", "chunk", "no", F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("word"),
        F.lit(None).cast("long").alias("bits"), "total", "size")
    own, turn = block(F.col("no")), F.col("turn")
    last = F.col("blocks") - 1
    dealt = rows.unionByName(roster).join(blocks, "lang")
    # the kept terms go to every pair, the whole language to every (b, b), a group to all pairs of its block
    pairs = F.when(F.col("no") == KEPT, F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(
        F.sequence(i, last), lambda j: F.struct(i.alias("left"), j.alias("right"))))))
    pairs = pairs.when(F.col("no") == WHOLE, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("left"), i.alias("right"))))
    pairs = pairs.otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.least(own, i).alias("left"), F.greatest(own, i).alias("right"))))
    return dealt.withColumn("turn", F.explode(pairs)).select(
        "lang", "chunk", turn["left"].alias("left"), turn["right"].alias("right"), "no", "n", "word", "bits", "total", "size")


def compare_groups(levels: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, a, b, id, value): per stretch, the sum of f over its terms for each pair of
    groups a < b (id null), and each group's best terms against the language (b null)."""
    per, block_size = CHUNK // 64, GROUP_BLOCK
    schema = "lang string, a int, b int, id long, value long"

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        lang, chunk, left, right = (k.as_py() for k in key)
        no = rows["no"].to_numpy()
        word = rows["word"].fill_null(0).to_numpy()
        bits = rows["bits"].fill_null(0).to_numpy().view(np.uint64)
        n, total = rows["n"].to_numpy(), rows["total"]
        kept = np.zeros(per, np.uint64)
        np.bitwise_or.at(kept, word[no == KEPT], bits[no == KEPT])
        order = np.argsort(no, kind="stable")
        starts = np.r_[0, np.flatnonzero(np.diff(no[order])) + 1, len(order)]
        held = {}
        for at, end in zip(starts[:-1], starts[1:]):
            own = order[at:end]
            if no[own[0]] == KEPT:
                continue
            (said,) = [i for i in own.tolist() if total[i].is_valid]
            own = own[n[own] > 0]
            held[int(no[said])] = Levels(n[own], word[own], bits[own], kept, total[said].as_py(), rows["size"][said].as_py())
        out = []
        for a, x in held.items():
            for b, y in held.items():
                if 0 <= a < b and a // block_size == left and b // block_size == right:
                    out.append((lang, a, b, None, int((x.joint(y) * divergence(x.shares[:, None], y.shares[None, :])).sum())))
            if left == right and a >= 0:
                out += [(lang, a, None, i, v) for v, i in _top_terms(x, held[WHOLE], top, chunk * 64 * per)]
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "a", "b", "id", "value"])

    return _stretches(levels, groups).groupBy("lang", "chunk", "left", "right").applyInArrow(compare, schema)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source).

    Part ``pair``: each other source of the language and the sum of f over its kept terms
    (0 without any), ranked from the most different.  Part ``term``: the ``top`` terms
    that are more frequent in the source than in the language, by f.  Ties go to the item
    first in UTF-8 order.  Null languages, sources and texts are empty strings; repeated
    rows count as often as they stand.
    """
    counts = _kept(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    terms = vocabulary(counts, min_docs)
    counted = _kept(counts.join(terms.select("lang", "term", "id"), ["lang", "term"]).select("lang", "source", "id", "n"), "counted")
    groups = groups_of(docs, counted, terms, lang_col, source_col)
    found = _kept(compare_groups(count_levels(counted, terms, groups), groups, top), "compared")
    names = groups.where(F.col("no") >= 0).select("lang", "source", "no")
    a, b = (names.select("lang", F.col("source").alias(x), F.col("no").alias(y)) for x, y in (("source", "a"), ("item", "b")))
    sums = found.where(F.col("b").isNotNull()).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionAll(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = (a.join(b, "lang").where(F.col("a") != F.col("b")).join(both, ["lang", "a", "b"], "left").fillna(0, ["value"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    by_value = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), "id")
    best = found.where(F.col("id").isNotNull()).withColumn("r", F.row_number().over(by_value)).where(F.col("r") <= top)
    frequent = (best.join(terms.select("id", "term"), "id").join(a, ["lang", "a"])
                .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    rank = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return pairs.unionAll(frequent).withColumn("rank", F.row_number().over(rank))
