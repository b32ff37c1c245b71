"""Mixing sources to target weights by subset-sum budget fitting.

1. Every document's size is its number of words.  Sources share ``share`` times all
   words by weight; a source's target stops at ``cap`` times its own size and the
   excess is shared again.
2. Documents are counted by exact size per source.  Whole passes over a source come
   first; what is left of its target is a budget for one more, partial pass.
3. The budget is spread over the sizes in proportion to their counts, largest first,
   each size taking up the rounding of those before it.  A bounded-knapsack dynamic
   programme over the sizes still open then fits the last words.
4. Of each size the wanted number of documents is taken in a seeded order.

Only (source, size) counts reach a fitting task.  A group of one source and size may
hold any share of all rows: it is ranked in buckets of the seeded order, counted
first, so that only the bucket where the count ends is sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the dynamic programme fits exactly; rows a rank bucket should hold.
FIT_WORDS, BUCKET_ROWS = 32768, 512


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The sources' order and the sums run as jobs; the driver sees a handful of
    numbers a round.  Every round caps at least one source, or is the last.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    placed = sizes.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order)
    # The id counts rows within a partition in its low 33 bits.
    placed = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    if not offsets:
        return sizes.withColumn("target", F.lit(0.0))
    # One row per partition.
    starts = spark.createDataFrame(offsets, "part long, before long")
    index = F.col("before") + row
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(index, F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "source", "source_size", weight.alias("weight"))
    size = F.col("source_size").cast("double")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        full = F.col("weight") * rate > cap * size
        r = weighed.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("words"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
                        F.count(F.when(full, 1)).alias("n")).first()
        if r.n == capped or not r.weight:
            break
        rate, capped = max(0.0, total - cap * r.words) / r.weight, r.n
    return weighed.select("source", "source_size", F.least(F.col("weight") * rate, cap * size).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each size to take, at most ``counts``, so that their
    words come to the budget, or as near to it as the programme finds."""
    take = np.zeros(len(sizes), dtype=np.int64)
    open_ = sizes > 0
    all_words = int((sizes * counts).sum())
    if budget <= 0 or not all_words:
        return take
    if budget >= all_words:
        return np.where(open_, counts, 0)
    due = spent = 0
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] > 0:
            due += int(sizes[i]) * int(counts[i]) * budget
            take[i] = min(int(counts[i]), (due // all_words - spent) // int(sizes[i]))
            spent += int(take[i]) * int(sizes[i])
    # Give back some of the smallest documents, so that there is room to fit.
    rest = budget - spent
    for i in np.argsort(sizes, kind="stable"):
        if rest >= fit_words:
            break
        if take[i]:
            back = min(int(take[i]), -(-(fit_words - rest) // int(sizes[i])))
            take[i] -= back
            rest += back * int(sizes[i])
    return take + _knapsack(sizes, counts - take, rest)


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts whose words come nearest to the budget (of two
    equally near, the one below).  A size with count n stands as lots of 1, 2, 4, ...
    documents; for each sum the first lot that reached it is kept, which is enough to
    walk back.  No sum beyond twice the budget is nearer than none."""
    end = 2 * budget
    first = np.full(end + 1, -1, dtype=np.int32)
    reached = np.zeros(end + 1, dtype=bool)
    reached[0] = True
    lots: list[tuple[int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i])
        if not 0 < size <= end:
            continue
        left, lot = min(left, end // size), 1
        while left > 0 and not reached[budget]:
            n = min(lot, left)
            step = n * size
            new = np.flatnonzero(reached[:end + 1 - step] & ~reached[step:]) + step
            reached[new], first[new] = True, len(lots)
            lots.append((int(i), n))
            left, lot = left - n, lot * 2
    out = np.zeros(len(sizes), dtype=np.int64)
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = lots[first[at]]
        out[i] += n
        at -= n * int(sizes[i])
    return out


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    target, words = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    passes = int(target // words) if words else 0
    more = fit_budget(sizes, counts, round(target) - passes * words)
    return pd.DataFrame({"source": rows["source"], "size": sizes, "n": counts, "passes": passes, "more": more})


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1),
        seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        order_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row.

    ``taken`` is ``size * copies``: the words the mix takes of the row.  Sources
    stand in code point order, null last, and weigh ``weights``, repeating.  A null
    text has size 0; rows of size 0 get the source's whole passes (0 words).  Rows of
    one source and size are taken in the order of a seeded hash of ``order_col`` (the
    id by default); rows equal in it are interchangeable.  An empty table gives an
    empty result.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"),
        F.xxhash64(F.lit(seed), F.col(order_col or id_col)).alias("turn")))
    counted = cut_lineage(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = cut_lineage(targets(sources, share, cap, weights))
    fitted = counted.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = cut_lineage(fitted.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, n long, passes long, more long"))
    plan = plan.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "passes", "more", "source_size", "target")

    open_ = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    share_of_hash = F.shiftrightunsigned("turn", 32).cast("double") / F.lit(float(1 << 32))
    bucket = F.when(open_, F.floor(share_of_hash * F.ceil(F.col("n") / BUCKET_ROWS)).cast("int"))
    rows = cut_lineage(sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
                       .withColumn("bucket", bucket).drop("p_source", "p_size", "n")
                       .withColumn("full", F.when(F.col("bucket").isNull() & (F.col("more") > 0), 1).otherwise(0)))
    in_buckets = rows.where("bucket is not null")
    so_far = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = in_buckets.groupBy("source", "size", "bucket", "more").agg(F.count("*").alias("held")).withColumn(
        "left", F.col("more") - F.coalesce(F.sum("held").over(so_far), F.lit(0))).select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "held", "left")
    judged = in_buckets.join(filled, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size"))
                             & (F.col("bucket") == F.col("b_bucket")))
    ends_here = (F.col("left") > 0) & (F.col("left") < F.col("held"))
    order = Window.partitionBy("source", "size", "bucket").orderBy("turn", "doc_id")
    last = judged.where(ends_here).withColumn("full", (F.row_number().over(order) <= F.col("left")).cast("int"))
    whole = judged.where(~ends_here).withColumn("full", (F.col("left") > 0).cast("int"))
    keep = ["doc_id", "size", "source_size", "target", "passes", "full"]
    result = rows.where("bucket is null").select(keep).union(last.select(keep)).union(whole.select(keep))
    copies = F.col("passes") + F.col("full")
    return result.select("doc_id", "size", "source_size", "target",
                         (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))
