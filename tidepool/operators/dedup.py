"""Exact de-duplication against history.

The reference asks SQLite one ``EXISTS`` per candidate.  Here each check is a
single anti/semi join: Spark shuffles both sides on the key, or broadcasts
the history side when its size, estimated from its files or measured by AQE,
is under Spark's broadcast thresholds (``session.py``).  Only the key
column of the history is read (column pruning reaches the parquet scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import sha256_hex


def with_hash(df: DataFrame, text_col: str, hash_col: str) -> DataFrame:
    return df.withColumn(hash_col, sha256_hex(text_col))


def first_per_key(df: DataFrame, key: str, order_col: str, ascending: bool = True) -> DataFrame:
    """One row per ``key`` (the first by ``order_col``, a NULL order value last).

    A NULL key equals no other key: all its rows stay.  A ``max_by``/``min_by``
    aggregate over a struct of the row: partial aggregation runs map-side, so
    a hot key (one third of all rows) is reduced before the shuffle instead of
    landing whole in one task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.col(order_col)
    pick = F.min_by(row, F.struct(order.isNull(), order)) if ascending \
        else F.max_by(row, F.struct(order.isNotNull(), order))
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.groupBy(F.col(key).alias("__k"), own.alias("__own")).agg(pick.alias("__r")).select("__r.*")


def anti_seen_hash(candidates: DataFrame, history: DataFrame, cand_hash: str = "full_text_hash",
                   hist_hash: str = "input_tweet_hash") -> DataFrame:
    """Candidates whose text hash is not in the history (NULL never matches)."""
    h = history.select(F.col(hist_hash).alias("__h")).where(F.col("__h").isNotNull())
    return candidates.join(h, candidates[cand_hash] == h["__h"], "left_anti")


def anti_seen_news(news: DataFrame, history: DataFrame, hash_col: str = "description_hash",
                   url_col: str = "url", hist_hash: str = "description_hash",
                   hist_url: str = "input_text_url") -> DataFrame:
    """Drop news whose description hash OR url is already posted.

    Two chained equi anti-joins: an OR condition in one join would plan as a
    nested loop.
    """
    hh = history.select(F.col(hist_hash).alias("__h")).where(F.col("__h").isNotNull())
    hu = history.select(F.col(hist_url).alias("__u")).where(F.col("__u").isNotNull())
    out = news.join(hh, news[hash_col] == hh["__h"], "left_anti")
    return out.join(hu, out[url_col] == hu["__u"], "left_anti")


def anti_seen_mention(mentions: DataFrame, history: DataFrame, id_col: str = "mention_id",
                      hist_id: str = "in_reply_to_status_id") -> DataFrame:
    """Mentions not yet answered (ids compared as bigint on both sides)."""
    h = history.select(F.col(hist_id).cast("bigint").alias("__id")).where(F.col("__id").isNotNull())
    return mentions.join(h, mentions[id_col].cast("bigint") == h["__id"], "left_anti")


def semi_exists(candidates: DataFrame, cand_col: str, table: DataFrame, column: str) -> DataFrame:
    """Candidates whose ``cand_col`` value occurs in ``table.column``."""
    t = table.select(F.col(column).alias("__v")).where(F.col("__v").isNotNull())
    return candidates.join(t, candidates[cand_col] == t["__v"], "left_semi")


def duplicate_keys(df: DataFrame, key: str, count_col: str = "n") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
            .where(F.col(count_col) > 1))


def rank_within_group(df: DataFrame, group_col: str, order_col: str, out_col: str,
                      width: int = 4096) -> DataFrame:
    """``row_number() over (partition by group order by order)`` that never
    puts a whole group into one task.

    A numeric ``order_col`` cuts every group into pieces of ``width`` order
    values.  The piece follows from the row alone, so both branches agree on
    it, also on recomputation: rows are ranked within (group, piece), and a
    piece's offset is the count of its group's earlier pieces (one row per
    piece, combined map-side).  ``order_col`` must be unique within a group;
    a NULL order value comes first.
    """
    piece = F.floor(F.col(order_col) / F.lit(width))
    parts = df.withColumn("__piece", piece)
    local = parts.withColumn(
        "__local", F.row_number().over(Window.partitionBy(group_col, "__piece").orderBy(order_col)))
    before = (Window.partitionBy("__g").orderBy(F.col("__p").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (parts.groupBy(F.col(group_col).alias("__g"), F.col("__piece").alias("__p"))
               .agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    same = local[group_col].eqNullSafe(offsets["__g"]) & local["__piece"].eqNullSafe(offsets["__p"])
    return (local.join(offsets, same)
            .withColumn(out_col, (F.col("__local") + F.col("__offset")).cast("bigint"))
            .drop("__local", "__offset", "__piece", "__g", "__p"))
