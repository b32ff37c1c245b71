"""Mentions and replies: matching, multi-reply handling, backfill
(SURVEY J5-J7, A2, W2).

Reply ids are compared as ``bigint`` (the reference compares the decimal
strings of integer ids, which is the same relation).  All "one per group"
steps use partial aggregates so a mention with a huge number of replies is
reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import sha256_hex


def mention_reply_join(mentions: DataFrame, replies: DataFrame, mention_id: str = "mention_id",
                       reply_to: str = "in_reply_to_id") -> DataFrame:
    """Pairs (mention, reply) where the reply answers the mention; NULLs never match."""
    r = replies.where(F.col(reply_to).isNotNull())
    return mentions.join(r, mentions[mention_id] == r[reply_to], "inner")


def reply_counts(replies: DataFrame, reply_to: str = "in_reply_to_id") -> DataFrame:
    return (replies.where(F.col(reply_to).isNotNull())
            .groupBy(reply_to).agg(F.count(F.lit(1)).alias("n_replies")))


def has_reply(mentions: DataFrame, replies: DataFrame, mention_id: str = "mention_id",
              reply_to: str = "in_reply_to_id") -> DataFrame:
    """Boolean form: every mention with ``replied`` and ``n_replies``."""
    counts = reply_counts(replies, reply_to)
    out = mentions.join(counts, mentions[mention_id] == counts[reply_to], "left").drop(reply_to)
    return out.withColumns({"n_replies": F.coalesce(F.col("n_replies"), F.lit(0)),
                            "replied": F.col("n_replies").isNotNull()})


def multi_reply_report(replies: DataFrame, reply_to: str = "in_reply_to_id") -> DataFrame:
    """Mentions answered more than once."""
    return reply_counts(replies, reply_to).where(F.col("n_replies") > 1)


def keep_one_reply(replies: DataFrame, reply_to: str = "in_reply_to_id",
                   order_col: str = "reply_id", keep: str = "oldest") -> DataFrame:
    """Of several replies to one mention keep one and mark the others
    ``duplicate`` (the reference deletes them).

    The reference keeps the last item of the timeline list, which the
    service returns newest first, i.e. the oldest reply: ``keep="oldest"``
    (smallest ``order_col``); ``keep="newest"`` keeps the largest.
    """
    pick = F.min(order_col) if keep == "oldest" else F.max(order_col)
    chosen = (replies.where(F.col(reply_to).isNotNull())
              .groupBy(reply_to).agg(pick.alias("__keep")))
    out = replies.join(chosen, reply_to, "left")
    return out.withColumn(
        "action",
        F.when(F.col("__keep").isNull() | (F.col(order_col) == F.col("__keep")), F.lit("keep"))
        .otherwise(F.lit("duplicate"))).drop("__keep")


def mention_backfill(mentions: DataFrame, replies: DataFrame, history: DataFrame,
                     text_col: str = "full_text") -> DataFrame:
    """History rows to insert for mentions already answered on the timeline
    but missing from the history: one per mention text hash (the reference
    re-checks the hash after each insert, so only the first survives).

    Iteration order of the reference: mentions newest first, then replies
    newest first; status ``deleted`` when the mention had several replies.
    """
    m = mentions.withColumn("in_reply_to_text_hash", sha256_hex(text_col))
    pairs = mention_reply_join(m, replies)
    n = reply_counts(replies).withColumnRenamed("in_reply_to_id", "__m")
    pairs = pairs.join(n, pairs["mention_id"] == n["__m"], "left").drop("__m")
    h = history.select(F.col("in_reply_to_text_hash").alias("__h")).where(F.col("__h").isNotNull())
    fresh = pairs.join(h, pairs["in_reply_to_text_hash"] == h["__h"], "left_anti")
    row = F.struct(
        F.col("mention_id").alias("in_reply_to_status_id"),
        F.col(text_col).alias("in_reply_to_text"),
        F.col("user_id").alias("in_reply_to_user_id"),
        F.col("user_name").alias("in_reply_to_user_name"),
        F.col("reply_text").alias("replay_text"),
        F.col("reply_id").alias("replay_tweet_id"),
        F.when(F.col("n_replies") > 1, F.lit("deleted")).otherwise(F.lit("200")).alias("status"))
    first = F.max_by(row, F.struct(F.col("mention_id"), F.col("reply_id")))
    return (fresh.groupBy("in_reply_to_text_hash").agg(first.alias("r"))
            .select("r.in_reply_to_status_id", "r.in_reply_to_text", "in_reply_to_text_hash",
                    "r.in_reply_to_user_id", "r.in_reply_to_user_name", "r.replay_text", "r.replay_tweet_id", "r.status"))


def parent_lookup(children: DataFrame, parents: DataFrame, child_ref: str, parent_id: str) -> DataFrame:
    """Each child row with the row it replies to (inner equi-join)."""
    c = children.where(F.col(child_ref).isNotNull())
    return c.join(parents, c[child_ref] == parents[parent_id], "inner")
