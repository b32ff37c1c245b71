"""Driver tables and the views derived from them (see FIXTURES.md).

The views stand in for the reference's feeds: ``posts`` (searched posts),
``mentions``, ``replies`` (own timeline), ``responses`` (logged model answers)
and ``news``.  All are narrow projections of one table except ``replies``
(one partial aggregate + join) and ``responses`` (a skew-safe per-
conversation rank), so they stay cheap at any scale and no hot
conversation lands whole in one task.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import sha256_hex

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts_view(documents: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    full_text = F.concat(
        F.col("text"),
        F.lit(" #topic"), (n % 7).cast("string"),
        F.when(n % 3 == 0, F.lit(" #Trend_1#deal")).otherwise(F.lit("")),
        F.when(n % 5 == 0, F.lit(" @user_9 giveaway")).otherwise(F.lit("")),
        F.lit(" http://news.example.org/"), (n % 40).cast("string"),
    )
    d = F.col("doc_id")
    return documents.select(
        d.alias("post_id"), (n % 150).alias("author_id"), "lang", "source",
        full_text.alias("full_text"),
        (50 + (d * 37) % 1000).alias("followers_count"),
        (20 + (d * 53) % 1500).alias("friends_count"),
        (1 + (d * 91) % 5000).alias("statuses_count"),
        ((d * 17) % 300).alias("retweet_count"),
        (d % 11 == 0).alias("is_retweet"),
        (d % 13 == 0).alias("is_reply"),
    )


def mentions_view(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("mention_id"),
        (F.col("conv_id") % 150).alias("user_id"),
        F.concat(F.lit("user_"), (F.col("conv_id") % 150).cast("string")).alias("user_name"),
        F.concat(F.lit("@user_9 "), F.col("text"),
                 F.when(F.col("turn") % 4 == 0, F.lit(" http://news.example.org/1"))
                 .otherwise(F.lit(""))).alias("full_text"),
    )


def replies_view(conversations: DataFrame) -> DataFrame:
    # first user turn per conversation: a partial (map-side) aggregate, one
    # row per conversation, so a hot conversation costs nothing extra here.
    first_user = (conversations.where(F.col("role") == "user")
                  .groupBy("conv_id").agg(F.min("turn").alias("t")))
    r = conversations.where(F.col("role") == "assistant")
    return r.join(first_user, "conv_id").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"),
        (F.col("conv_id") * 100
         + F.when(F.col("conv_id") % 3 == 0, F.col("t")).otherwise(F.col("turn") - 1)
         ).alias("in_reply_to_id"),
        F.col("text").alias("reply_text"),
    )


def responses_view(conversations: DataFrame) -> DataFrame:
    # attempt = rank of the assistant turn within its conversation; a
    # skew-safe rank, so a conversation with a third of all rows is split
    # across tasks instead of sorted in one.
    from tidepool.operators.dedup import rank_within_group

    c, t = F.col("conv_id"), F.col("turn")
    ranked = rank_within_group(
        conversations.where(F.col("role") == "assistant").select("conv_id", "turn", "text"),
        "conv_id", "turn", "attempt")
    return ranked.select(
        c.alias("prompt_id"), "attempt",
        F.concat(
            F.when((c + t) % 4 == 0, F.lit("As an AI I cannot do that. ")).otherwise(F.lit("")),
            F.col("text"),
            F.when(c % 5 == 0, F.lit(" #sarcasm#averyverylongtag #tag")).otherwise(F.lit("")),
        ).alias("response"))


def page_text(html: str):
    """The text of all paragraphs of a page, joined by single spaces."""
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return F.regexp_replace(F.array_join(paragraphs, " "), r"<[^>]+>", "")


def news_view(pages: DataFrame) -> DataFrame:
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    para = page_text("html")
    p = F.col("page_id")
    unit = (F.when(p % 3 == 0, F.lit(" minutes ago"))
            .when(p % 3 == 1, F.lit(" hours ago")).otherwise(F.lit(" days ago")))
    return pages.select(
        p.alias("news_id"), "url",
        F.concat(F.split(title, " -")[0], F.lit(". "), para).alias("body"),
        para.alias("description"),
        F.concat((1 + p % 30).cast("string"), unit).alias("age_text"),
        F.concat(F.lit("news_"), (p % 2).cast("string")).alias("feed"),
    )


# ---- history tables taken from the views (FIXTURES.md section 2) ----------

def replied_tweets_history(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("post_id") % 10 == 0).select(
        F.col("full_text").alias("input_tweet"), F.col("post_id").alias("input_tweet_id"),
        "author_id", F.lit("ok").alias("status"),
        sha256_hex("full_text").alias("input_tweet_hash"))


def timeline_posts_history(news: DataFrame) -> DataFrame:
    # posted at a time of its own: the newest id is not the latest post
    posted = F.timestamp_seconds(F.lit(1704067200) + F.col("news_id") * 7919 % 10007 * 60)
    return news.where(F.col("news_id") % 10 == 0).select(
        posted.alias("date"),
        "body", F.col("url").alias("input_text_url"), "news_id", "description",
        sha256_hex("description").alias("description_hash"))


def mentions_history(mentions: DataFrame, replies: DataFrame) -> DataFrame:
    m = mentions.where(F.col("mention_id") % 3 == 0)
    return m.join(replies, replies.in_reply_to_id == m.mention_id).select(
        m.mention_id.alias("in_reply_to_status_id"),
        sha256_hex(m.full_text).alias("in_reply_to_text_hash"),
        replies.reply_id.alias("replay_tweet_id"))


class Tables:
    """Lazy accessors for driver tables and derived views of one scale dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def posts(self) -> DataFrame:
        return posts_view(self.table("documents"))

    @cached_property
    def mentions(self) -> DataFrame:
        return mentions_view(self.table("conversations"))

    @cached_property
    def replies(self) -> DataFrame:
        return replies_view(self.table("conversations"))

    @cached_property
    def responses(self) -> DataFrame:
        return responses_view(self.table("conversations"))

    @cached_property
    def news(self) -> DataFrame:
        return news_view(self.table("pages"))

    @cached_property
    def replied_tweets(self) -> DataFrame:
        return replied_tweets_history(self.posts)

    @cached_property
    def timeline_posts(self) -> DataFrame:
        return timeline_posts_history(self.news)

    @cached_property
    def mentions_history(self) -> DataFrame:
        return mentions_history(self.mentions, self.replies)
