"""News feeds: per-feed normalisation into one schema and their union
(SURVEY S4-S6, U1, X15).

Each feed is one ``select`` (renames, hashes, derived body); the union is
``unionByName`` (UNION ALL, duplicates kept) -- no shuffle anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import sha256_hex
from tidepool.operators.gates import news_age_filter
from tidepool.operators.responses import topic_fallback
from tidepool.sources.tables import page_text

NEWS_COLUMNS = ("feed", "url", "title", "description", "body", "published_at", "age_text",
                "search_term", "body_hash", "description_hash")


def _unified(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c)
                       for c in NEWS_COLUMNS])


def normalize_search_feed(df: DataFrame, search_term: str, feed: str = "news_search") -> DataFrame:
    """Feed with ``body`` and ``url``: add the search term and the body hash."""
    return _unified(df.select(
        F.lit(feed).alias("feed"), "url", "body", F.lit(search_term).alias("search_term"),
        sha256_hex("body").alias("body_hash")))


def normalize_snippet_feed(df: DataFrame, search_term: str | Column, feed: str = "news_snippets") -> DataFrame:
    """Feed with ``snippet``/``link``/``date``: snippet -> body, link -> url."""
    return _unified(df.select(
        F.lit(feed).alias("feed"), F.col("link").alias("url"), F.col("snippet").alias("body"),
        F.col("date").alias("age_text"), F.lit(search_term).alias("search_term"),
        sha256_hex("snippet").alias("body_hash")))


def headline_body(title, description):
    """``title.split(" -")[0] + ". " + description`` (NULL description -> NULL)."""
    return F.concat(F.split(F.col(title), " -")[0], F.lit(". "), F.col(description))


def normalize_article_feed(df: DataFrame, search_term: str, feed: str = "news_articles") -> DataFrame:
    """Feed with ``title``/``description``/``url``/``publishedAt``.

    A row without description gets no body and is dropped (the reference
    loses the whole batch on such a row; we keep the others).
    """
    out = df.select(
        F.lit(feed).alias("feed"), "url", "title", "description",
        headline_body("title", "description").alias("body"),
        F.col("publishedAt").alias("published_at"), F.lit(search_term).alias("search_term"),
        sha256_hex("description").alias("description_hash"))
    return _unified(out.where(F.col("body").isNotNull()))


def choose_feed(search_feed: DataFrame, snippet_feed: DataFrame, requested: str, seed: str,
                use_snippets: bool = True, max_age_hours: int = 8) -> DataFrame:
    """News of one search term from the preferred feed (both normalised).

    With ``use_snippets`` the snippet feed, young news only: the requested term if it
    has any, else the first other term in a seeded order that has.  Without, the
    search feed's news of the requested term, of any age.
    """
    if not use_snippets:
        return search_feed.where(F.col("search_term") == requested)
    young = news_age_filter(snippet_feed, max_age_hours).drop("age_minutes")
    return topic_fallback(young, "search_term", requested, seed)


def news_union(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _page_fields(pages: DataFrame) -> DataFrame:
    p = F.col("page_id")
    unit = (F.when(p % 3 == 0, F.lit(" minutes ago"))
            .when(p % 3 == 1, F.lit(" hours ago")).otherwise(F.lit(" days ago")))
    return pages.select(
        p.alias("page_id"), "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        page_text("html").alias("para"), F.concat((1 + p % 30).cast("string"), unit).alias("age"))


def _articles(fields: DataFrame) -> DataFrame:
    return fields.select(
        "url", "title", F.when(F.col("para") != "", F.col("para")).alias("description"),
        F.format_string("2024-01-%02d", (1 + F.col("page_id") % 28).cast("int")).alias("publishedAt"))


def article_feed_from_pages(pages: DataFrame) -> DataFrame:
    """Fixture: every page as a raw article."""
    return _articles(_page_fields(pages))


def search_feed_from_pages(pages: DataFrame) -> DataFrame:
    """Fixture: every page as a raw search hit."""
    return _search_hits(_page_fields(pages))


def snippet_feed_from_pages(pages: DataFrame) -> DataFrame:
    """Fixture: every page as a raw snippet with its age."""
    return _snippets(_page_fields(pages))


def _search_hits(fields: DataFrame) -> DataFrame:
    return fields.select("url", F.col("para").alias("body"))


def _snippets(fields: DataFrame) -> DataFrame:
    return fields.select(F.col("para").alias("snippet"), F.col("url").alias("link"), F.col("age").alias("date"))


def raw_feeds_from_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixture: three raw feed shapes cut from ``pages`` by ``page_id % 3``."""
    base, p = _page_fields(pages), F.col("page_id")
    return _search_hits(base.where(p % 3 == 0)), _snippets(base.where(p % 3 == 1)), _articles(base.where(p % 3 == 2))
