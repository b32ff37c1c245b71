"""Row gates on posts, mentions, news and responses.

Every gate is one narrow ``select``/``filter``: no shuffle, pushed below any
join by Catalyst, and the cheap numeric tests sit before the text tests so a
parquet scan can skip work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T

# ---- fixed values taken from the reference's gates ------------------------
# Post gate thresholds: length > 70, followers/friends < 1.2,
# followers/statuses > 0.023, statuses > 100, followers > 100, retweets < 200.
MIN_TEXT_LEN = 70
MAX_FF_RATIO = 1.2
MIN_FRT_RATIO = 0.023
MIN_STATUSES = 100
MIN_FOLLOWERS = 100
MAX_RETWEETS = 200
# Spam stop tokens matched against a single-space split of the lowercased text.
DEFAULT_STOP_TOKENS = ("rt", "follow", "tag", "airdrop", "giveaway", "binary")
# Phrases that route a post to the "answer a question" mood.
QUESTION_PHRASES = ("have questions", "have a question")
# Search-term -> news category (anything else: "business").
BUSINESS_TERMS = ("Investing", "management", "Finance", "Risk", "Economy")
RANDOM_CATEGORY_TERMS = {"Discoveries": ("general", "technology")}
DEFAULT_CATEGORY = "business"
# Response length limits per job: posts 280, mentions 280, news 250.
MAX_LEN_POSTS = 280


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- posts ----------------------------------------------------------------

def post_metrics(posts: DataFrame) -> DataFrame:
    """Add ``ffratio`` and ``frt_ratio`` (missing followers -> 0, divisors >= 1)."""
    followers = F.coalesce(F.col("followers_count"), F.lit(0))
    friends = F.greatest(F.coalesce(F.col("friends_count"), F.lit(1)), F.lit(1))
    statuses = F.greatest(F.coalesce(F.col("statuses_count"), F.lit(1)), F.lit(1))
    return posts.withColumns({
        "ffratio": followers.cast("double") / friends,
        "frt_ratio": followers.cast("double") / statuses,
    })


def post_gate_condition(min_text_len: int = MIN_TEXT_LEN, max_ffratio: float = MAX_FF_RATIO,
                        min_frt_ratio: float = MIN_FRT_RATIO, min_statuses: int = MIN_STATUSES,
                        min_followers: int = MIN_FOLLOWERS,
                        max_retweets: int = MAX_RETWEETS) -> Column:
    followers = F.coalesce(F.col("followers_count"), F.lit(0))
    statuses = F.coalesce(F.col("statuses_count"), F.lit(0))
    return ((statuses > min_statuses) & (followers > min_followers)
            & (F.col("retweet_count") < max_retweets)
            & (F.col("ffratio") < max_ffratio) & (F.col("frt_ratio") > min_frt_ratio)
            & (F.length("full_text") > min_text_len))


def post_gate(posts: DataFrame, **thresholds) -> DataFrame:
    """Account-quality gate (needs :func:`post_metrics` columns; added if absent)."""
    if "ffratio" not in posts.columns:
        posts = post_metrics(posts)
    return posts.where(post_gate_condition(**thresholds))


def blocklist_condition(text_col="full_text", stop_tokens: Sequence[str] = DEFAULT_STOP_TOKENS,
                        phrases: Sequence[str] = ()) -> Column:
    """True when no stop token is a single-space word and no phrase occurs."""
    low = F.lower(_col(text_col))
    ok = F.lit(True)
    if stop_tokens:
        ok = ~F.arrays_overlap(F.split(low, " ", -1),
                               F.array(*[F.lit(s.lower()) for s in stop_tokens]))
    for p in phrases:
        ok = ok & ~low.contains(p.lower())
    return ok


def post_blocklist(posts: DataFrame, stop_tokens: Sequence[str] = DEFAULT_STOP_TOKENS,
                   phrases: Sequence[str] = (), text_col: str = "full_text") -> DataFrame:
    return posts.where(blocklist_condition(text_col, stop_tokens, phrases))


def hashtag_ratio_gate(posts: DataFrame, text_col: str = "full_text",
                       min_ratio: float = 0.5) -> DataFrame:
    """Keep posts whose words-per-hashtag ratio is above ``min_ratio``."""
    scored = T.with_hashtag_ratio(posts, text_col, "__ratio")
    return scored.where(F.col("__ratio") > F.lit(min_ratio)).drop("__ratio")


def posts_search(posts: DataFrame, hashtag: str, lang: str = "en") -> DataFrame:
    """``#tag -filter:retweets -filter:reply`` in one language."""
    tag = hashtag.replace("#", "")
    return (posts
            .where((F.col("lang") == lang) & ~F.col("is_retweet") & ~F.col("is_reply"))
            .where(F.array_contains(T.hashtags("full_text"), tag)))


def lexicon_flag(df: DataFrame, text_col: str, lexicon, flag_col: str = "flagged",
                 id_col: str | None = None) -> DataFrame:
    """Flag rows whose '#'-stripped, lowercased words meet ``lexicon``.

    ``lexicon`` is the caller's choice of a list (checked inline with
    ``arrays_overlap``) or a one-column DataFrame ``term``: the distinct words
    of each row are semi-joined to it and the hits joined back on ``id_col``.
    Both give the same flags; a NULL text is not flagged.  Multi-word entries
    never match a single word.
    """
    low_words = T.words(F.lower(F.replace(_col(text_col), F.lit("#"), F.lit(""))))
    if isinstance(lexicon, DataFrame):
        if id_col is None:
            raise ValueError("a DataFrame lexicon needs id_col")
        hits = (df.select(id_col, F.explode(F.array_distinct(low_words)).alias("term"))
                .join(lexicon.select(F.lower("term").alias("term")), "term", "left_semi")
                .select(id_col).distinct().withColumn(flag_col, F.lit(True)))
        return (df.join(hits, id_col, "left")
                .withColumn(flag_col, F.coalesce(F.col(flag_col), F.lit(False))))
    terms = [t.lower() for t in lexicon]
    if not terms:
        return df.withColumn(flag_col, F.lit(False))
    hit = F.arrays_overlap(low_words, F.array(*[F.lit(t) for t in terms]))
    return df.withColumn(flag_col, F.coalesce(hit, F.lit(False)))


def question_intent(df: DataFrame, text_col: str, answer_route: str, default_route: str,
                    route_col: str = "route") -> DataFrame:
    low = F.lower(_col(text_col))
    hit = F.lit(False)
    for p in QUESTION_PHRASES:
        hit = hit | low.contains(p)
    return df.withColumn(route_col, F.when(hit, F.lit(answer_route)).otherwise(F.lit(default_route)))


# ---- mentions -------------------------------------------------------------

def mention_text_status(mentions: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Prompt text without @words; status ``no text`` when only links/@words remain."""
    t = _col(text_col)
    residue = T.remove_mentions(T.clean_links(t))
    has_text = T.strip_ws(residue) != ""
    return mentions.withColumns({
        "prompt_text": T.remove_mentions(t),
        "status": F.when(has_text, F.lit("ok")).otherwise(F.lit("no text")),
    })


# ---- news -----------------------------------------------------------------

def news_blocklist(news: DataFrame, words: Sequence[str], body_col: str = "body") -> DataFrame:
    """Drop news whose body contains any word (case-sensitive substring)."""
    body = _col(body_col)
    ok = F.lit(True)
    for w in words:
        ok = ok & ~body.contains(w)
    return news.where(ok)


def age_minutes(age_text) -> Column:
    """``"N minutes|hours|days ago"`` -> minutes (NULL when unparsable)."""
    parts = F.split(_col(age_text), " ")
    n = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    unit = F.try_element_at(parts, F.lit(2))
    return (F.when(unit.isin("minute", "minutes"), n)
            .when(unit.isin("hour", "hours"), n * 60)
            .when(unit.isin("day", "days"), n * 1440))


def news_age_filter(news: DataFrame, hours_since: int, age_col: str = "age_text") -> DataFrame:
    """Keep news at most ``hours_since`` hours old."""
    return (news.withColumn("age_minutes", age_minutes(age_col))
            .where(F.col("age_minutes") <= F.lit(60 * hours_since)))


def seeded_choice(options: Sequence[str], seed: str, key: Column) -> Column:
    """Deterministic pick among literal options: smallest md5(seed:key:option)."""
    ks = key.cast("string")
    best = None
    for o in options:
        h = F.md5(F.concat(F.lit(seed + ":"), ks, F.lit(":" + o)))
        cand = F.struct(h.alias("h"), F.lit(o).alias("o"))
        best = cand if best is None else F.least(best, cand)
    return best.getField("o")


def topic_category(df: DataFrame, term_col: str, id_col: str, seed: str,
                   category_col: str = "category") -> DataFrame:
    """Search term -> news category; random branches become a seeded pick."""
    term = _col(term_col)
    expr = F.when(term.isin(*BUSINESS_TERMS), F.lit("business"))
    for t, opts in RANDOM_CATEGORY_TERMS.items():
        expr = expr.when(term == t, seeded_choice(opts, seed, _col(id_col)))
    return df.withColumn(category_col, expr.otherwise(F.lit(DEFAULT_CATEGORY)))


# ---- responses ------------------------------------------------------------

def response_length_gate(df: DataFrame, max_len: int, text_col: str = "response",
                         ok_col: str = "length_ok") -> DataFrame:
    return df.withColumns({"response_len": F.length(_col(text_col)),
                           ok_col: F.length(_col(text_col)) <= max_len})
