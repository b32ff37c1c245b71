"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables (or views Spark derives from them) whole,
and composes library operators.  Parameters live in :mod:`params` and are
shared with the SQL oracles in :mod:`oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as X
from tidepool.operators import dedup, gates
from tidepool.plans import params as P
from tidepool.sources.tables import Tables

#: History rows by posting time; ids only break ties.
LATEST = ("date", "news_id")


def latest_order():
    return [F.col(c).desc() for c in LATEST]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def triage_candidates(t: Tables, tag: str = P.SEARCH_TAG) -> DataFrame:
    """posts -> search -> account gate -> blocklist -> ratio gate -> unseen."""
    cand = gates.posts_search(t.posts, tag)
    cand = gates.post_gate(gates.post_metrics(cand))
    cand = gates.post_blocklist(cand, phrases=P.BLOCK_PHRASES)
    cand = gates.hashtag_ratio_gate(cand)
    cand = dedup.with_hash(cand, "full_text", "full_text_hash")
    return dedup.anti_seen_hash(cand, t.replied_tweets)


@query
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the next ``n`` posts to answer, newest distinct texts first."""
    t = Tables(spark, sf_dir)
    cand = triage_candidates(t).select("post_id", "author_id", "full_text_hash")
    newest = dedup.first_per_key(cand, "full_text_hash", "post_id", ascending=False)
    return (newest.orderBy(F.col("post_id").desc()).limit(P.TRIAGE_N)
            .withColumn("hashtag", F.lit(P.SEARCH_TAG)))



# ---- sources / scans --------------------------------------------------------

@query
def posts_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.posts_search(t.posts, P.SEARCH_TAG).select("post_id", "author_id", "full_text")


@query
def posts_by_ids(spark, sf_dir):
    """Look up posts for an id list that is itself a table (labelled docs)."""
    t = Tables(spark, sf_dir)
    return dedup.semi_exists(t.posts, "post_id", t.labels, "doc_id").select("post_id", "lang")


@query
def mentions_fingerprinted(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.mentions.select("mention_id", "user_id", X.sha256_hex("full_text").alias("full_text_hash"))


# ---- gates ------------------------------------------------------------------

@query
def post_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = gates.post_metrics(t.posts)
    return m.select("post_id", F.round("ffratio", 6).alias("ffratio"),
                    F.round("frt_ratio", 6).alias("frt_ratio"))


@query
def post_gate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.post_gate(t.posts).select("post_id")


@query
def post_blocklist(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.post_blocklist(t.posts, phrases=P.BLOCK_PHRASES).select("post_id")


@query
def hashtag_ratio_gate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = X.with_hashtag_ratio(t.posts.select("post_id", "full_text"), "full_text", "r")
    return r.select("post_id", F.round("r", 6).alias("hashtag_ratio"),
                    F.coalesce(F.col("r") > F.lit(0.5), F.lit(False)).alias("passed"))


@query
def news_blocklist(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.news_blocklist(t.news, P.NEWS_BLOCK_WORDS).select("news_id")


@query
def news_age_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.news_age_filter(t.news, P.NEWS_MAX_AGE_HOURS).select("news_id", "age_minutes")


@query
def lexicon_flag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = gates.lexicon_flag(t.posts, "full_text", P.LEXICON)
    return out.select("post_id", "flagged",
                      F.when(F.col("flagged"), F.lit("careful")).otherwise(F.lit("default")).alias("mood"))


@query
def question_intent(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.question_intent(t.conversations, "text", "with an answer", "default") \
        .select("conv_id", "turn", "route")


@query
def mention_text_status(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.mention_text_status(t.mentions).select("mention_id", "prompt_text", "status")


@query
def topic_category(spark, sf_dir):
    t = Tables(spark, sf_dir)
    terms = F.array(*[F.lit(s) for s in P.SEARCH_TERMS])
    n = t.news.select("news_id", F.element_at(terms, (F.col("news_id") % len(P.SEARCH_TERMS) + 1)
                                               .cast("int")).alias("search_term"))
    return gates.topic_category(n, "search_term", "news_id", P.SEED)


@query
def response_length_gate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gates.response_length_gate(t.responses, gates.MAX_LEN_POSTS).select(
        "prompt_id", "attempt", "response_len", "length_ok")


@query
def response_flags(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    return R.response_flags(t.responses, "response", P.RESPONSE_FILTER_PHRASES).select(
        "prompt_id", "attempt", "phrase_flag", "not_comply_flag", "flagged")


# ---- text jobs ----------------------------------------------------------------

@query
def clean_posts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.posts.select("post_id", X.clean_post("full_text").alias("clean_text"))


@query
def redact_phrases(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    return t.responses.select("prompt_id", "attempt",
                              R.redact("response", P.REDACT_MAP, P.REMOVE_PHRASES).alias("redacted"))


@query
def shorten_overlong(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.responses.select("prompt_id", "attempt",
                              X.shorten_overlong("response", gates.MAX_LEN_POSTS).alias("shortened"))


@query
def cut_between_markers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = F.col("response")
    for s, e in P.CUT_MARKERS:
        c = X.cut_between_markers(c, s, e)
    return t.responses.select("prompt_id", "attempt", c.alias("cut"))


@query
def extract_between_markers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s, e = P.EXTRACT_MARKERS
    return t.responses.select("prompt_id", "attempt",
                              X.extract_between_markers("response", s, e).alias("extracted"))


@query
def trim_leading_punct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.mentions.select("mention_id", X.trim_leading_punct("full_text").alias("trimmed"))


@query
def fingerprint_posts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.posts.select("post_id", X.sha256_hex("full_text").alias("full_text_hash"))


@query
def normalize_unicode(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    return t.posts.select("post_id", R.prompt_content("full_text").alias("normalized"))


@query
def extract_symbols(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.posts.select("post_id", F.array_join(X.symbols("full_text"), ",").alias("symbols"))


@query
def longest_hashtag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.responses.select("prompt_id", "attempt", X.longest_hashtag("response").alias("longest"))
            .where(F.col("longest").isNotNull()))


@query
def hashtag_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.posts.select(F.explode(X.hashtags("full_text")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


@query
def mention_edges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.posts.select("author_id", F.explode(X.mentions("full_text")).alias("handle"))
            .groupBy("author_id", "handle").agg(F.count(F.lit(1)).alias("n")))


# ---- dates ------------------------------------------------------------------

@query
def parse_created_at(spark, sf_dir):
    from tidepool.functions import dates as D
    t = Tables(spark, sf_dir)
    off = F.when(F.col("user_id") % 2 == 0, F.lit("+0000")).otherwise(F.lit("+0130"))
    ev = t.events.select("event_id", D.format_created_at("ts", off).alias("created_at"))
    return ev.withColumn("created_epoch", D.created_at_epoch("created_at"))


@query
def activity_by_hour(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query
def since_filter(spark, sf_dir):
    from tidepool.functions import dates as D
    t = Tables(spark, sf_dir)
    since = D.days_before(P.AS_OF, P.SINCE_DAYS)
    return (t.events.where(F.col("ts") >= since.cast("timestamp_ntz"))
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


# ---- history: scans, appends, evolution, snapshots, sync ---------------------

def _ts_text(c: str) -> F.Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


@query
def history_latest(spark, sf_dir):
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    return H.latest_records(t.timeline_posts, ["body", "news_id"], P.LATEST_N, latest_order())


@query
def history_latest_pruned(spark, sf_dir):
    """As history_latest, of a history stored by day: older days are not opened."""
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    rows = Tables(spark, sf_dir).timeline_posts.select("date", "news_id", "body")
    path = shared_dir(spark, "history-by-day")
    H.write_by_day(rows, path)
    return H.latest_by_day(spark, path, rows.schema, ["body", "news_id"], P.LATEST_N, latest_order())


@query
def history_append(spark, sf_dir):
    """Triage rows written to ``replied_tweets``: aligned by name (unknown
    keys dropped, missing ones defaulted), stamped with the run time."""
    from tidepool.session import shared_dir
    t = Tables(spark, sf_dir)
    rows = (triage_candidates(t)
            .select(F.lit(P.SEARCH_TAG).alias("hashtag"), F.col("full_text").alias("input_tweet"),
                    F.col("full_text_hash").alias("input_tweet_hash"),
                    F.col("post_id").alias("input_tweet_id"),
                    F.concat(F.lit("user_"), F.col("author_id").cast("string")).alias("output_to_username"),
                    F.lit("200").alias("status"), F.col("ffratio").alias("not_a_column")))
    path = shared_dir(spark, "replied_tweets")
    return _appended(spark, rows, path, "replied_tweets")


def _appended(spark, rows: DataFrame, path: str, table: str) -> DataFrame:
    """Append as this run, read the table back."""
    from tidepool.sources import history as H
    H.append_history(rows, path, table, P.RUN_TS, P.RUN_ID)
    return H.read_history(spark, path, table).select(_ts_text("date"), *H.HISTORY_FIELDS[table])


@query
def history_append_mentions(spark, sf_dir):
    """Mentions answered on the timeline but missing from the history."""
    from tidepool.session import shared_dir
    rows = mention_backfill(spark, sf_dir)
    return _appended(spark, rows, shared_dir(spark, "mentions"), "mentions")


@query
def history_append_timeline(spark, sf_dir):
    """Unseen news recorded as posted."""
    from tidepool.session import shared_dir
    t = Tables(spark, sf_dir)
    n = dedup.with_hash(t.news, "description", "description_hash")
    rows = dedup.anti_seen_news(n, t.timeline_posts).select(
        F.lit("Finance").alias("search_term"), "body", X.sha256_hex("body").alias("body_hash"),
        "description_hash", F.col("url").alias("input_text_url"), F.col("news_id").alias("post_tweet_id"),
        F.lit("200").alias("status"))
    return _appended(spark, rows, shared_dir(spark, "timeline_posts"), "timeline_posts")


@query
def history_append_ai_params(spark, sf_dir):
    """The log record of every answered prompt."""
    from tidepool.session import shared_dir
    rows = response_log_record(spark, sf_dir).drop("prompt_id")
    return _appended(spark, rows, shared_dir(spark, "ai_params"), "ai_params")


@query
def schema_evolve(spark, sf_dir):
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    out = H.evolve_schema(t.replied_tweets, H.HISTORY_FIELDS["replied_tweets"])
    return out.withColumn("date", F.col("date").cast("string")).drop("input_tweet")


@query
def history_backup(spark, sf_dir):
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    root = shared_dir(spark, "backup")
    H.history_backup(t.replied_tweets.drop("input_tweet"), root, P.BACKUP_AS_OF)
    return spark.read.parquet(root).select("snapshot_ts", "input_tweet_id", "input_tweet_hash", "status")


@query
def snapshot_write(spark, sf_dir):
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    path = shared_dir(spark, "snapshot")
    found = gates.posts_search(t.posts, P.SEARCH_TAG).select("post_id", "author_id")
    H.snapshot_write(found, path, tag=P.SEARCH_TAG)
    return spark.read.parquet(path)


@query
def fresh_snapshot(spark, sf_dir):
    """Rows of a snapshot's files that are younger than 5 hours (by file
    modification time) at a given time: the part written before it is stale."""
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    path, posts = shared_dir(spark, "snapshot"), t.posts.select("post_id", "lang")
    posts.where(F.col("lang") != "en").withColumn("hashtag", F.lit("stale")).write.parquet(path)
    as_of = H.newest_file_time(spark, path) + 3600
    H.set_file_times(spark, path, as_of - 6 * 3600)
    posts.where(F.col("lang") == "en").withColumn("hashtag", F.lit(P.SEARCH_TAG)).write.mode("append").parquet(path)
    return H.fresh_snapshot(spark, path, 5, as_of).select("post_id", "hashtag")


@query
def snapshot_or_recompute(spark, sf_dir):
    """A snapshot too old to use is recomputed and rewritten, then read."""
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    path = shared_dir(spark, "snapshot")
    t.posts.select("post_id", F.lit("stale").alias("hashtag")).write.parquet(path)
    late = H.newest_file_time(spark, path) + 6 * 3600
    return H.snapshot_or_recompute(spark, path, 5, late,
                                   lambda: gates.posts_search(t.posts, P.SEARCH_TAG).select("post_id"), P.SEARCH_TAG)


def _sync_copies(t: Tables):
    """Two whole copies of the posts' history, each with rows of its own changed."""
    def copy(mod):
        return t.posts.select(
            F.col("post_id").alias("input_tweet_id"), X.sha256_hex("full_text").alias("input_tweet_hash"),
            F.when(F.col("post_id") % 20 == 0, F.lit(None).cast("string"))
            .when(F.col("post_id") % mod == 0, F.lit("changed")).otherwise(F.lit("ok")).alias("status"))
    a = copy(10)
    twice = F.when(F.col("input_tweet_id") % 40 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return a.withColumn("turn", F.explode(twice)).drop("turn"), copy(15)   # a has duplicated rows


@query
def sync_tables(spark, sf_dir):
    from tidepool.sources import history as H
    return H.sync_sides(*_sync_copies(Tables(spark, sf_dir)))


@query
def sync_digest(spark, sf_dir):
    """What each of two large stores lacks, found by their digests: the copies of
    sync_tables, where only one row in 500 differs."""
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    one = t.posts.select(F.col("post_id").alias("input_tweet_id"), X.sha256_hex("full_text").alias("input_tweet_hash"),
                         F.when(F.col("post_id") % 20 != 0, F.lit("ok")).alias("status"))
    twice = F.when(F.col("input_tweet_id") % 1000 == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    a = one.withColumn("turn", F.explode(twice)).drop("turn").where(F.col("input_tweet_id") % 500 != 3)
    b = one.where(F.col("input_tweet_id") % 500 != 7)
    at_a, at_b = shared_dir(spark, "store-a"), shared_dir(spark, "store-b")
    H.digest_write(a, at_a)
    H.digest_write(b, at_b)
    lacks_a, lacks_b = H.sync_digest(spark, at_a, at_b)
    return lacks_a.withColumn("side", F.lit("a")).unionByName(lacks_b.withColumn("side", F.lit("b")))


@query
def snapshot_cached(spark, sf_dir):
    """The young snapshot is used as it is; a part that has no snapshot yet is computed."""
    from tidepool.session import shared_dir
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    path, missing = shared_dir(spark, "snapshot"), shared_dir(spark, "snapshot")
    posts = t.posts.select("post_id", "lang")
    posts.where(F.col("lang") == "en").select("post_id", F.lit("cached").alias("hashtag")).write.parquet(path)
    now = H.newest_file_time(spark, path) + 3600
    cached = H.snapshot_or_recompute(spark, path, 5, now, lambda: posts.select("post_id"), "fetched")
    fetched = H.snapshot_or_recompute(spark, missing, 5, now, lambda: posts.where(F.col("lang") != "en").select("post_id"), "fetched")
    return cached.unionByName(fetched)


@query
def sync_all_tables(spark, sf_dir):
    """Every history table of one store against the other store's: mentions and
    timeline rows that one side lacks; the second store has no mentions table."""
    from tidepool.sources import history as H
    t = Tables(spark, sf_dir)
    m = t.mentions_history.select("in_reply_to_status_id", "in_reply_to_text_hash")
    p = t.timeline_posts.select("news_id", "description_hash")
    synced = H.sync_all({"mentions": m, "timeline_posts": p},
                        {"timeline_posts": t.news.select("news_id", X.sha256_hex("description").alias("description_hash"))})
    out = None
    for name, (a, b) in synced.items():
        for side, df in (("a", a), ("b", b)):
            part = df.toDF("row_key", "row_hash").select(F.lit(name).alias("table_name"), F.lit(side).alias("side"),
                                                         "row_key", "row_hash")
            out = part if out is None else out.unionByName(part)
    return out


@query
def dim_settings(spark, sf_dir):
    """Configured keywords as a broadcast dimension: posts per keyword tag."""
    t = Tables(spark, sf_dir)
    dim = spark.createDataFrame([(k,) for k in P.KEYWORDS], "keyword string")
    tags = t.posts.select(F.explode(F.array_distinct(X.hashtags("full_text"))).alias("tag"))
    hits = (tags.join(F.broadcast(dim), tags["tag"] == dim["keyword"])   # dim: caller list, bounded
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("n_posts")))
    return (dim.join(hits, "keyword", "left")
            .select("keyword", F.coalesce(F.col("n_posts"), F.lit(0)).alias("n_posts")))


# ---- joins --------------------------------------------------------------------

@query
def anti_seen_hash(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = dedup.with_hash(t.posts, "full_text", "full_text_hash")
    return dedup.anti_seen_hash(c, t.replied_tweets).select("post_id")


@query
def anti_seen_news(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = dedup.with_hash(t.news, "description", "description_hash")
    return dedup.anti_seen_news(n, t.timeline_posts).select("news_id")


@query
def anti_seen_mention(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dedup.anti_seen_mention(t.mentions, t.mentions_history).select("mention_id")


@query
def semi_exists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = dedup.with_hash(t.posts, "full_text", "full_text_hash")
    return dedup.semi_exists(c, "full_text_hash", t.replied_tweets, "input_tweet_hash").select("post_id")


def _index(spark, history: DataFrame, key):
    from tidepool.operators.key_index import KeyIndex
    return KeyIndex(spark).build(history, key)


@query
def anti_seen_hash_indexed(spark, sf_dir):
    """As anti_seen_hash, against the history's keys as they lie in buckets; half of them
    were appended later."""
    t = Tables(spark, sf_dir)
    c = dedup.with_hash(t.posts, "full_text", "full_text_hash")
    late = F.pmod(F.xxhash64("input_tweet_hash"), F.lit(2)) == 0
    index = _index(spark, t.replied_tweets.where(~late), "input_tweet_hash").append(t.replied_tweets, "input_tweet_hash")
    return index.unseen(c, "full_text_hash").select("post_id")


@query
def anti_seen_news_indexed(spark, sf_dir):
    """As anti_seen_news, with an index for each of the two keys."""
    t = Tables(spark, sf_dir)
    n = dedup.with_hash(t.news, "description", "description_hash")
    n = _index(spark, t.timeline_posts, "description_hash").unseen(n, "description_hash")
    return _index(spark, t.timeline_posts, "input_text_url").unseen(n, "url").select("news_id")


@query
def anti_seen_mention_indexed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    index = _index(spark, t.mentions_history, F.col("in_reply_to_status_id").cast("bigint"))
    return index.unseen(t.mentions, "mention_id").select("mention_id")


@query
def semi_exists_indexed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = dedup.with_hash(t.posts, "full_text", "full_text_hash")
    return _index(spark, t.replied_tweets, "input_tweet_hash").seen(c, "full_text_hash").select("post_id")


@query
def phrase_hits(spark, sf_dir):
    """Posts against a phrase table that grows with the documents (five phrases of two to
    six words from each): distinct phrases, places, and the first one's position."""
    from tidepool.operators.phrases import phrase_hits as hits
    t = Tables(spark, sf_dir)
    words = X.tokens(X.first_words(F.lower("text"), max(at + n - 1 for at, n in P.PHRASE_CUTS)))
    cuts = [F.array_join(F.slice("w", at, n), " ") for at, n in P.PHRASE_CUTS]
    phrases = t.documents.select(words.alias("w")).select(F.explode(F.array(*cuts)).alias("phrase"))
    found = hits(t.posts, "post_id", "full_text", phrases, "phrase", phrase_ids=True)
    return found.groupBy("post_id").agg(F.count_distinct("phrase_id").alias("n_phrases"), F.count(F.lit(1)).alias("n_places"),
                                        F.min("position").cast("bigint").alias("first_position"))


@query
def mention_reply_join(spark, sf_dir):
    from tidepool.operators import replies as RP
    t = Tables(spark, sf_dir)
    return RP.mention_reply_join(t.mentions, t.replies).select("mention_id", "reply_id")


@query
def mention_replied(spark, sf_dir):
    from tidepool.operators import replies as RP
    t = Tables(spark, sf_dir)
    return RP.has_reply(t.mentions, t.replies).select("mention_id", "replied", "n_replies")


@query
def mention_backfill(spark, sf_dir):
    from tidepool.operators import replies as RP
    t = Tables(spark, sf_dir)
    return RP.mention_backfill(t.mentions, t.replies, t.mentions_history)


@query
def parent_lookup(spark, sf_dir):
    from tidepool.operators import replies as RP
    t = Tables(spark, sf_dir)
    out = RP.parent_lookup(t.replies, t.mentions, "in_reply_to_id", "mention_id")
    return out.select("reply_id", "in_reply_to_id", F.col("full_text").alias("parent_text"))


# ---- aggregates / windows -------------------------------------------------------

@query
def duplicate_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dedup.duplicate_keys(t.documents.select(X.sha256_hex("text").alias("text_hash")), "text_hash")


@query
def multi_reply_report(spark, sf_dir):
    from tidepool.operators import replies as RP
    return RP.multi_reply_report(Tables(spark, sf_dir).replies)


@query
def keep_one_reply(spark, sf_dir):
    from tidepool.operators import replies as RP
    return RP.keep_one_reply(Tables(spark, sf_dir).replies).select("reply_id", "in_reply_to_id", "action")


@query
def first_accepted_attempt(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    return R.first_accepted_attempt(t.responses, "prompt_id", "attempt", "response",
                                    P.RESPONSE_FILTER_PHRASES, P.REDACT_MAP, P.REMOVE_PHRASES,
                                    P.CUT_MARKERS, gates.MAX_LEN_POSTS, P.MAX_ATTEMPTS)


@query
def seeded_pick(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    return R.seeded_pick(t.news.select("feed", "news_id"), "feed", "news_id", P.SEED)


@query
def topic_fallback(spark, sf_dir):
    """Gated posts of the requested topic, else of a seeded non-empty topic."""
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    g = gates.post_blocklist(gates.post_gate(t.posts), phrases=P.BLOCK_PHRASES)
    g = g.withColumn("topic", F.regexp_extract("full_text", r"#(topic[0-9]+)", 1))
    return R.topic_fallback(g.select("post_id", "topic"), "topic", P.FALLBACK_TOPIC, P.SEED)


@query
def response_audit(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    f = R.response_flags(t.responses, "response", P.RESPONSE_FILTER_PHRASES)
    return R.response_audit(f, ["attempt"], "response")


# ---- similarity -----------------------------------------------------------------

@query
def term_frequencies(spark, sf_dir):
    from tidepool.operators import similarity as SIM
    return SIM.term_frequencies(Tables(spark, sf_dir).documents, "doc_id", "text")


@query
def cosine_score(spark, sf_dir):
    """Similarity of each reply to the mention it answers."""
    from tidepool.operators import similarity as SIM
    t = Tables(spark, sf_dir)
    out = SIM.cosine_pairs(t.replies, "reply_id", "in_reply_to_id", t.replies, t.mentions,
                           "reply_id", "reply_text", "mention_id", "full_text")
    return out.select("reply_id", F.col("in_reply_to_id").alias("mention_id"),
                      F.round("cosine", 6).alias("cosine"))


@query
def near_dup_vs_latest(spark, sf_dir):
    from tidepool.operators import similarity as SIM
    t = Tables(spark, sf_dir)
    return SIM.near_dup_vs_latest(t.news, "news_id", "body", t.timeline_posts, "news_id", "body",
                                  P.NEAR_DUP_MAX_COS, P.LATEST_N, latest_order()).select("news_id")


@query
def near_dup_pairs(spark, sf_dir):
    from tidepool.operators import similarity as SIM
    t = Tables(spark, sf_dir)
    out = SIM.near_dup_pairs(t.documents, "doc_id", "text", P.PAIR_MIN_COS)
    return out.withColumn("cosine", F.round("cosine", 6))


@query
def near_dup_members(spark, sf_dir):
    from tidepool.operators import similarity as SIM
    return SIM.near_dup_members(Tables(spark, sf_dir).documents, "doc_id", "text")


@query
def near_dup_classes(spark, sf_dir):
    """One row per document: its class of near duplicates, the score against the class's
    text and the number of its links; the pairs are thinned where they are found."""
    from tidepool.operators import similarity as SIM
    out = SIM.near_dup_classes(Tables(spark, sf_dir).documents, "doc_id", "text", P.PAIR_MIN_COS)
    return out.withColumn("cosine", F.round("cosine", 6))


# ---- news ---------------------------------------------------------------------

@query
def news_normalized(spark, sf_dir):
    from tidepool.operators import news as N
    t = Tables(spark, sf_dir)
    f1, f2, f3 = N.raw_feeds_from_pages(t.pages)
    return N.news_union(N.normalize_search_feed(f1, "Finance"),
                        N.normalize_snippet_feed(f2, "Finance"),
                        N.normalize_article_feed(f3, "Finance"))


def _feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every page as a search hit, and as a snippet of a term that its length decides."""
    from tidepool.operators import news as N
    pages = Tables(spark, sf_dir).pages
    terms = F.array(*[F.lit(s) for s in P.SEARCH_TERMS])
    term = F.element_at(terms, (F.length("snippet") % len(P.SEARCH_TERMS) + 1).cast("int"))
    return (N.normalize_search_feed(N.search_feed_from_pages(pages), "Finance"),
            N.normalize_snippet_feed(N.snippet_feed_from_pages(pages), term))


@query
def news_feed_choice(spark, sf_dir):
    """Young snippets of the requested term; it has none, so a seeded other term."""
    from tidepool.operators import news as N
    chosen = N.choose_feed(*_feeds(spark, sf_dir), P.FALLBACK_TOPIC, P.SEED, max_age_hours=P.NEWS_MAX_AGE_HOURS)
    return chosen.select("feed", "url", "search_term", "age_text", "body_hash")


@query
def news_feed_search(spark, sf_dir):
    """The other choice of the caller: the search feed, of any age."""
    from tidepool.operators import news as N
    chosen = N.choose_feed(*_feeds(spark, sf_dir), "Finance", P.SEED, use_snippets=False)
    return chosen.select("feed", "url", "search_term", "body_hash")


@query
def news_union(spark, sf_dir):
    """Headlines + articles (UNION ALL: the same article may come twice)."""
    from tidepool.operators import news as N
    t = Tables(spark, sf_dir)
    articles_feed = N.article_feed_from_pages(t.pages)
    headlines = N.normalize_article_feed(articles_feed, "Finance", feed="top_headlines")
    articles = N.normalize_article_feed(articles_feed, "Finance", feed="all_articles")
    return N.news_union(headlines, articles).select("feed", "url", "search_term", "description_hash")


# ---- chat logs, log records, reports, nested fields --------------------------------

def _first_user_turns(t: Tables) -> DataFrame:
    """The opening user message of every conversation (its prompt)."""
    c = t.conversations.where(F.col("role") == "user")
    return (c.groupBy("conv_id")
            .agg(F.min_by(F.col("text"), F.col("turn")).alias("prompt"))
            .withColumnRenamed("conv_id", "prompt_id"))


@query
def chat_log_build(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    return R.chat_log_build(_first_user_turns(t), "prompt_id", "prompt", P.SYSTEM_TEXT, P.SETUP_TURNS, normalize=False)


@query
def chat_log_append(spark, sf_dir):
    """Continue each conversation: turns after the first two are appended
    (cleaned) after the log's last position."""
    from tidepool.operators import responses as R
    c = Tables(spark, sf_dir).conversations.select(
        "conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    history = c.where(F.col("position") <= 1)
    new = c.where(F.col("position") > 1).withColumn("position", F.col("position") - 2)
    return R.chat_log_append(history, new, "conv_id", "position", "role", "content", normalize=False)


@query
def response_log_record(spark, sf_dir):
    from tidepool.operators import responses as R
    log = chat_log_build(spark, sf_dir)
    answers = first_accepted_attempt(spark, sf_dir).select(
        "prompt_id", F.col("final_response").alias("response"), F.col("status").alias("filter"))
    return R.response_log_record(log, "prompt_id", "position", "content", answers, P.LOG_SETTINGS)


@query
def response_report(spark, sf_dir):
    from tidepool.operators import responses as R
    t = Tables(spark, sf_dir)
    temps = F.array(*[F.lit(x) for x in P.TEMPERATURES])
    df = t.responses.select(
        "prompt_id", "attempt", "response",
        F.element_at(temps, (F.col("attempt") % len(P.TEMPERATURES) + 1).cast("int")).alias("temperature"),
        F.when(F.col("prompt_id") % 2 == 0, F.lit(P.LOG_SETTINGS["model"])).alias("model"),
        F.when(F.col("prompt_id") % 3 == 0, F.lit("curious")).alias("mood"))
    return R.response_report(df, "response", {"Mood": "mood", "Temp": "temperature", "Model": "model"}) \
        .select("prompt_id", "attempt", "report")


@query
def post_flatten(spark, sf_dir):
    """Posts carrying a nested ``user`` struct, flattened with the defaults
    (followers 0, friends and statuses 1 when missing)."""
    t = Tables(spark, sf_dir)
    nested = t.posts.select(
        "post_id",
        F.struct(F.col("author_id").alias("id"),
                 F.concat(F.lit("user_"), F.col("author_id").cast("string")).alias("screen_name"),
                 F.when(F.col("post_id") % 7 != 0, F.col("followers_count")).alias("followers_count"),
                 F.when(F.col("post_id") % 9 != 0, F.col("friends_count")).alias("friends_count"),
                 F.col("statuses_count").alias("statuses_count")).alias("user"))
    return nested.select(
        "post_id", F.col("user.id").alias("user_id"), F.col("user.screen_name").alias("screen_name"),
        F.coalesce(F.col("user.followers_count"), F.lit(0)).alias("followers"),
        F.coalesce(F.col("user.friends_count"), F.lit(1)).alias("friends"),
        F.coalesce(F.col("user.statuses_count"), F.lit(1)).alias("statuses"))


@query
def event_props(spark, sf_dir):
    """JSON text column parsed with a declared schema (no inference)."""
    t = Tables(spark, sf_dir)
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


# ---- streaming ------------------------------------------------------------------------

def _sink(spark, run: dict, *columns: str) -> DataFrame:
    return spark.read.parquet(run["sink"]).select(*columns)


def _thirds(df: DataFrame, key: str) -> list[DataFrame]:
    """Three arrivals, by the key's remainder."""
    return [df.where(F.col(key) % 3 == i) for i in range(3)]


@query
def stream_length_gate(spark, sf_dir):
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_length_gate")
    J.run_rounds(spark, _thirds(t.mentions, "mention_id"), run,
                 lambda s: J.stream_length_gate(s, "full_text", P.STREAM_MIN_LEN).select("mention_id", "route"),
                 partition_by="route")
    return _sink(spark, run, "mention_id", "route")


@query
def stream_triage(spark, sf_dir):
    """Equal texts arrive in different rounds: only the first round's row stays."""
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_triage")
    J.run_rounds(spark, _thirds(t.posts, "post_id"), run,
                 batch_fn=J.triage_batch_fn(spark, t.replied_tweets, run["sink"], P.BLOCK_PHRASES))
    return _sink(spark, run, "post_id", "author_id", "full_text_hash")


@query
def stream_mentions(spark, sf_dir):
    """The last round sends a part of the first again."""
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_mentions")
    first, second, third = _thirds(t.mentions, "mention_id")
    again = first.where(F.col("user_id") % 2 == 0)
    J.run_rounds(spark, [first, second, third.unionByName(again)], run,
                 lambda s: J.mentions_stream(s, t.mentions_history))
    return _sink(spark, run, "in_reply_to_status_id", "in_reply_to_text_hash", "status")


@query
def stream_news(spark, sf_dir):
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_news")
    pick = J.news_batch_fn(spark, t.timeline_posts, run["sink"], P.LATEST_N, P.NEAR_DUP_MAX_COS, P.SEED,
                           P.STREAM_BLOCK_WORDS, P.STREAM_MAX_AGE_HOURS, P.FIRST_ROUND)
    J.run_rounds(spark, _thirds(t.news, "news_id"), run, batch_fn=pick)
    return _sink(spark, run, "batch_id", "news_id")


@query
def stream_dedup(spark, sf_dir):
    """Events in three rounds, 1 in 200 of them sent again in a fourth."""
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_dedup")
    ev = t.events.select("event_id", "user_id", "event_type", "value")
    again = ev.where(F.col("event_id") % 200 == 7)
    J.run_rounds(spark, [*_thirds(ev, "event_id"), again], run, batch_fn=J.dedup_batch_fn(spark, run["sink"], "event_id"))
    return _sink(spark, run, "event_id", "user_id", "event_type", "value")


@query
def stream_dedup_bounded(spark, sf_dir):
    """The month's events in three rounds, with state for two days only.  Each round sends
    some events again: of its own time, within the watermark, and long behind it; the
    last one also brings events of the first days that had not arrived yet."""
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_dedup_bounded")
    ev = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    missed = (F.col("event_id") % 50 == 3) & (F.dayofmonth("ts") <= 4)
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    first, second, last = (ev.where((third == i) & ~missed) for i in range(3))
    again = ev.where((F.col("event_id") % 200 == 7) & ~missed)
    J.run_bounded_dedup(spark, [first.unionByName(again.where(third == 0)), second.unionByName(again.where(third <= 1)),
                                last.unionByName(again).unionByName(ev.where(missed))], run, "event_id", "ts", "2 days")
    return J.read_deduped(spark, run, ["event_id", "user_id", "event_type"])


@query
def stream_mentions_lookup(spark, sf_dir):
    """The mentions loop without a state store, with the history read in every round."""
    from tidepool.streaming import jobs as J
    t = Tables(spark, sf_dir)
    run = J.new_run(spark, "stream_mentions_lookup")
    first, second, third = _thirds(t.mentions, "mention_id")
    again = first.where(F.col("user_id") % 2 == 0)
    J.run_rounds(spark, [first, second, third.unionByName(again)], run,
                 batch_fn=J.mentions_batch_fn(spark, lambda: t.mentions_history, run["sink"]))
    return _sink(spark, run, "in_reply_to_status_id", "in_reply_to_text_hash", "status")
