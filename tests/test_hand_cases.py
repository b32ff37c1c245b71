"""Hand-written cases (FIXTURES.md section 4 and SURVEY section 2.13).

Expected values are worked out by hand from the documented semantics; the
inputs are literal DataFrames of a few rows.
"""

import pytest
from pyspark.sql import functions as F

from tidepool.functions import dates as D
from tidepool.functions import text as X
from tidepool.operators import gates, responses
from tidepool.operators import similarity as SIM
from tidepool.sources import history as H


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"t {dtype}")
    return df.select(expr(F.col("t")).alias("r")).first()["r"]


def test_hashtags(spark):
    assert one(spark, X.hashtags, "a #b_1 ##c x#d #été") == ["b_1", "c", "d"]


def test_remove_symbols(spark):
    assert one(spark, X.remove_symbols, "I got $AAPL 10 a1 ok") == "got ok"


def test_clean_post_order(spark):
    # links -> symbols -> hashtags -> @mentions
    assert one(spark, X.clean_post, "hello @bob see http://x.y/z #tag $X  now") == "hello see now"


def test_hashtag_ratio_boundaries(spark):
    six = "alpha beta gamma delta epsilon zeta"   # 6 words, >= 20 chars, no tag -> 0.6
    five = "alpha beta gamma delta epsilon"       # 5 words -> 0.5, not > 0.5
    posts = spark.createDataFrame([(1, six), (2, five), (3, "short text"), (4, None)], "post_id long, full_text string")
    r = {x["post_id"]: x["r"] for x in X.with_hashtag_ratio(posts, "full_text", "r").collect()}
    assert abs(r[1] - 0.6) < 1e-12 and abs(r[2] - 0.5) < 1e-12 and r[3] is None is r[4]   # 3: under 20 chars
    assert [x["post_id"] for x in gates.hashtag_ratio_gate(posts).collect()] == [1]


def test_shorten_overlong(spark):
    assert one(spark, X.replace_longest_hashtag, "x #a#long #b") == "x #a #b"
    assert one(spark, X.replace_longest_hashtag, "no tags here") == "no tags here"
    assert one(spark, lambda c: X.shorten_overlong(c, 100), "x #a#long #b") == "x #a#long #b"


def test_cut_between_markers(spark):
    assert one(spark, lambda c: X.cut_between_markers(c, "Let's", "#"), "go. Let's stop #t") == "go. #t"
    # end marker before start: unchanged (ours)
    assert one(spark, lambda c: X.cut_between_markers(c, "Let's", "#"), "#t go. Let's stop") == "#t go. Let's stop"
    assert one(spark, lambda c: X.cut_between_markers(c, "zzz", "#"), "go #t") == "go #t"


def test_extract_between_markers(spark):
    assert one(spark, lambda c: X.extract_between_markers(c, "[", "]"), "a [ inner ] b") == "inner"
    assert one(spark, lambda c: X.extract_between_markers(c, "[", "]"), "a inner b") is None


def test_trim_leading_punct(spark):
    assert one(spark, X.trim_leading_punct, "#@!hi#") == "hi#"


def test_lexicon_flag(spark):
    df = spark.createDataFrame([(1, "#Cat dog")], "id long, t string")
    assert gates.lexicon_flag(df, "t", ["cat"]).first()["flagged"] is True
    assert gates.lexicon_flag(df, "t", ["cat dog"]).first()["flagged"] is False
    lex = spark.createDataFrame([("CAT",)], "term string")
    assert gates.lexicon_flag(df, "t", lex, id_col="id").first()["flagged"] is True


def test_news_age_filter(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(
        ["5 minutes ago", "8 hours ago", "9 hours ago", "2 days ago"])], "i int, age_text string")
    kept = sorted(r["i"] for r in gates.news_age_filter(df, 8).collect())
    assert kept == [0, 1]


def test_parse_created_at(spark):
    epoch = one(spark, D.created_at_epoch, "Wed Oct 10 20:19:24 +0000 2018")
    assert epoch == 1539202764
    # the offset is honoured
    assert one(spark, D.created_at_epoch, "Wed Oct 10 20:19:24 +0130 2018") == 1539202764 - 5400


def test_sync_tables(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (9, "q")], "k int, v string")
    new_a, new_b = H.sync_tables(a, b)
    assert sorted(map(tuple, new_b.collect()), key=str) == sorted(
        [(1, None), (9, "q"), (2, "x"), (2, "x")], key=str)
    assert sorted(map(tuple, new_a.collect()), key=str) == sorted(
        [(1, None), (2, "x"), (2, "x"), (9, "q")], key=str)
    # a second sync adds nothing
    a2, b2 = H.sync_tables(new_a, new_b)
    assert a2.count() == new_a.count() and b2.count() == new_b.count()


def test_cosine_pairs(spark):
    t = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a a b"), (4, "a b")], "id long, t string")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "x long, y long")
    got = {(r["x"], r["y"]): r["cosine"] for r in
           SIM.cosine_pairs(pairs, "x", "y", t, t, "id", "t", "id", "t").collect()}
    assert got[(1, 2)] == 0.0
    assert abs(got[(3, 4)] - 0.948683) < 1e-6


def test_near_dup_pairs_self_and_copies(spark):
    t = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a b d"), (4, "x y z")], "id long, t string")
    rows = SIM.near_dup_pairs(t, "id", "t", 0.6).collect()
    assert [(r["a_id"], r["b_id"], r["a_copies"], r["b_copies"]) for r in rows] == [(1, 3, 2, 1)]
    assert abs(rows[0]["cosine"] - 2 / 3) < 1e-12


def test_redact_and_remove(spark):
    mapping = [("#Sarcasm", "#nooffense"), ("#grumpy", "")]
    assert one(spark, lambda c: X.replace_phrases_lowercasing(c, mapping), "Hi #SARCASM #grumpy") == \
        "hi #nooffense "
    # untouched unless a phrase is present; then lowercased and removed
    assert one(spark, lambda c: X.remove_phrases_if_present(c, ["respectfully "]), "Keep Case") == "Keep Case"
    assert one(spark, lambda c: X.remove_phrases_if_present(c, ["respectfully "]), "I Respectfully Disagree") == \
        "i disagree"


def test_not_comply_flag(spark):
    assert one(spark, responses.not_comply_flag, "As an AI, I Cannot") is True
    assert one(spark, responses.not_comply_flag, "as an ai, i cannot") is False   # "AI" is case-sensitive


def test_phrase_whole_word_option(spark):
    # substring match by default ("human" hits "humane"); whole-word on request
    assert one(spark, lambda c: X.any_phrase(c, ["human"]), "a humane act") is True
    assert one(spark, lambda c: X.any_phrase(c, ["human"], whole_word=True), "a humane act") is False


def test_align_and_evolve(spark):
    df = spark.createDataFrame([("t", "5", "junk")], "input_tweet string, input_tweet_id string, extra string")
    out = H.align_to_schema(df, H.history_schema("replied_tweets"), run_ts="2024-01-02 03:04:05")
    r = out.first()
    assert out.columns == ["date"] + H.HISTORY_FIELDS["replied_tweets"]
    assert r["input_tweet_id"] == 5 and r["output_tweet_id"] == 0 and r["status"] is None
    again = H.align_to_schema(out, H.history_schema("replied_tweets"), run_ts="2024-01-02 03:04:05")
    assert again.collect() == out.collect()   # idempotent
    ev = H.evolve_schema(spark.createDataFrame([(1,)], "temperature_x long"), ["temperature", "post_tweet_id"])
    assert dict(ev.dtypes)["temperature"] == "double" and ev.first()["post_tweet_id"] == 0


def test_nfkd(spark):
    assert one(spark, responses.prompt_content, "ﬁne é http://x.y") == "fine é "


def test_append_history_runs(spark):
    from tidepool.session import shared_dir
    path, at = shared_dir(spark, "test_append"), "2024-01-02 03:04:05"
    rows = spark.createDataFrame([("t1", 1), ("t2", 2)], "input_tweet string, input_tweet_id long")
    H.append_history(rows, path, "replied_tweets", at, "a")
    H.append_history(rows, path, "replied_tweets", at, "a")              # retried run
    H.append_history(rows.limit(1), path, "replied_tweets", at, "b")     # another run of the same second
    back = H.read_history(spark, path, "replied_tweets")
    assert back.count() == 3
    assert back.where("run = '20240102030405-a'").count() == 2


def test_old_history_files_read_back_defaults(spark):
    from tidepool.session import shared_dir
    path = shared_dir(spark, "test_old")
    spark.createDataFrame([("t1",)], "input_tweet string").write.parquet(f"{path}/run=old-a")
    spark.createDataFrame([("t2", "junk")], "input_tweet string, input_tweet_id string").createOrReplaceTempView("v")
    H.append_history(spark.table("v"), path, "replied_tweets", "2024-01-02 03:04:05", "b")   # not a number: default
    got = {r["input_tweet"]: (r["input_tweet_id"], r["status"]) for r in
           H.read_history(spark, path, "replied_tweets").collect()}
    assert got == {"t1": (0, None), "t2": (0, None)}


def test_lexicon_list_and_table_agree(spark):
    df = spark.createDataFrame([(1, "a giveaway here"), (2, "nothing"), (3, None)], "id long, t string")
    lex = [f"w{i}" for i in range(2000)] + ["giveaway"]
    table = spark.createDataFrame([(w,) for w in lex], "term string")
    for lexicon in (lex, table):
        got = {r["id"]: r["flagged"] for r in gates.lexicon_flag(df, "t", lexicon, id_col="id").collect()}
        assert got == {1: True, 2: False, 3: False}


def test_short_and_empty_mentions(spark):
    # branches that whole conversation texts do not reach
    df = spark.createDataFrame([(1, "@user_9 http://x.y"), (2, "@user_9 hello")], "id long, full_text string")
    got = {r["id"]: r["status"] for r in gates.mention_text_status(df).collect()}
    assert got == {1: "no text", 2: "ok"}


def test_topic_fallback_both_branches(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "b")], "id long, topic string")
    assert [r["id"] for r in responses.topic_fallback(df, "topic", "b", "s").collect()] == [3]
    assert responses.topic_fallback(df, "topic", "zzz", "s").first()["topic"] in ("a", "b")   # never the empty one


def test_near_dup_vs_latest_takes_n(spark):
    hist = spark.createDataFrame([(1, "a b c", 1), (2, "x y z", 2)], "hid long, body string, d int")
    cand = spark.createDataFrame([(7, "a b c"), (8, "x y z")], "id long, body string")
    out = SIM.near_dup_vs_latest(cand, "id", "body", hist, "hid", "body", 0.45, 1, [F.col("d").desc()])
    assert [r["id"] for r in out.collect()] == [7]   # only the latest one counts


def test_history_backup_due(spark):
    from tidepool.session import shared_dir
    df, root = spark.createDataFrame([(1,)], "a int"), shared_dir(spark, "test_backup")
    assert H.history_backup(df, root, "2024-01-02 08:01:00") and not H.history_backup(df, root, "2024-01-02 09:01:00")
    assert [r["snapshot_ts"] for r in spark.read.parquet(root).collect()] == ["2024_01_02_08_01"]


def test_sync_all_creates_missing_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    synced = H.sync_all({"t": a, "u": a}, {"t": a.where("k = 1")})
    assert sorted(r["k"] for r in synced["t"][1].collect()) == [1, 2]
    assert synced["u"][1].count() == 2 and synced["u"][0].count() == 2


def test_no_silent_local_folder():
    from tidepool.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_news_feeds_and_union(spark):
    from tidepool.operators import news as N
    arts = spark.createDataFrame(
        [("u1", "Big news - Site", "desc one", "2024-01-01"), ("u2", "Other - X", None, "2024-01-02")],
        "url string, title string, description string, publishedAt string")
    a = N.normalize_article_feed(arts, "Finance").collect()
    assert len(a) == 1 and a[0]["body"] == "Big news. desc one" and a[0]["feed"] == "news_articles"
    snip = spark.createDataFrame([("s", "l", "3 hours ago")], "snippet string, link string, date string")
    u = N.news_union(N.normalize_article_feed(arts, "Finance"), N.normalize_snippet_feed(snip, "Finance"))
    assert u.count() == 2 and u.columns == list(N.NEWS_COLUMNS)


def test_choose_feed(spark):
    from tidepool.operators import news as N
    snips = spark.createDataFrame([("a", "u1", "2 hours ago"), ("b", "u2", "3 days ago")], "snippet string, link string, date string")
    search = N.normalize_search_feed(spark.createDataFrame([("s", "u3")], "body string, url string"), "Money")
    snippet = N.normalize_snippet_feed(snips, "Money")
    assert [r["url"] for r in N.choose_feed(search, snippet, "Money", "x").collect()] == ["u1"]
    assert [r["url"] for r in N.choose_feed(search, snippet, "Other", "x").collect()] == ["u1"]   # falls back to a term with news
    assert [r["url"] for r in N.choose_feed(search, snippet, "Money", "x", use_snippets=False).collect()] == ["u3"]


def test_topic_category_and_seeded_pick(spark):
    df = spark.createDataFrame([(1, "Finance"), (2, "Money"), (3, "Discoveries")], "id long, term string")
    cats = {r["id"]: r["category"] for r in gates.topic_category(df, "term", "id", "s").collect()}
    assert cats[1] == "business" and cats[2] == "business" and cats[3] in ("general", "technology")
    again = {r["id"]: r["category"] for r in gates.topic_category(df, "term", "id", "s").collect()}
    assert again == cats   # repeatable
    rows = spark.createDataFrame([("g", i) for i in range(50)], "g string, i long")
    p1 = responses.seeded_pick(rows, "g", "i", "seed").first()["i"]
    assert p1 == responses.seeded_pick(rows, "g", "i", "seed").first()["i"]


def test_first_accepted_attempt(spark):
    df = spark.createDataFrame([(1, 1, "As an AI I cannot"), (1, 2, "fine answer"), (2, 1, "x" * 400),
                                (2, 2, "y" * 400), (2, 3, "z" * 400), (2, 4, "ok")],
                               "p long, a long, r string")
    out = {r["p"]: r for r in responses.first_accepted_attempt(
        df, "p", "a", "r", ["as an ai"], [], [], [], 280, 3).collect()}
    assert out[1]["accepted_attempt"] == 2 and out[1]["final_response"] == "fine answer"
    assert out[2]["status"] == "not_passed" and out[2]["accepted_attempt"] is None   # 4th try not allowed


def test_python_digit_and_whitespace_rules(spark):
    # str.isdigit() accepts superscripts; str.split() breaks on \x1c-\x1f
    assert one(spark, X.remove_symbols, "a² b¹c ok") == "ok"
    assert one(spark, lambda c: F.array_join(X.words(c), "|"), "a\x1cb　c") == "a|b|c"
    assert one(spark, X.clean_links, "x http://a.b\x1fy") == "x \x1fy"
