"""Properties and plain-Python restatements of the
reference semantics, compared on every row of the small fixture."""

import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.functions import text as X
from tidepool.operators import dedup, replies
from tidepool.operators import similarity as SIM
from tidepool.session import shared_dir
from tidepool.sources.tables import Tables



def py_ratio(text):
    t = re.sub(r"http\S+", "", " ".join(text.split()))
    t = re.sub(r"\s+", " ", re.sub(r"@\S+", "", t))
    kept = [w for w in t.split() if len(w) > 1 and "$" not in w and not w[1].isdigit()]
    n_tags = len(re.findall(r"#([a-zA-Z0-9_]{1,50})", " ".join(kept)))
    plain = [w for w in kept if "#" not in w]
    if len(" ".join(plain)) < 20:
        return None
    return len(plain) / max(n_tags, 1) / 10


def py_cos(a, b):
    va, vb = Counter(re.findall(r"\w+", a)), Counter(re.findall(r"\w+", b))
    num = sum(va[k] * vb[k] for k in set(va) & set(vb))
    den = math.sqrt(sum(v * v for v in va.values())) * math.sqrt(sum(v * v for v in vb.values()))
    return 0.0 if not den else num / den


def odd_posts(n=400):
    """Texts of awkward words in awkward white space."""
    rng = random.Random(11)
    parts = ["http", "http:", "xhttp://y", "https://a.b/c#d@e", "@", "@bob", "a@b", "#", "#tag", "x#y#z", "$A", "a$", "1", "a1", "a²b",
             "a٣", "x", "", "été", "日本語", "a①b", "word", "another", "#été", "##t", "http\u3000z", "longer words here"]
    spaces = [" ", "  ", "\n", "\t ", "\x1c", "\u3000", "\xa0", "\u2028", "\x85"]
    return [("".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randint(0, 14))),) for _ in range(n)] + [("",)]


def py_clean(text):
    text = re.sub(r"http\S+", "", text)
    kept = [w for w in text.split() if len(w) > 1 and "$" not in w and not w[1].isdigit()]
    text = " ".join(w for w in " ".join(kept).split() if "#" not in w)
    return re.sub(r"\s+", " ", re.sub(r"@\S+", "", text))


def test_clean_post_matches_python(spark):
    posts = Tables(spark, SF_SMALL).posts.select("full_text").unionByName(spark.createDataFrame(odd_posts(), "full_text string"))
    for row in posts.select("full_text", X.clean_post("full_text").alias("clean")).collect():
        assert row["clean"] == py_clean(row["full_text"]), row["full_text"]


def test_hashtag_ratio_matches_python(spark):
    posts = Tables(spark, SF_SMALL).posts.select("full_text").unionByName(spark.createDataFrame(odd_posts(), "full_text string"))
    for row in X.with_hashtag_ratio(posts, "full_text", "r").collect():
        want = py_ratio(row["full_text"])
        assert (want is None and row["r"] is None) or abs(want - row["r"]) < 1e-12


def test_cosine_matches_python(spark):
    t = Tables(spark, SF_SMALL)
    got = SIM.cosine_pairs(t.replies, "reply_id", "in_reply_to_id", t.replies, t.mentions,
                           "reply_id", "reply_text", "mention_id", "full_text").collect()
    rtext = {r["reply_id"]: r["reply_text"] for r in t.replies.collect()}
    mtext = {r["mention_id"]: r["full_text"] for r in t.mentions.collect()}
    for r in got:
        want = py_cos(rtext[r["reply_id"]], mtext.get(r["in_reply_to_id"], ""))
        assert abs(want - r["cosine"]) < 1e-12


def test_near_dup_pairs_brute_force(spark):
    docs = Tables(spark, SF_SMALL).documents
    rows = docs.select("doc_id", "text").collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], []).append(r["doc_id"])
    reps = {min(ids): (t, len(ids)) for t, ids in by_text.items()}
    vecs = {k: Counter(re.findall(r"\w+", t)) for k, (t, _) in reps.items()}
    ids = sorted(vecs)
    want = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if py_cos(reps[a][0], reps[b][0]) >= 0.8:
                want.add((a, b))
    got = {(r["a_id"], r["b_id"]) for r in SIM.near_dup_pairs(docs, "doc_id", "text", 0.8).collect()}
    assert got == want and len(want) > 0


def test_trim_leading_punct_matches_python(spark):
    m = Tables(spark, SF_SMALL).mentions.select("full_text", X.trim_leading_punct("full_text").alias("x"))
    for r in m.collect():
        assert r["x"] == r["full_text"].lstrip(string.punctuation)


# ---- properties ---------------------------------------------------------------------

def test_anti_union_semi_is_input(spark):
    t = Tables(spark, SF_SMALL)
    c = dedup.with_hash(t.posts, "full_text", "full_text_hash")
    anti = dedup.anti_seen_hash(c, t.replied_tweets).select("post_id")
    semi = dedup.semi_exists(c, "full_text_hash", t.replied_tweets, "input_tweet_hash").select("post_id")
    assert anti.count() + semi.count() == c.count()
    assert anti.intersect(semi).count() == 0


def test_keep_one_reply_one_keep_per_mention(spark):
    out = replies.keep_one_reply(Tables(spark, SF_SMALL).replies)
    keeps = out.where("action = 'keep'").groupBy("in_reply_to_id").count()
    assert keeps.where("count <> 1").count() == 0


def test_first_per_key_hot_key(spark):
    # one key holding a third of the rows reduces to one row, the first by order
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id"))
    out = dedup.first_per_key(df, "k", "id")
    assert out.count() == 2001
    assert out.where("k = 'hot'").first()["id"] == 0


def test_first_per_key_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), (None, 1, 2), (None, 2, 3), ("b", None, 4), ("b", 5, 5)],
                               "k string, o int, v int")
    got = {r["v"] for r in dedup.first_per_key(df, "k", "o").collect()}
    assert got == {1, 2, 3, 5}     # a's only row, every row without a key, b's row with an order
    assert {r["v"] for r in dedup.first_per_key(df, "k", "o", ascending=False).collect()} == got


def test_rank_within_group_large_hot_group(spark):
    # 240,000 rows with a text column, one group a third of them: equals row_number
    from pyspark.sql import Window
    path = shared_dir(spark, "test_rank")
    spark.range(0, 240000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 700).alias("g"),
        (F.col("id") * 7919 % 240007).alias("o"), F.repeat(F.lit("text "), 20).alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    got = dedup.rank_within_group(df, "g", "o", "r", width=1000)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    assert got.count() == 240000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rank_within_group_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (1, 5000), (1, 1)], "g int, o int")
    got = {(r["g"], r["o"]): r["r"] for r in dedup.rank_within_group(df, "g", "o", "r").collect()}
    assert got == {(None, None): 1, (None, 1): 2, (1, 1): 1, (1, 5000): 2}


def test_views_keep_whole_texts(spark):
    t = Tables(spark, SF_SMALL)

    def chars(df, c):
        return df.agg(F.sum(F.length(c))).first()[0]

    assert chars(t.posts, "full_text") > chars(t.documents, "text")
    users = t.conversations.where("role = 'user'")
    assert chars(t.mentions, "full_text") >= chars(users, "text") + 8 * users.count()
    answers = t.conversations.where("role = 'assistant'")
    assert chars(t.responses, "response") >= chars(answers, "text")
    lost = t.posts.join(t.documents.select("doc_id", "text"), F.col("post_id") == F.col("doc_id")).where(
        ~F.col("full_text").startswith(F.col("text")))
    assert lost.count() == 0
    # news: every paragraph of every page
    pages = {r["page_id"]: r["html"] for r in t.pages.collect()}
    for r in t.news.collect():
        found = re.findall(r"(?s)<p>(.*?)</p>", pages[r["news_id"]])
        assert r["description"] == re.sub(r"<[^>]+>", "", " ".join(found))


def test_term_counts_match_python(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "été x été x x")], "id long, t string")
    got = {(r["id"], r["token"]): r["tf"] for r in SIM.term_frequencies(docs, "id", "t").collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (4, "été"): 2, (4, "x"): 3}


def test_near_dup_members_name_every_copy(spark):
    texts = ["a b c", "a b c", "lone copies", "a b c d", "lone copies", None, "single", None, "lone copies"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = {r["doc_id"]: r["rep"] for r in SIM.near_dup_members(docs, "doc_id", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: None, 6: 6, 7: None, 8: 2}
    sizes = Counter(got.values())
    for p in SIM.near_dup_pairs(docs, "doc_id", "text", 0.6).collect():
        assert (sizes[p["a_id"]], sizes[p["b_id"]]) == (p["a_copies"], p["b_copies"])


def test_near_dup_pairs_hot_token_blocks(spark):
    # a token in all texts, cut into many blocks: the same pairs as without cutting
    docs = Tables(spark, SF_SMALL).documents.select("doc_id", F.concat(F.lit("the "), "text").alias("text"))
    few = SIM.near_dup_pairs(docs, "doc_id", "text", 0.8)
    many = SIM.near_dup_pairs(docs, "doc_id", "text", 0.8, hot_df=8)
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
