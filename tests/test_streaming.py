"""Streaming = batch, restart adds nothing, replayed batches do not duplicate."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.sources.tables import Tables
from tidepool.streaming import jobs as J


def thirds(df, key):
    return [df.where(F.col(key) % 3 == i) for i in range(3)]


def test_dedup_stream_cross_batch_and_restart(spark):
    t = Tables(spark, SF_SMALL)
    run = J.new_run(spark, "test_dedup")
    ev = t.events.select("event_id", "event_type")
    again = ev.where(F.col("event_id") < 25)   # late re-sends
    J.run_rounds(spark, [*thirds(ev, "event_id"), again], run,
                 batch_fn=J.dedup_batch_fn(spark, run["sink"], "event_id"))
    first = spark.read.parquet(run["sink"])
    assert first.count() == ev.count() == first.select("event_id").distinct().count()
    # restart from the checkpoint with nothing new: no new rows
    s2 = J.read_arrivals(spark, run["input"], ev.schema)
    J.run_available(s2, run["checkpoint"], J.dedup_batch_fn(spark, run["sink"], "event_id"))
    assert spark.read.parquet(run["sink"]).count() == ev.count()


def test_state_store_dedup_and_restart(spark):
    t = Tables(spark, SF_SMALL)
    run = J.new_run(spark, "test_state_dedup")
    ev = t.events.select("event_id", "event_type")

    def job(s):
        return J.dedup_stream(s, "event_id")

    J.run_rounds(spark, thirds(ev, "event_id"), run, job)
    assert spark.read.parquet(run["sink"]).count() == ev.count()
    # a late re-send of old keys after a restart is still dropped
    J.run_rounds(spark, [ev.where(F.col("event_id") < 30)], run, job)
    out = spark.read.parquet(run["sink"])
    assert out.count() == ev.count() == out.select("event_id").distinct().count()


def test_mentions_sent_again_are_dropped(spark):
    t = Tables(spark, SF_SMALL)
    run = J.new_run(spark, "test_mentions")
    J.run_rounds(spark, [t.mentions, t.mentions], run, lambda s: J.mentions_stream(s, t.mentions_history))
    out = spark.read.parquet(run["sink"])
    assert out.count() == out.select("in_reply_to_status_id").distinct().count() > 0


def test_a_broken_sink_is_an_error(spark):
    run = J.new_run(spark, "test_sink")
    assert J.sink_before(spark, run["sink"], 1) is None          # nothing written yet
    spark.range(3).write.parquet(run["sink"])                    # no batch_id column
    with pytest.raises(AnalysisException):
        J.sink_before(spark, run["sink"], 1).count()


def test_news_latest_is_by_posting_time(spark):
    # ten older posts with higher ids; round 0 posts news 1, round 1 offers a near copy of it
    words = "one two three four five six seven eight nine ten"
    history = spark.createDataFrame([(100 + i, f"h{i} x{i} y{i} z{i}", f"d{i}", f"u{i}") for i in range(10)],
                                    "news_id long, body string, description_hash string, input_text_url string") \
        .withColumn("date", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    run = J.new_run(spark, "test_news")
    fn = J.news_batch_fn(spark, history, run["sink"], 10, 0.45, "s", ["blocked"], 24, "2024-02-01 00:00:00")
    columns = "news_id long, body string, description string, url string, age_text string"
    fn(spark.createDataFrame([(1, words, "a", "a", "1 hours ago"), (3, "blocked", "c", "c", "1 hours ago"),
                              (4, "old", "d", "d", "3 days ago")], columns), 0)
    fn(spark.createDataFrame([(2, words + " more", "b", "b", "1 hours ago")], columns), 1)
    assert [r["news_id"] for r in spark.read.parquet(run["sink"]).collect()] == [1]


def test_processing_time_trigger(spark):
    t = Tables(spark, SF_SMALL)
    run = J.new_run(spark, "test_trigger")
    t.mentions.write.parquet(run["input"])
    q = J.start(J.stream_length_gate(J.read_arrivals(spark, run["input"], t.mentions.schema), "full_text")
                .select("mention_id", "route"), run["checkpoint"], sink=run["sink"],
                trigger={"processingTime": "1 second"})
    q.processAllAvailable()
    assert q.isActive
    q.stop()
    assert spark.read.parquet(run["sink"]).count() == t.mentions.count()


def test_replayed_batch_overwrites_itself(spark):
    run = J.new_run(spark, "test_replay")
    fn = J.dedup_batch_fn(spark, run["sink"], "k")
    b0 = spark.createDataFrame([(1,), (2,)], "k long")
    b1 = spark.createDataFrame([(2,), (3,)], "k long")
    fn(b0, 0)
    fn(b1, 1)
    fn(b1, 1)   # the same micro-batch again, as after a failure
    got = sorted(r["k"] for r in spark.read.parquet(run["sink"]).collect())
    assert got == [1, 2, 3]


def test_length_gate_stream_equals_batch(spark):
    t = Tables(spark, SF_SMALL)
    run = J.new_run(spark, "test_gate")
    short = spark.createDataFrame([(-3, 1, "u", "tiny")], t.mentions.schema)
    rows = t.mentions.unionByName(short)
    J.run_rounds(spark, thirds(rows, "mention_id"), run,
                 lambda s: J.stream_length_gate(s, "full_text").select("mention_id", "route"), partition_by="route")
    streamed = spark.read.parquet(run["sink"]).select("mention_id", "route")
    batch = J.stream_length_gate(rows, "full_text").select("mention_id", "route")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert streamed.where("route = 'short'").count() > 0


@pytest.mark.parametrize("empty_at", [0, 1, 2])
def test_a_round_without_rows_changes_nothing(spark, empty_at):
    run = J.new_run(spark, "test_empty")
    fn = J.dedup_batch_fn(spark, run["sink"], "k")
    rounds = [[(1,), (2,)], [(2,), (3,), (None,)]]
    rounds.insert(empty_at, [])
    for n, rows in enumerate(rounds):
        fn(spark.createDataFrame(rows, "k long"), n)
        fn(spark.createDataFrame(rows, "k long"), n)   # replayed
    got = [r["k"] for r in spark.read.parquet(run["sink"]).collect()]
    assert sorted(got, key=lambda k: (k is None, k)) == [1, 2, 3, None]


def test_empty_rounds_of_triage_news_and_mentions(spark):
    t = Tables(spark, SF_SMALL)
    for rows, fn_of in ((t.posts, lambda s: J.triage_batch_fn(spark, t.replied_tweets, s)),
                        (t.mentions, lambda s: J.mentions_batch_fn(spark, t.mentions_history, s)),
                        (t.news, lambda s: J.news_batch_fn(spark, t.timeline_posts, s, 10, 0.45, "s", ["blocked"],
                                                           24 * 400, "2024-02-01 00:00:00"))):
        run = J.new_run(spark, "test_empty_jobs")
        fn = fn_of(run["sink"])
        for n, batch in enumerate([rows.limit(0), rows, rows.limit(0), rows]):
            fn(batch, n)
        out = spark.read.parquet(run["sink"])
        assert out.where("batch_id = 1").count() > 0 and out.where("batch_id in (0, 2)").count() == 0


def test_history_rows_added_between_triggers_are_seen(spark):
    t = Tables(spark, SF_SMALL)
    run = J.new_run(spark, "test_history")
    path = run["late"]
    posts = t.posts.limit(0)
    spark.createDataFrame([("none",)], "input_tweet_hash string").write.parquet(path)
    good = t.posts.where("lang = 'en'").orderBy("post_id")
    seen = J.triage_batch_fn(spark, lambda: spark.read.parquet(path), run["sink"])
    J.triage_batch_fn(spark, spark.read.parquet(path), run["checkpoint"])(good, 0)   # what passes without history
    passed = spark.read.parquet(run["checkpoint"]).orderBy("post_id").collect()
    assert len(passed) > 1
    seen(posts, 0)
    spark.createDataFrame([(passed[0]["full_text_hash"],)], "input_tweet_hash string").write.mode("append").parquet(path)
    seen(good, 1)
    out = {r["full_text_hash"] for r in spark.read.parquet(run["sink"]).collect()}
    assert out == {r["full_text_hash"] for r in passed[1:]}


def test_only_the_buckets_of_its_keys_are_read(spark):
    run = J.new_run(spark, "test_buckets")
    J.dedup_batch_fn(spark, run["sink"], "k")(spark.range(1000).withColumnRenamed("id", "k"), 0)
    some = spark.createDataFrame([(5,), (2000,)], "k long")
    new = J.not_written(spark, some, run["sink"], 1, "k")
    assert [r["k"] for r in new.collect()] == [2000]
    scan = next(x for x in new._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    filters = scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    for r in some.select(J.bucket_of("k")).distinct().collect():   # no folder but these two is opened
        assert str(r[0]) in filters
    assert "bucket" in filters and "batch_id" in filters


def test_bounded_dedup_is_exact_and_forgets_old_keys(spark):
    run = J.new_run(spark, "test_bounded")

    def events(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "k long")
        return rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") * 3600))

    rounds = [list(range(0, 200)) + [3, 150], list(range(200, 400)) + [399, 380, 5, 199], [], list(range(400, 600)) + [7, 7, 250, 599],
              [-40, -40, 12, 601], [-40, -41, 601, 601]]
    held = J.run_bounded_dedup(spark, map(events, rounds), run, "k", "ts", "24 hours")
    out = sorted(r["k"] for r in J.read_deduped(spark, run, ["k"]).collect())
    assert out == sorted({k for ids in rounds for k in ids})
    assert max(held) < 400 and held[-1] <= 60      # keys of about two days, not of all time
