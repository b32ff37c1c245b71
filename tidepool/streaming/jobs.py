"""Structured Streaming versions of the reference's polling loops
(SURVEY R1-R5).

* Input is a folder of arriving parquet files, read by ``readStream`` with a
  declared schema.  A scheduled round (:func:`run_rounds`) processes what has
  arrived, then stops (``availableNow``); a long-running job passes
  ``{"processingTime": "1 hour"}`` to :func:`start` instead.
* R1 (length gate) and R3 (mentions) are declarative and write to the
  exactly-once file sink.  R3's ``dropDuplicates`` keeps every id in the state
  store (partitioned by key hash, saved with the checkpoint).
* R2, R4 and R5 use ``foreachBatch``: their state is what they have written.
  They write partition ``batch_id=N`` with dynamic partition overwrite, so a
  micro-batch replayed after a failure replaces its own output; their check
  against what is written reads only partitions ``batch_id < N``.  Executors
  keep no state that grows.
* Sinks that are asked for keys are cut into ``bucket=`` folders by the key's
  hash: a trigger reads the key column of the buckets its own keys fall into,
  and of no other.
* A history is a DataFrame or a function that returns one; a function is called
  in every micro-batch, so a long-running job sees rows added meanwhile.
* R5 also comes with bounded state (:func:`run_bounded_dedup`): keys younger
  than the watermark live in the state store, older ones in the written days.
* Checkpoints and sinks live under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidepool.functions import text as X
from tidepool.operators import dedup, gates, similarity
from tidepool.operators.responses import seeded_pick
from tidepool.session import shared_dir

#: Folders of a keyed sink per micro-batch.
SINK_BUCKETS = 32
#: A table, or a function that reads it as it is now.
History = DataFrame | Callable[[], DataFrame]


# ---- arriving files ---------------------------------------------------------

def read_arrivals(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of a folder's files; all that has arrived, or a bounded number
    of files per micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written_parts(spark: SparkSession, sink: str) -> list[str]:
    """Names directly under a sink, but for Spark's own; none before its first row:
    rounds without rows write a folder that holds nothing else."""
    if not path_exists(spark, sink):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(sink)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return [n for n in names if n[0] not in "_."]


def sink_before(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    """Rows the job wrote in earlier micro-batches (None before the first row)."""
    if not written_parts(spark, sink):
        return None
    return spark.read.parquet(sink).where(F.col("batch_id") < batch_id)


def bucket_of(key: str) -> Column:
    """The sink folder of a key, one of SINK_BUCKETS."""
    return F.pmod(F.xxhash64(key), F.lit(SINK_BUCKETS)).cast("int")


def write_batch(df: DataFrame, sink: str, batch_id: int, key: str | None = None) -> None:
    """This micro-batch's partition; with ``key`` cut into buckets, one file each."""
    parts = ["batch_id"]
    if key:
        parts, df = ["batch_id", "bucket"], df.withColumn("bucket", bucket_of(key)).repartition("bucket")
    (df.withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(sink))


def not_written(spark: SparkSession, rows: DataFrame, sink: str, batch_id: int, key: str) -> DataFrame:
    """Rows whose key no earlier micro-batch wrote.  Only the buckets that the rows' keys
    fall into are read (at most SINK_BUCKETS numbers name them).  Null keys stay."""
    before = sink_before(spark, sink, batch_id)
    if before is None:
        return rows
    touched = [r[0] for r in rows.select(bucket_of(key)).distinct().collect()]
    seen = before.where(F.col("bucket").isin(touched)).select(F.col(key).alias("__k"))
    return rows.join(seen, rows[key] == seen["__k"], "left_anti")


def current(history: History) -> DataFrame:
    return history() if callable(history) else history


def write_unseen(spark: SparkSession, rows: DataFrame, sink: str, batch_id: int, key: str) -> None:
    """Append the rows whose key is not in the sink yet."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # asked for its buckets, then joined
    try:
        write_batch(not_written(spark, rows, sink, batch_id, key), sink, batch_id, key)
    finally:
        rows.unpersist()


def start(stream: DataFrame, checkpoint: str,
          batch_fn: Callable[[DataFrame, int], None] | None = None,
          sink: str | None = None, partition_by: str | None = None,
          trigger: dict | None = None) -> StreamingQuery:
    """Start the job: ``availableNow`` by default, or any other trigger."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if batch_fn is not None:
        return w.foreachBatch(batch_fn).start()
    if partition_by:
        w = w.partitionBy(partition_by)
    return w.format("parquet").outputMode("append").start(sink)


def run_available(stream: DataFrame, checkpoint: str, batch_fn=None, sink: str | None = None,
                  partition_by: str | None = None) -> None:
    """Process everything that has arrived, then stop."""
    start(stream, checkpoint, batch_fn, sink, partition_by).awaitTermination()


def run_rounds(spark: SparkSession, arrivals: Iterable[DataFrame], run: dict[str, str],
               job: Callable[[DataFrame], DataFrame] = lambda s: s, batch_fn=None,
               partition_by: str | None = None) -> None:
    """Scheduled rounds: each arrival is written by as many tasks as it has
    partitions, then the job runs from its checkpoint over what is new (one
    micro-batch), as a process started by a timer would."""
    for df in arrivals:
        df.write.mode("append").parquet(run["input"])
        stream = job(read_arrivals(spark, run["input"], df.schema))
        run_available(stream, run["checkpoint"], batch_fn, None if batch_fn else run["sink"], partition_by)


# ---- R1: length gate on a stream ----------------------------------------------

def stream_length_gate(stream: DataFrame, text_col: str, min_len: int = 10) -> DataFrame:
    """Route each arriving row: ``long`` when its link-free text is longer
    than ``min_len``, else ``short`` (both kept, in one partitioned sink)."""
    n = F.length(X.clean_links(text_col))
    return stream.withColumn("route", F.when(n > min_len, F.lit("long")).otherwise(F.lit("short")))


# ---- R2: triage loop -------------------------------------------------------------

def triage_batch_fn(spark: SparkSession, history: History, sink: str, blocklist_phrases=()):
    """Per micro-batch: gates, first row per text hash, drop texts seen in the
    history as it is now or in earlier batches, append."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        c = gates.post_gate(gates.post_metrics(batch))
        c = gates.post_blocklist(c, phrases=blocklist_phrases)
        c = gates.hashtag_ratio_gate(c)
        c = dedup.with_hash(c, "full_text", "full_text_hash").select(
            "post_id", "author_id", "full_text_hash")
        c = dedup.first_per_key(c, "full_text_hash", "post_id", ascending=True)
        c = dedup.anti_seen_hash(c, current(history), "full_text_hash", "input_tweet_hash")
        write_unseen(spark, c, sink, batch_id, "full_text_hash")
    return fn


# ---- R3: mentions loop -----------------------------------------------------------

def _mention_records(fresh: DataFrame) -> DataFrame:
    return gates.mention_text_status(fresh).select(
        F.col("mention_id").alias("in_reply_to_status_id"),
        X.sha256_hex("full_text").alias("in_reply_to_text_hash"), "status")


def mentions_stream(stream: DataFrame, history: DataFrame) -> DataFrame:
    """Arriving mentions: drop re-sent ids (state store), drop mentions the
    static history already answered (stream-static anti-join), give each a
    text status.  Declarative end to end; the file sink is exactly-once.

    The state grows with the ids and the history is the one of the job's start;
    :func:`mentions_batch_fn` has neither limit."""
    return _mention_records(dedup.anti_seen_mention(stream.dropDuplicates(["mention_id"]), history))


def mentions_batch_fn(spark: SparkSession, history: History, sink: str):
    """The same without a state store: per micro-batch one row per id (a null id is no
    duplicate of another), minus the history as it is now and what earlier batches wrote."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        c = dedup.anti_seen_mention(dedup.first_per_key(batch, "mention_id", "mention_id"), current(history))
        write_unseen(spark, _mention_records(c), sink, batch_id, "in_reply_to_status_id")
    return fn


# ---- R4: news loop ---------------------------------------------------------------

def news_batch_fn(spark: SparkSession, history: History, sink: str, latest_n: int,
                  max_cos: float, seed: str, block_words: Sequence[str], max_age_hours: int,
                  first_round: str, round_hours: int = 1):
    """Per micro-batch: word and age filters, near-dup vs the latest ``n`` posted
    bodies (by posting time), drop posted hashes/urls, pick one (seeded), record
    it as posted.  Batch N posts ``round_hours`` * N after ``first_round``."""
    columns = ["date", "news_id", "body", "description_hash", "input_text_url"]

    def fn(batch: DataFrame, batch_id: int) -> None:
        posted = current(history).select(columns)
        prev = sink_before(spark, sink, batch_id)
        if prev is not None:
            posted = posted.unionByName(prev.withColumnRenamed("url", "input_text_url").select(columns))
        c = gates.news_age_filter(gates.news_blocklist(batch, block_words), max_age_hours)
        c = dedup.with_hash(c, "description", "description_hash")
        c = similarity.near_dup_vs_latest(c, "news_id", "body", posted, "news_id", "body", max_cos, latest_n,
                                          [F.col("date").desc(), F.col("news_id").desc()])
        c = dedup.anti_seen_news(c, posted)
        pick = seeded_pick(c.select("news_id", "body", "description_hash", "url")
                           .withColumn("__g", F.lit(1)), "__g", "news_id", f"{seed}:{batch_id}")
        date = F.to_timestamp(F.lit(first_round)) + F.make_dt_interval(hours=F.lit(batch_id * round_hours))
        write_batch(pick.drop("__g").withColumn("date", date), sink, batch_id)
    return fn


# ---- R5: exact de-duplication of an event stream ------------------------------------

def dedup_stream(stream: DataFrame, key: str) -> DataFrame:
    """Exact streaming de-duplication on ``key``: ``dropDuplicates`` without a
    watermark keeps every key seen in the state store (partitioned by key
    hash, persisted with the checkpoint), so each trigger only probes its
    own keys and a re-send months later is still dropped.  The state grows
    with the number of keys; :func:`dedup_batch_fn` keeps none.  (A watermark
    would bound it but drop rows older than the watermark: not whole.)
    """
    return stream.dropDuplicates([key])


def dedup_batch_fn(spark: SparkSession, sink: str, key: str):
    """Without a state store: the sink is the state.

    Per micro-batch: first row per key, minus keys written by earlier
    batches (reads the key column of the buckets that its keys touch).
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        write_unseen(spark, dedup.first_per_key(batch, key, key), sink, batch_id, key)
    return fn


def recent_dedup_stream(stream: DataFrame, key: str, time_col: str, delay: str) -> DataFrame:
    """One row per key among rows not older than the watermark (``delay`` behind the
    newest event): a key leaves the state store once the watermark has passed it.
    Older rows are not handled here; :func:`late_dedup_batch_fn` takes them."""
    kept = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])
    return kept.withColumn("day", F.to_date(time_col))


def late_dedup_batch_fn(spark: SparkSession, recent: str, sink: str, key: str, time_col: str, before: str | None):
    """Per micro-batch of the same arrivals: of the rows older than ``before`` (all rows,
    if None), those whose key stands neither in the recent sink nor among earlier late
    rows.  Both are cut by day, and only the days of the rows at hand are read."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        late = batch if before is None else batch.where(F.col(time_col) < F.to_timestamp(F.lit(before)))
        late = dedup.first_per_key(late, key, time_col).withColumn("day", F.to_date(time_col))
        late = late.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            days = [r[0] for r in late.select("day").distinct().collect()]  # a value a calendar day
            new = late
            for path in (recent, sink):
                if written_parts(spark, path):
                    seen = spark.read.parquet(path).where(F.col("day").isin(days))
                    if path == sink:
                        seen = seen.where(F.col("batch_id") < batch_id)
                    seen = seen.select(F.col(key).alias("__k"))
                    new = new.join(seen, new[key] == seen["__k"], "left_anti")
            (new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "day").parquet(sink))
        finally:
            late.unpersist()
    return fn


def run_bounded_dedup(spark: SparkSession, arrivals: Iterable[DataFrame], run: dict[str, str], key: str,
                      time_col: str, delay: str) -> list[int]:
    """Scheduled rounds of exact de-duplication with bounded state, and the rows held in
    the state store after each round.

    Events carry their own time, so a row sent again is as old as it was: either the
    watermark has not passed it and the state store knows its key, or its key stands in
    that day's files.  A round first takes the recent rows to ``run["sink"]``, then the
    late ones to ``run["late"]`` (rows the first job passed over are older than the
    watermark it ended with).  Both have a checkpoint of their own; a round that died in
    between is made up for by the next.  :func:`read_deduped` reads both."""
    held = []
    for df in arrivals:
        df.write.mode("append").parquet(run["input"])
        stream = recent_dedup_stream(read_arrivals(spark, run["input"], df.schema), key, time_col, delay)
        recent = start(stream, run["checkpoint"], sink=run["sink"], partition_by="day")
        recent.awaitTermination()
        progress = [p for p in recent.recentProgress if p.get("eventTime")]
        before = progress[-1]["eventTime"].get("watermark") if progress else None
        held.append(progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else held[-1] if held else 0)
        run_available(read_arrivals(spark, run["input"], df.schema), run["late_checkpoint"],
                      late_dedup_batch_fn(spark, run["sink"], run["late"], key, time_col, before))
    return held


def read_deduped(spark: SparkSession, run: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """What run_bounded_dedup has written, recent and late rows."""
    parts = [spark.read.parquet(run[s]).select(*columns) for s in ("sink", "late") if written_parts(spark, run[s])]
    return reduce(DataFrame.unionAll, parts)


def new_run(spark: SparkSession, name: str) -> dict[str, str]:
    root = shared_dir(spark, name)
    return {name: f"{root}/{name}" for name in ("input", "sink", "checkpoint", "late", "late_checkpoint")}
