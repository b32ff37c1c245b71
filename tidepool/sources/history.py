"""History tables: typed schemas, by-name alignment, evolution, append,
snapshots, backups and two-way synchronisation (SURVEY S7-S12, U2, M9).

Storage is parquet under the cluster's shared folder.  Appends add files; a
job never overwrites the files it reads (snapshots go to new partitions).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: the four history tables and their fields ---------------
HISTORY_FIELDS = {
    "mentions": ["in_reply_to_status_id", "in_reply_to_text", "in_reply_to_text_hash",
                 "replay_tweet_id", "replay_text", "in_reply_to_user_name",
                 "in_reply_to_user_id", "status"],
    "replied_tweets": ["hashtag", "input_tweet", "input_tweet_hash", "input_tweet_id",
                       "output_tweet", "raw_model_response", "output_tweet_id",
                       "output_to_username", "status"],
    "ai_params": ["question", "prompt", "response", "personality", "nuance", "mood", "rules",
                  "model", "temperature", "ability", "filter"],
    "timeline_posts": ["search_term", "news_date", "body", "body_hash", "description_hash",
                       "input_text_url", "output_text", "post_tweet_id", "status"],
}


#: Copies of a row that one row of a task stands for while they are made.
COPY_PIECE = 1 << 16
#: Folders of a digested store, and parts of a folder with a digest of their own.
DIGEST_BUCKETS, DIGEST_PARTS = 64, 256
#: Tasks that write a bucket.
DIGEST_SALTS = 8
# Backups are due in the first minutes of every so many hours (UTC).
BACKUP_MINUTES, BACKUP_HOURS = 2, 8


def field_type(name: str) -> tuple[T.DataType, object]:
    """Type rule of the history tables: an ``id`` word -> bigint default 0,
    ``temperature`` -> double default 0.0, anything else string (NULL)."""
    if "id" in name.split("_"):
        return T.LongType(), 0
    if name == "temperature":
        return T.DoubleType(), 0.0
    return T.StringType(), None


def history_schema(table: str) -> T.StructType:
    fields = [T.StructField("date", T.TimestampType(), True)]
    for f in HISTORY_FIELDS[table]:
        fields.append(T.StructField(f, field_type(f)[0], True))
    return T.StructType(fields)


def _default(name: str, dtype: T.DataType) -> Column:
    _, d = field_type(name)
    return F.lit(d).cast(dtype)


def align_to_schema(df: DataFrame, schema: T.StructType, run_ts: str | None = None,
                    keep_extra: bool = False) -> DataFrame:
    """Select ``schema``'s columns by name: cast present ones, fill missing
    ones with their default, drop unknown ones (or keep them at the end).

    ``date`` is stamped with ``run_ts`` (a literal of the job run, never
    ``current_timestamp`` so a retried task writes the same value).
    """
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name == "date" and run_ts is not None:
            cols.append(F.to_timestamp(F.lit(run_ts)).cast(f.dataType).alias("date"))
        elif f.name in present:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(_default(f.name, f.dataType).alias(f.name))
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols)


def evolve_schema(existing: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Additive evolution: add each missing field with its rule type and
    default; never drop or retype an existing column."""
    have = set(existing.columns)
    out = existing
    if "date" not in have:
        out = out.withColumn("date", F.lit(None).cast("timestamp"))
    adds = {}
    for f in fields:
        if f not in have:
            dtype, d = field_type(f)
            adds[f] = F.lit(d).cast(dtype)
    return out.withColumns(adds) if adds else out


def append_history(df: DataFrame, path: str, table: str, run_ts: str, run_id: str) -> None:
    """Align to the table's schema and append this run's rows.

    Each run writes its own ``run=<yyyyMMddHHmmss>-<run_id>`` partition with
    dynamic partition overwrite: a job retried after a failure (same run_id)
    replaces its own partition instead of appending the same rows twice, and
    another run of the same second never touches it.
    """
    run = run_ts.replace("-", "").replace(":", "").replace(" ", "") + "-" + run_id
    (align_to_schema(df, history_schema(table), run_ts).withColumn("run", F.lit(run))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def read_history(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read with the declared schema (no footer is opened to infer one): a file
    written before a column existed reads back with the column's default."""
    schema = history_schema(table)
    stored = T.StructType([*schema.fields, T.StructField("run", T.StringType(), True)])
    df = spark.read.schema(stored).parquet(path)
    filled = {f.name: F.coalesce(F.col(f.name), _default(f.name, f.dataType))
              for f in schema.fields if f.name != "date" and field_type(f.name)[1] is not None}
    return df.withColumns(filled)


def latest_records(df: DataFrame, columns: Sequence[str], n: int,
                   order: Sequence[Column]) -> DataFrame:
    """``SELECT cols ... ORDER BY date DESC LIMIT n`` with a total order
    (ties broken by the caller's keys): a per-partition top-n + one merge."""
    return df.orderBy(*order).limit(n).select(*columns)


def write_by_day(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store a history in ``day=`` folders of its ``date`` (rows without one apart)."""
    df.withColumn("day", F.to_date("date")).write.mode(mode).partitionBy("day").parquet(path)


def days_of(spark: SparkSession, path: str) -> list[str | None]:
    """The days a history by day has, newest first, None (rows without a date) last; from
    the folder listing, one name per day."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    days = [n.removeprefix("day=") for n in names if n.startswith("day=")]
    dated = sorted((d for d in days if not d.startswith("__HIVE")), reverse=True)
    return [*dated, *[None] * (len(dated) < len(days))]


def latest_by_day(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], n: int,
                  order: Sequence[Column]) -> DataFrame:
    """:func:`latest_records` of a history by day, by an order that begins with ``date``
    descending: the newest days are taken, twice as many each time, until they hold ``n``
    rows (a count from the files' footers); older days are not opened."""
    days, take = days_of(spark, path), 1
    if not days:
        return spark.createDataFrame([], schema).select(*columns)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).parquet(path)
    while True:
        dated = [d for d in days[:take] if d is not None]
        known = F.col("day").isin([F.lit(d).cast("date") for d in dated]) if dated else F.lit(False)
        newest = stored.where(known if None not in days[:take] else known | F.col("day").isNull())
        if take >= len(days) or newest.count() >= n:
            return latest_records(newest, columns, n, order)
        take *= 2


def snapshot_write(df: DataFrame, path: str, tag: str | None = None) -> None:
    """Overwrite a snapshot, stamping every row with the searched tag."""
    if tag is not None:
        df = df.withColumn("hashtag", F.lit(tag))
    df.write.mode("overwrite").parquet(path)


def fresh_snapshot(spark: SparkSession, path: str, max_age_hours: float,
                   as_of_epoch: float) -> DataFrame:
    """Rows of snapshot files modified within ``max_age_hours`` of ``as_of``."""
    df = spark.read.parquet(path)
    cutoff = F.lit(as_of_epoch - max_age_hours * 3600.0)
    return (df.where(F.unix_micros(F.col("_metadata.file_modification_time")) / 1e6 >= cutoff))


def file_times(spark: SparkSession, path: str) -> list[float]:
    """Modification times (epoch seconds) of the data files under a path, from the file
    system's listing; none if the path is missing or holds no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    times, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        if f.getPath().getName()[0] not in "_.":
            times.append(f.getModificationTime() / 1000)
    return times


def set_file_times(spark: SparkSession, path: str, epoch: float) -> None:
    """Give every file under a path this modification time (a part restored from a
    backup keeps the age it had)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    while files.hasNext():
        fs.setTimes(files.next().getPath(), int(epoch * 1000), -1)


def newest_file_time(spark: SparkSession, path: str) -> float:
    """Modification time (epoch seconds) of the newest file under a path, 0 without any."""
    return max(file_times(spark, path), default=0.0)


def snapshot_or_recompute(spark: SparkSession, path: str, max_age_hours: float, as_of_epoch: float,
                          compute: Callable[[], DataFrame], tag: str | None = None) -> DataFrame:
    """The snapshot if its newest file is young enough; otherwise, or if there is none
    yet, it is computed anew, written over the old one, and read back.

    A young snapshot without rows is a snapshot: nothing was found then.  A folder without
    any file (a write that failed) is none."""
    times = file_times(spark, path)
    if not times or max(times) < as_of_epoch - max_age_hours * 3600.0:
        snapshot_write(compute(), path, tag)
    return spark.read.parquet(path)


def history_backup(df: DataFrame, backup_root: str, as_of: str) -> bool:
    """Write a full copy under ``snapshot_ts=yyyy_MM_dd_HH_mm`` when due: in the first
    minutes of every BACKUP_HOURS-th UTC hour."""
    at = datetime.strptime(as_of, "%Y-%m-%d %H:%M:%S")
    if not (at.minute <= BACKUP_MINUTES and at.hour % BACKUP_HOURS == 0):
        return False
    (df.withColumn("snapshot_ts", F.lit(at.strftime("%Y_%m_%d_%H_%M")))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_ts").parquet(backup_root))
    return True


def sync_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every distinct row of the two tables (columns pair by position, NULL equals
    NULL) with its number of copies in each: ``__a`` and ``__b``.

    Both tables are read once and counted map-side; a row repeated in a third of a
    table is one row after that.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = a.withColumns({"__a": one, "__b": none}).union(
        b.toDF(*a.columns).withColumns({"__a": none, "__b": one}))
    return both.groupBy(*a.columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))


def repeated(rows: DataFrame, n_col: str) -> DataFrame:
    """Each row ``n_col`` times, without that column.  Copies are made a piece of at most
    COPY_PIECE at a time; the pieces of a much repeated row are dealt to many tasks."""
    n, piece = F.col(n_col), F.lit(COPY_PIECE)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pieces are small rows: not to be put together
    few = rows.where(n <= piece)
    many = (rows.where(n > piece)
            .withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / piece))))
            .withColumn(n_col, F.least(piece, n - F.col("__piece") * piece)).repartition(tasks, "__piece").drop("__piece"))
    turns = F.explode(F.sequence(F.lit(1).cast("bigint"), n))
    return few.unionByName(many).withColumn("__i", turns).drop(n_col, "__i")


def missing_rows(counts: DataFrame, own: str, other: str, columns: Sequence[str]) -> DataFrame:
    """Rows that a side lacks, with all the other side's copies."""
    return repeated(counts.where((F.col(own) == 0) & (F.col(other) > 0)).select(*columns, F.col(other).alias("__n")), "__n")


def sync_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables after a two-way sync with a column ``side``: a side's own rows as they
    are, and those it lacked."""
    counts = sync_counts(a, b)
    parts = [own.toDF(*a.columns).unionByName(missing_rows(counts, x, y, a.columns)).withColumn("side", F.lit(side))
             for side, own, x, y in (("a", a, "__a", "__b"), ("b", b, "__b", "__a"))]
    return parts[0].unionByName(parts[1])


def sync_tables(a: DataFrame, b: DataFrame, two_way: bool = True) -> tuple[DataFrame, DataFrame]:
    """New contents of (a, b) after synchronising: b gains a's missing rows,
    and with ``two_way`` a gains b's (both judged against the old tables)."""
    counts = sync_counts(a, b)
    new_b = b.toDF(*a.columns).unionByName(missing_rows(counts, "__b", "__a", a.columns)).toDF(*b.columns)
    return (a.unionByName(missing_rows(counts, "__a", "__b", a.columns)) if two_way else a), new_b


def sync_all(a: dict[str, DataFrame], b: dict[str, DataFrame], two_way: bool = True) \
        -> dict[str, tuple[DataFrame, DataFrame]]:
    """:func:`sync_tables` for every table of ``a``; a table that ``b`` lacks
    starts empty there (as a copy of ``a``'s columns)."""
    return {name: sync_tables(df, b.get(name, df.limit(0)), two_way) for name, df in a.items()}


# ---- large stores: digests first, then only what differs -----------------------

def row_hash(columns: Sequence[str]) -> Column:
    """A row's place in a digested store.  Equal rows hash alike, also with NULLs: each
    column goes in beside a mark that it is NULL."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def digest_write(df: DataFrame, path: str) -> None:
    """Store a table for :func:`sync_digest`: rows in ``bucket=`` folders by their hash,
    sorted by ``__part`` within, and beside them one digest per part that does not depend
    on the rows' order: their number and two sums over their hashes."""
    columns = df.columns
    h = row_hash(columns)
    placed = df.withColumns({"bucket": F.pmod(h, F.lit(DIGEST_BUCKETS)).cast("int"),
                             "__part": F.pmod(F.shiftright(h, 20), F.lit(DIGEST_PARTS)).cast("int")})
    # equal rows share a bucket; the row's number deals them to several tasks all the same
    (placed.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(DIGEST_SALTS)))
     .repartition("bucket", "__salt").drop("__salt").sortWithinPartitions("bucket", "__part")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows"))
    df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")   # a store may be empty
    digest_of(digest_read(df.sparkSession, path), columns).write.mode("overwrite").parquet(f"{path}/digests")


def digest_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(bucket, part, n, sum1, sum2), combined map-side; sums are exact decimals."""
    second = F.xxhash64(F.lit("second"), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    return rows.groupBy("bucket", F.col("__part").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_hash(columns).cast("decimal(38,0)")).alias("sum1"),
        F.sum(second.cast("decimal(38,0)")).alias("sum2"))


def digest_read(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("bucket", "integer").add("__part", "integer")).parquet(f"{path}/rows")


def differing_parts(spark: SparkSession, path_a: str, path_b: str) -> dict[int, list[int]]:
    """bucket -> parts whose digests differ.  The digest tables hold at most
    DIGEST_BUCKETS * DIGEST_PARTS rows each, whatever the stores' size; they are compared
    by bucket first, and only differing buckets are compared by part."""
    a, b = (spark.read.parquet(f"{p}/digests") for p in (path_a, path_b))

    def whole(d: DataFrame) -> DataFrame:
        return d.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "sum1", "sum2")])

    def unequal(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        y = y.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("n", "sum1", "sum2")])
        same = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in ("n", "sum1", "sum2")]
        return x.join(y, keys, "full").where(~(same[0] & same[1] & same[2])).select(*keys)

    buckets = [r[0] for r in unequal(whole(a), whole(b), ["bucket"]).collect()]
    out: dict[int, list[int]] = {k: [] for k in buckets}
    below = [d.where(F.col("bucket").isin(buckets)) for d in (a, b)]
    for r in unequal(below[0], below[1], ["bucket", "part"]).collect():
        out[r["bucket"]].append(r["part"])
    return out


def sync_digest(spark: SparkSession, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(rows that a lacks, rows that b lacks), each with all the other side's copies; own
    rows plus these are :func:`sync_tables`' result.  Of both stores only the differing
    buckets' folders are opened, and in them only the differing parts are read."""
    parts = differing_parts(spark, path_a, path_b)
    wanted = F.col("bucket").isin(list(parts)) & F.struct("bucket", "__part").isin(
        [F.struct(F.lit(b).alias("bucket"), F.lit(p).alias("__part")) for b, ps in parts.items() for p in ps])
    some = sorted({p for ps in parts.values() for p in ps})
    a, b = (digest_read(spark, p).where(wanted & F.col("__part").isin(some)).drop("bucket", "__part") for p in (path_a, path_b))
    counts = sync_counts(a, b.select(*a.columns))
    return missing_rows(counts, "__a", "__b", a.columns), missing_rows(counts, "__b", "__a", a.columns)
