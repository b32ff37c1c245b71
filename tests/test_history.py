"""Snapshots of every state; two-way sync with much repeated rows; digests of large stores."""

import pytest
from pyspark.sql import functions as F

from tidepool.session import shared_dir
from tidepool.sources import history as H

SCHEMA = "k long, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("state,computed", [("missing", True), ("empty folder", True), ("stale", True), ("fresh", False),
                                            ("fresh, no rows", False)])
def test_snapshot_states(spark, state, computed):
    path, calls = shared_dir(spark, "snapshot"), []
    stored = spark.createDataFrame([(1, "old")], "id long, hashtag string")
    if state == "empty folder":
        stored.write.parquet(path)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(fs_path):
            fs.delete(f.getPath(), False)
    elif state != "missing":
        (stored.limit(0) if "no rows" in state else stored).write.parquet(path)
    now = (H.newest_file_time(spark, path) or 1_700_000_000) + (6 if state == "stale" else 4) * 3600

    def compute():
        calls.append(1)
        return spark.createDataFrame([(2,)], "id long")

    out = H.snapshot_or_recompute(spark, path, 5, now, compute, "new")
    assert bool(calls) == computed
    want = [(2, "new")] if computed else [] if "no rows" in state else [(1, "old")]
    assert rows_of(out) == want == rows_of(spark.read.parquet(path))


def test_file_times_are_those_of_the_files(spark):
    path = shared_dir(spark, "times")
    assert H.file_times(spark, path) == [] and H.newest_file_time(spark, path) == 0
    spark.range(10).repartition(3).write.parquet(path)
    H.set_file_times(spark, path, 1_600_000_000)
    assert H.file_times(spark, path) == [1_600_000_000.0] * 3
    assert H.fresh_snapshot(spark, path, 5, 1_600_000_000 + 4 * 3600).count() == 10
    assert H.fresh_snapshot(spark, path, 5, 1_600_000_000 + 6 * 3600).count() == 0


A = [(1, "x"), (1, "x"), (2, None), (None, None), (None, None), (3, "only a"), (3, "only a"), (4, "")]
B = [(1, "x"), (None, None), (5, "only b"), (5, "only b"), (5, "only b"), (None, "b"), (4, None)]


def synced(a, b):
    """By plain Python: own rows, and the other side's rows that are missing."""
    return ([*a, *[r for r in b if r not in a]], [*b, *[r for r in a if r not in b]])


@pytest.mark.parametrize("piece", [1, 2, 1 << 16])
def test_sync_against_plain_python(spark, monkeypatch, piece):
    monkeypatch.setattr(H, "COPY_PIECE", piece)
    a, b = spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, "other long, names string")
    new_a, new_b = H.sync_tables(a, b)
    want_a, want_b = synced(A, B)
    assert rows_of(new_a) == sorted(want_a, key=repr) and rows_of(new_b) == sorted(want_b, key=repr)
    assert new_b.columns == ["other", "names"]
    both = H.sync_sides(a, b)
    assert rows_of(both.where("side = 'a'").drop("side")) == sorted(want_a, key=repr)
    assert rows_of(both.where("side = 'b'").drop("side")) == sorted(want_b, key=repr)
    one_way = H.sync_tables(a, b, two_way=False)
    assert rows_of(one_way[0]) == sorted(A, key=repr) and rows_of(one_way[1]) == sorted(want_b, key=repr)


def test_digest_sync_against_plain_python(spark):
    at = [shared_dir(spark, "store") for _ in range(2)]
    for path, rows in zip(at, (A, B)):
        H.digest_write(spark.createDataFrame(rows, SCHEMA), path)
    lacks_a, lacks_b = H.sync_digest(spark, *at)
    assert rows_of(lacks_a) == sorted([r for r in B if r not in A], key=repr)
    assert rows_of(lacks_b) == sorted([r for r in A if r not in B], key=repr)


def test_equal_and_empty_stores(spark):
    at = [shared_dir(spark, "store") for _ in range(3)]
    full = spark.createDataFrame(A, SCHEMA)
    H.digest_write(full, at[0])
    H.digest_write(full.orderBy(F.desc("k")).repartition(5), at[1])   # another order, other files
    H.digest_write(full.limit(0), at[2])
    assert H.differing_parts(spark, at[0], at[1]) == {}
    assert [df.count() for df in H.sync_digest(spark, at[0], at[1])] == [0, 0]
    lacks_a, lacks_e = H.sync_digest(spark, at[0], at[2])
    assert lacks_a.count() == 0 and rows_of(lacks_e) == sorted(A, key=repr)


def test_only_differing_buckets_are_read(spark):
    at = [shared_dir(spark, "store") for _ in range(2)]
    many = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    H.digest_write(many, at[0])
    H.digest_write(many.where("k <> 77").unionByName(spark.createDataFrame([(-1, "new")], SCHEMA)), at[1])
    parts = H.differing_parts(spark, *at)
    assert 1 <= len(parts) <= 2 and sum(map(len, parts.values())) == 2
    lacks_a, lacks_b = H.sync_digest(spark, *at)
    assert rows_of(lacks_a) == [(-1, "new")] and [r["k"] for r in lacks_b.collect()] == [77]
    scans = [x for x in lacks_b._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert scans
    for scan in scans:
        filters = scan.split("PartitionFilters")[1].split("PushedFilters")
        assert "bucket" in filters[0] and "__part" in filters[1]


def test_a_row_repeated_ten_million_times(spark):
    n = 10_000_000
    at = [shared_dir(spark, "store") for _ in range(2)]
    H.digest_write(spark.range(n).select(F.lit(1).cast("long").alias("k"), F.lit("same").alias("v")), at[0])
    H.digest_write(spark.createDataFrame([(2, "b")], SCHEMA), at[1])
    lacks_a, lacks_b = H.sync_digest(spark, *at)
    assert rows_of(lacks_a) == [(2, "b")] and lacks_b.count() == n
    per_task = [r[1] for r in lacks_b.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 1 and max(per_task) < n / 2


def test_latest_of_a_history_by_day(spark):
    order = [F.col("date").desc(), F.col("k").desc()]
    rows = spark.range(90).select(F.col("id").alias("k"), F.when(F.col("id") % 30 != 7, F.timestamp_seconds(
        F.lit(1_700_000_000) + F.floor(F.col("id") / 3) * 86_400)).alias("date"))
    path = shared_dir(spark, "by-day")
    assert H.latest_by_day(spark, path, rows.schema, ["k"], 5, order).count() == 0
    H.write_by_day(rows, path)
    for n in (1, 3, 7, 50, 88, 200):
        got = [r["k"] for r in H.latest_by_day(spark, path, rows.schema, ["k"], n, order).collect()]
        assert got == [r["k"] for r in rows.orderBy(*order).limit(n).collect()]
    assert H.days_of(spark, path)[-1] is None and len(H.days_of(spark, path)) == 31
    plan = H.latest_by_day(spark, path, rows.schema, ["k"], 7, order)._jdf.queryExecution().executedPlan().toString()
    days = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    newest = H.days_of(spark, path)
    assert newest[0] in days and newest[3] in days and newest[4] not in days   # four days hold seven rows
