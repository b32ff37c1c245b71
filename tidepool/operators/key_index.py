"""Checks against a large history without moving the history.

A history's keys are kept as a table of their own, bucketed and sorted by the key when
they are written.  A check then reads the buckets as they lie: only the candidates are
exchanged, into the buckets' layout, and neither side of the history is shuffled or
sorted again, however many rounds ask it.  New keys are appended bucket by bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import shared_dir


def _write(keys: DataFrame, name: str, path: str, buckets: int, mode: str) -> None:
    # one task per bucket writes one sorted file of it
    (keys.repartition(buckets, "key").write.mode(mode).bucketBy(buckets, "key").sortBy("key")
     .option("path", path).format("parquet").saveAsTable(name))


class KeyIndex:
    """The distinct keys of a history, in ``buckets`` buckets (at least as many as
    spark.sql.shuffle.partitions, which is the default, or Spark may prefer to move
    both sides).  The files lie in the shared folder."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"keys_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = shared_dir(spark, self.name)

    def _keys(self, history: DataFrame, key: Column | str) -> DataFrame:
        k = F.col(key) if isinstance(key, str) else key
        return history.select(k.alias("key")).where(F.col("key").isNotNull()).distinct()

    def build(self, history: DataFrame, key: Column | str) -> KeyIndex:
        _write(self._keys(history, key), self.name, self.path, self.buckets, "overwrite")
        return self

    def append(self, rows: DataFrame, key: Column | str) -> KeyIndex:
        """Add the keys of further rows; those it has stay single."""
        new = self._keys(rows, key)
        _write(new.join(self.table(), "key", "left_anti"), self.name, self.path, self.buckets, "append")
        return self

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _join(self, candidates: DataFrame, key: Column | str, how: str) -> DataFrame:
        k = F.col(key) if isinstance(key, str) else key
        kind = self.table().schema["key"].dataType
        named = candidates.withColumn("__key", k.cast(kind))
        known = self.table().withColumnRenamed("key", "__known")
        return named.join(known, F.col("__key") == F.col("__known"), how).drop("__key")

    def unseen(self, candidates: DataFrame, key: Column | str) -> DataFrame:
        """Candidates whose key the history lacks; a null key is never known."""
        return self._join(candidates, key, "left_anti")

    def seen(self, candidates: DataFrame, key: Column | str) -> DataFrame:
        """Candidates whose key the history has."""
        return self._join(candidates, key, "left_semi")
