"""Session construction and the shared scratch folder.

Everything that must survive the loss of an executor (snapshots, history
tables written by a job, streaming checkpoints) goes under the folder the
cluster names in ``spark.checkpoint.dir``.  Only when that is unset (local
tests) do we create one, once per session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

# Settings that matter at scale; all are plain Spark SQL confs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a join into a broadcast join when it has measured one side below
    # this; at planning time Spark's own estimate threshold (10 MB) holds.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # Partition sizing: scans split at 256 MB; shuffles start from
    # spark.sql.shuffle.partitions (set it high on a cluster, e.g. 4000+ for
    # 100 TB) and AQE coalesces them towards 128 MB, or splits skewed ones.
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # streaming state (exact dedup keeps every key) lives on local disk in
    # RocksDB, snapshotted with the checkpoint, not in executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidepool") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TIDEPOOL_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; created only when a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # Unset: a local test session.  Remember it on the SparkContext.
        root = tempfile.mkdtemp(prefix="tidepool-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    # Dataset.checkpoint() needs the SparkContext to know it as well.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: a plain path, or any URI pyarrow can open."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
