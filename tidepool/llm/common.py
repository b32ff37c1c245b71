"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import checkpoint_root, shared_dir

#: Bytes of the texts of a batch that are worked on together.
PART_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names, so extra
    columns of the caller can never clash with the operator's."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parts_of(batch: pa.RecordBatch, part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch (id, text), each time of about ``part_bytes`` of text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + part_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(docs: DataFrame, fn: Callable[[list], dict], fields: str,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fn(list of texts) -> {column: values}`` per Arrow batch or part of one (about
    PART_BYTES of text, so that a worker never holds the results of a whole batch), one
    row out per row in, the id carried through.  ``fields`` is the DDL of fn's columns."""
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in parts_of(b):
                out = fn(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(v if isinstance(v, pa.Array) else pa.array(v) for v in out.values())],
                    names=["doc_id", *out])

    return rows.mapInArrow(batches, f"doc_id {id_type}, {fields}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder all executors share; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number of its own for every row, written down in the shared folder,
    so that each later job sees the same numbers; and that column's name."""
    name = fresh_name(df, "row_id")
    at = shared_dir(df.sparkSession, "rows")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(at)
    return df.sparkSession.read.parquet(at), name
