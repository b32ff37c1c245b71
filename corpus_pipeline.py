"""The corpus pipeline: documents in, encoded training documents out.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns a DataFrame that the caller writes as Parquet and reads back
as the next stage's docs.  All stages but the last return the columns of docs,
extra columns included.  Null or empty texts are never rejected, null ids neither;
repeated ids are told apart by row.  An empty table passes through as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe_forced, mixing, secret_lexer, simhash_vptree, toxicity_channel
from tidepool.llm.common import fresh_name, table, with_row_ids
from tidepool.llm.queries import vocab_path
from tidepool.session import shared_dir

#: A document goes at this toxicity score or above.
TOXIC_AT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_AT by the model trained on these documents."""
    model = toxicity_channel.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_channel.score_column(F.col("text"), model) < TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last)."""
    rows, row_id = with_row_ids(docs)
    groups = simhash_vptree.near_duplicates(rows, shingle=4, max_bits=4, id_col=row_id)
    ids = rows.select(F.col(row_id).alias("row"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))["row"].alias("row")
    kept = groups.join(ids, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(first)
    return rows.join(kept, rows[row_id] == kept["row"], "left_semi").drop(row_id)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked; n_chars follows the text."""
    masked = fresh_name(docs, "masked")
    out = docs.withColumn(masked, secret_lexer.redact(F.col("text")))
    columns = {"text": F.col(masked)}
    if "n_chars" in docs.columns:
        same = F.col(masked).eqNullSafe(F.col("text"))
        columns["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(masked).cast(docs.schema["n_chars"].dataType))
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    rows, row_id = with_row_ids(docs)
    taken = mixing.mix(rows, id_col=row_id, order_col="doc_id").where("copies > 0").select(
        F.col("doc_id").alias("taken_row"), F.sequence(F.lit(1), "copies").alias("turns"))
    repeated = rows.join(taken, rows[row_id] == taken["taken_row"])
    turn = fresh_name(docs, "turn")
    return repeated.select(*[rows[c] for c in docs.columns], F.explode(taken["turns"]).alias(turn)).drop(turn)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe_forced.round_trip_digests(docs, vocab_path(), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Stages decode, fit and encode in ways that SQL cannot express; tests/llm holds
# run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
