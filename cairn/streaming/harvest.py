"""Incremental harvest (I7) and idempotent micro-batch commits.

Landed item files are read as a file stream, pushed through the shared gate, and lose the keys
(source, external_id) that the stream has let through before. The keys are streaming state in RocksDB: a batch
looks up its own keys only, so its cost does not follow the store's size. Each micro-batch writes one
directory named by its batch id with overwrite, so a batch that runs again rewrites its own directory. No event is
late: the state has no time limit, so old rows and rows of unknown time are stored like any other.

A stream that starts anew over a store that others have filled knows none of its keys; its batches are compared
with the store instead (``commit_batch``, an anti join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.harvest import harvest_gate
from ..operators.util import materialize
from .ordered import rocks_db

ITEM = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("external_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("created_utc", T.LongType()), T.StructField("engagement", T.LongType()),
    T.StructField("query", T.StringType())])


def gated_stream(spark: SparkSession, landed: str, gate_kwargs: dict | None = None) -> DataFrame:
    items = spark.readStream.schema(ITEM).parquet(landed)
    return harvest_gate(items, **(gate_kwargs or {}))


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    """Keys of the store with their batch; None while there is no store. Any other failure
    to read is raised: taking it for an empty store would insert duplicates."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(store).select("source", "external_id", "batch")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def commit_batch(store: str, first: int = 0):
    """foreachBatch sink: insert-or-ignore into the signal store, one directory per
    micro-batch (overwrite = idempotent on replay), numbered from ``first``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_id += first
        one = Window.partitionBy("source", "external_id").orderBy(F.xxhash64(*batch.columns), *[
            c for c, kind in batch.dtypes if kind in ("string", "bigint", "int", "double")])
        fresh = batch.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
        stored = _stored(batch.sparkSession, store)
        if stored is not None:
            others = stored.filter(F.col("batch") != batch_id).select("source", "external_id")
            fresh = fresh.join(others, ["source", "external_id"], "left_anti")
        # the rows are settled before the directory that a replay may have left is replaced
        fresh = materialize(fresh, "harvest-batch")
        fresh.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch_id}")

    return write


def write_batch(store: str):
    """foreachBatch sink of a stream that has no key twice: one directory per micro-batch, overwritten on replay."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch_id}")

    return write


def _first_batch(spark: SparkSession, store: str, checkpoint: str) -> int:
    """The number of the first batch of this checkpoint's stream: 0 if the store held nothing when it began, else the one
    after those that others had written. Noted beside the checkpoint."""
    from pyspark.errors import AnalysisException
    note = f"{checkpoint.rstrip('/')}-first-batch"
    try:
        return spark.read.schema("first long").parquet(note).first().first
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    stored = _stored(spark, store)
    last = None if stored is None else stored.agg(F.max("batch")).first()[0]
    first = 0 if last is None else last + 1
    spark.createDataFrame([(first,)], "first long").coalesce(1).write.parquet(note)
    return first


def incremental_harvest(spark: SparkSession, landed: str, store: str, checkpoint: str,
                        gate_kwargs: dict | None = None):
    """Run the harvest stream over everything landed so far (availableNow) and stop."""
    items = gated_stream(spark, landed, gate_kwargs)
    first = _first_batch(spark, store, checkpoint)
    if first == 0:
        items, sink = items.dropDuplicates(["source", "external_id"]), write_batch(store)
    else:
        sink = commit_batch(store, first)
    with rocks_db(spark):
        q = (items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def once(messages: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """G2 stream: of messages with the same keys that lie ``within`` each other (``ts`` in seconds) the first to
    arrive; keys are forgotten when the watermark has passed them, so the state does not grow with the log."""
    timed = messages.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", within)
    return timed.dropDuplicatesWithinWatermark(keys).drop("event_time")
