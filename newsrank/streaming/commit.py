"""Commit of micro-batches by a ledger: a batch counts when its ledger record is there, and only then.

A batch is written into a partition of its own, then its record is written beside the table. A run that dies before the
record is replayed by the checkpoint and overwrites its own partition; a run that dies after it finds the record and
writes nothing. Readers take recorded batches only, so half-written rows are never seen, and a staged item is marked
consumed from recorded rows, so never before it is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "batch_id bigint, n_rows bigint"


def recorded(spark: SparkSession, ledger: str) -> DataFrame:
    """(batch_id, n_rows) of the batches that count."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)


def commit(batch: DataFrame, batch_id: int, table: str, ledger: str, before_record: Callable | None = None) -> None:
    """Store one batch and record it; a recorded batch is left alone. ``before_record`` runs between the two (for tests of failures)."""
    spark = batch.sparkSession
    if not recorded(spark, ledger).where(F.col("batch_id") == batch_id).isEmpty():
        return
    part = f"{table}/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(part)
    if before_record:
        before_record(batch_id)
    stored = spark.read.schema(batch.schema).parquet(part).agg(F.count("*").alias("n_rows"))
    stored.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "n_rows").write.mode("overwrite").parquet(f"{ledger}/{batch_id}")


def committed(spark: SparkSession, table: str, ledger: str, schema) -> DataFrame:
    """Rows of recorded batches, with their ``batch_id``."""
    done = recorded(spark, ledger)
    if done.isEmpty():
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("bigint"))
    rows = spark.read.option("basePath", table).schema(schema).parquet(f"{table}/batch_id=*").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return rows.join(F.broadcast(done.select("batch_id")), "batch_id", "left_semi")


def commit_stream(stream: DataFrame, table: str, ledger: str, checkpoint: str, before_record: Callable | None = None) -> StreamingQuery:
    """Every micro-batch of what has arrived, committed once."""
    return stream.writeStream.foreachBatch(lambda batch, i: commit(batch, i, table, ledger, before_record)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_consumed(staging: DataFrame, done: DataFrame, deferred: DataFrame, now) -> DataFrame:
    """``staging`` after the commit: stored ids are consumed, deferred ones stay open with their count raised and their reason kept."""
    stored = done.select(F.col("id").alias("_done")).distinct()
    held = deferred.select(F.col("id").alias("_held"), F.col("defer_reason").alias("_reason")).dropDuplicates(["_held"])
    j = staging.join(stored, F.col("id") == F.col("_done"), "left").join(held, F.col("id") == F.col("_held"), "left")
    is_done, is_held = F.col("_done").isNotNull() & F.col("_held").isNull(), F.col("_held").isNotNull()
    return (j.withColumn("consumed_at", F.when(is_done, F.coalesce("consumed_at", now)).otherwise(F.col("consumed_at")))
            .withColumn("deferred_count", F.col("deferred_count") + is_held.cast("int"))
            .withColumn("defer_reason", F.when(is_held, F.col("_reason")).otherwise(F.col("defer_reason"))).drop("_done", "_held", "_reason"))
