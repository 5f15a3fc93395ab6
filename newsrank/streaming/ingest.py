"""Continuous ingest: items arrive as files, are gated, de-duplicated inside the late bound and merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..functions import times as T
from ..operators.filters import publish_time, staging_priority

ITEM_SCHEMA = ("source string, title string, url string, summary string, published_at string, lang string, "
               "authority int, type string, matched_symbols string")


def read_items(spark: SparkSession, path: str, fmt: str = "json", schema: str = ITEM_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def split_late(items: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept, late): the seven-day bound and the clamp of future times; dropped rows go to a side table."""
    marked = items.withColumn("published_ts", publish_time(F.col("published_at"), T.wall(now)))
    return marked.where("published_ts IS NOT NULL"), marked.where("published_ts IS NULL").drop("published_ts")


def gated_items(items: DataFrame, fetched: str = "fetched_at") -> DataFrame:
    """Items with their believable publish time ``published_ts`` (seen from their fetch time) and ``kind``: items or late.

    Late are rows whose publish time is missing, unreadable or more than seven days before the fetch; times more than a day
    ahead are set to the fetch time. ``fetched_ts`` is the fetch time as an instant, for watermarks.
    """
    at = publish_time(F.col("published_at"), F.col(fetched))
    return items.withColumn("published_ts", at).withColumn("kind", F.when(at.isNull(), "late").otherwise("items")).withColumn(
        "fetched_ts", F.concat(F.col(fetched).cast("string"), F.lit("Z")).cast("timestamp"))


def ingest_once(items: DataFrame, id: str, delay: str = "7 days") -> DataFrame:
    """Gated items, each url once inside the watermark; late rows pass as they are. State older than the bound is dropped."""
    url_hash = X.url_hash(F.col("url"))
    keyed = items.withColumn("url_hash", url_hash).withColumn(
        "_once", F.when(F.col("kind") == "late", F.concat(F.lit("late "), F.col(id).cast("string"))).otherwise(url_hash))
    return keyed.withWatermark("fetched_ts", delay).dropDuplicatesWithinWatermark(["_once"]).drop("_once")


def write_kinds(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch in one write: items to ``kind=items``, refused rows to the side table ``kind=late``, by batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("kind", "batch_id").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_items(items: DataFrame, event_time: str = "fetched_ts", delay: str = "7 days") -> DataFrame:
    """One row for each url hash inside the watermark; state older than the late bound is dropped."""
    keyed = items.withColumn("url_hash", X.url_hash(F.col("url"))).withColumn("priority", staging_priority())
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url_hash"])


def run_windows(events: DataFrame, stamp: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events by 12-hour run. With UTC+8 wall clocks the 08:00 and 20:00 edges are 00:00 and 12:00 UTC."""
    return events.withWatermark(stamp, delay).groupBy(F.window(stamp, "12 hours")).agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("run_start"), "events")


def closed_windows(events: DataFrame, path: str, checkpoint: str, stamp: str = "ts", delay: str = "1 day") -> StreamingQuery:
    """12-hour runs that the watermark has closed, each written once; open ones stay in state."""
    return run_windows(events, stamp, delay).writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def reference_pairs(new: DataFrame, reference: DataFrame, key: str, hours: int = 72, delay: str = "1 hour") -> DataFrame:
    """(id, ref_id, key): each new event with the earlier events of the same ``key`` in the last ``hours``, as both streams run.

    Both sides have id, ``key`` and the instant ``ts``. The interval bounds what either side keeps in state.
    """
    n = new.select(F.col("id"), F.col(key).alias("_key"), F.col("ts").alias("new_ts")).withWatermark("new_ts", delay)
    r = reference.select(F.col("id").alias("ref_id"), F.col(key).alias("_ref_key"), F.col("ts").alias("ref_ts")).withWatermark("ref_ts", delay)
    near = (F.col("ref_ts") < F.col("new_ts")) & (F.col("ref_ts") >= F.col("new_ts") - F.expr(f"INTERVAL {hours} HOURS"))
    return n.join(r, (F.col("_key") == F.col("_ref_key")) & near).select("id", "ref_id", F.col("_key").alias(key))


def latest_version(spark: SparkSession, path: str, below: int) -> int | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[8:]) for n in names if n.startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((v for v in done if v < below), default=None)


def with_previous(stream: DataFrame, key: str, value: str, stamp: str, state: str, path: str, checkpoint: str, max_hours: float = 24) -> StreamingQuery:
    """For each micro-batch the last row of each key with the stored value before it, if that is at most ``max_hours`` old.

    The stored side is a table that each batch reads anew and replaces by a new version, so a replayed batch meets the same
    version it met before. Writes (key, ``value``, ``stamp``, previous).
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy(key).agg(F.max_by(value, stamp).alias(value), F.max(stamp).alias(stamp))
        version = latest_version(spark, state, batch_id)
        old = now.limit(0) if version is None else spark.read.schema(now.schema).parquet(f"{state}/version={version}")
        old = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(stamp).alias("_at"))
        met = now.join(old, F.col(key) == F.col("_k"), "full")
        fresh = (F.unix_micros(stamp) - F.unix_micros("_at")) <= int(max_hours * 3_600_000_000)
        met.where(F.col(key).isNotNull()).select(key, value, stamp, F.when(fresh, F.col("_v")).alias("previous")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        met.select(F.coalesce(key, "_k").alias(key), F.coalesce(value, "_v").alias(value), F.coalesce(stamp, "_at").alias(stamp)).write.mode("overwrite").parquet(f"{state}/version={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch once.

    A batch goes into the partition named by its id, with overwrite, so a batch that fails half-way and
    runs again replaces its own rows. What a batch consumed is marked from the written partition, so
    nothing is marked before it is stored.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_reference(events: DataFrame, now, hours: int, stamp: str = "time_get_data") -> DataFrame:
    """The stored events a micro-batch is matched against: the last 72 hours for merging, 96 for contradictions."""
    return events.where(F.col(stamp) >= F.timestamp_add("HOUR", F.lit(-hours), T.wall(now)))


def previous_values(state: DataFrame, kind: str, now, max_hours: float | None = None) -> DataFrame:
    """(key, value, hours): the last stored value of each key with its age, none older than ``max_hours``."""
    hours = T.hours_between(T.wall(now), F.col("updated_at"))
    rows = state.where(F.col("state_kind") == kind).select(F.col("state_key").alias("key"), F.col("numeric_value").alias("value"),
                                                           hours.alias("hours"))
    return rows if max_hours is None else rows.where(F.col("hours") <= max_hours)
