"""Running form of the signal cooldown: keyed state that event-time timers take away, checked by escalation rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import dictionaries as D
from ..session import cut_lineage
from .ingest import latest_version

OUTPUT = "key string, kind string, magnitude double, at_us long"
_STATE = "magnitude double, at_ms long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def may_emit(kind: str, magnitude: float, hours: float, previous: float) -> bool:
    """Out of cooldown, or grown: by half for liquidations, by eight points for the others."""
    if hours >= D.COOLDOWN_HOURS.get(kind, 12.0):
        return True
    if kind == "liquidation":
        return previous <= 0 or abs(magnitude) >= previous * 1.5
    return abs(magnitude) >= previous + 8.0


def _cooldown(ttl_ms: int):
    """The step of one key in one micro-batch: its rows by time, its state, and the one timer that clears the state."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = []
        for pdf in frames:
            rows += zip(pdf["us"].tolist(), pdf["magnitude"].tolist(), pdf["kind"].tolist())
        rows.sort(key=lambda r: r[:2])
        last = tuple(state.get) if state.exists else None
        out = []
        for at_us, magnitude, kind in rows:
            at_ms = at_us // 1000
            if last is None or may_emit(kind, magnitude, (at_ms - last[1]) / 3.6e6, abs(last[0])):
                last = (round(magnitude, 4), at_ms)
                out.append((key[0], kind, magnitude, at_us))
        state.update(last)
        # a timeout fires once the watermark is past it, so one millisecond less lets it fire at the full time
        state.setTimeoutTimestamp(max(last[1] + ttl_ms - 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "magnitude", "at_us"])

    return step


def cooldown_stream(signals: DataFrame, ttl_days: int = 30, delay: str = "1 hour") -> DataFrame:
    """Signals (key, kind, magnitude, at) that may go out.

    A key's rows of one micro-batch are judged in order of time. Its state goes when the watermark is ``ttl_days`` past its
    last signal, whether or not the key is seen again. States travel to the tasks with the rows, many keys at a time, so a key
    costs no call of its own to the state store.
    """
    rows = signals.withWatermark("at", delay).select("key", "kind", "magnitude", "at")
    kept = rows.withColumn("us", F.unix_micros("at")).groupBy("key").applyInPandasWithState(
        _cooldown(ttl_days * 24 * 3600 * 1000), OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select("key", "kind", "magnitude", F.timestamp_micros("at_us").alias("at"))


_VERSION = "key string, magnitude double, at_ms long, top_us long"
_ROW = "key string, kind string, magnitude double, us long, held boolean"


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, the held state first and then by time: what may go out, and the state of each key after it (held)."""
    key, last = None, None
    for pdf in frames:
        out = []
        for k, kind, magnitude, us, held in zip(*(pdf[c].tolist() for c in ("key", "kind", "magnitude", "us", "held"))):
            if k != key:
                if last is not None:
                    out.append((key, None, last[0], last[1] * 1000, True))
                key, last = k, None
            if held:
                last = (magnitude, us // 1000)
            elif last is None or may_emit(kind, magnitude, (us // 1000 - last[1]) / 3.6e6, abs(last[0])):
                last = (round(magnitude, 4), us // 1000)
                out.append((k, kind, magnitude, us, False))
        yield pd.DataFrame(out, columns=["key", "kind", "magnitude", "us", "held"])
    if last is not None:
        yield pd.DataFrame([(key, None, last[0], last[1] * 1000, True)], columns=["key", "kind", "magnitude", "us", "held"])


def cooldown_batches(signals: DataFrame, state: str, path: str, checkpoint: str, ttl_days: int = 30, delay_hours: int = 1) -> StreamingQuery:
    """The same rule for many keys: each micro-batch is dealt by key, sorted, and walked once with the stored states.

    The states are a table that each batch reads anew and replaces by a new version, so a replayed batch meets the same
    version it met before. A row more than the delay behind what earlier batches held is late and left out; a state that is
    ``ttl_days`` behind, less the delay, goes. No group is gathered: a task holds one Arrow batch and one key's state.
    Writes (key, kind, magnitude, at); the states are (key, magnitude, at_ms, top_us), ``top_us`` the newest time seen.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = latest_version(spark, state, batch_id)
        old = spark.createDataFrame([], _VERSION) if version is None else spark.read.schema(_VERSION).parquet(f"{state}/version={version}")
        seen = old.agg(F.max("top_us")).first()[0]
        rows = batch.select("key", "kind", "magnitude", F.unix_micros("at").alias("us"), F.lit(False).alias("held"))
        if seen is not None:
            rows = rows.where(F.col("us") > seen - delay_hours * 3_600_000_000)
        held = old.select("key", F.lit(None).cast("string").alias("kind"), "magnitude", (F.col("at_ms") * 1000).alias("us"), F.lit(True).alias("held"))
        dealt = rows.unionByName(held).repartition("key").sortWithinPartitions("key", F.desc("held"), "us", "magnitude")
        walked = cut_lineage(dealt.mapInPandas(_walk, _ROW))
        walked.where("NOT held").select("key", "kind", "magnitude", F.timestamp_micros("us").alias("at")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        top = max((t for t in (seen, batch.agg(F.max(F.unix_micros("at"))).first()[0]) if t is not None), default=None)
        kept = walked.where("held").select("key", "magnitude", F.expr("us DIV 1000").alias("at_ms"), F.lit(top).cast("long").alias("top_us"))
        live = F.col("at_ms") * 1000 + ttl_days * 86_400_000_000 > F.col("top_us") - delay_hours * 3_600_000_000
        kept.where(live).write.mode("overwrite").parquet(f"{state}/version={batch_id}")

    return signals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_state(spark: SparkSession, state: str) -> DataFrame:
    """(key, magnitude, at_ms): what ``cooldown_batches`` holds after its last batch."""
    return spark.read.schema(_VERSION).parquet(f"{state}/version={latest_version(spark, state, 2 ** 62)}").drop("top_us")


def cooldown_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, magnitude, at_ms): what the running form holds after its last batch, from its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.selectExpr("key.key AS key", "value.groupState.magnitude AS magnitude", "value.groupState.at_ms AS at_ms").where("magnitude IS NOT NULL")
