"""Sinks, merges and streams."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from newsrank.sources import tables as TB
from newsrank.streaming import commit as CM
from newsrank.streaming.cooldown import cooldown_state, cooldown_stream, may_emit
from newsrank.streaming.ingest import dedup_items, write_batches


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", 5, 9, "x"), (2, "b", 5, 9, None)], "id long, title string, n int, social int, sym string")
    new = spark.createDataFrame([(2, "B", 7, 3, "y"), (3, "c", 1, 1, None)], "id long, title string, n int, social int, sym string")
    got = TB.merge_by_key(old, new, "id", ["n"], greatest=["social"], keep_old_when_null=["sym"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a", 5, 9, "x"), (2, "b", 7, 9, "y"), (3, "c", 1, 1, None)]


def test_rewrite_partitions_and_export(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([(1, "d1"), (2, "d2")], "id long, date string")
    TB.rewrite_partitions(rows, f"{base}/t")
    again = spark.read.parquet(f"{base}/t").where("date = 'd2'").withColumn("id", F.col("id").cast("long") + 10)
    TB.rewrite_partitions(again.select("id", "date"), f"{base}/t")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/t").select("id", "date").collect()) == [(1, "d1"), (12, "d2")]
    TB.export_delimited(rows.coalesce(1), f"{base}/out")
    text = spark.read.text(f"{base}/out").collect()
    assert [r.value for r in text] == ["id\tdate", "1\td1", "2\td2"]


def test_stream_dedup_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("https://a.example/1", 0), ("https://a.example/1/", 10), ("https://a.example/2", 20)]
    spark.createDataFrame(rows, "url string, s long").write.json(f"{base}/in")

    def run():
        items = spark.readStream.schema("url string, s long").json(f"{base}/in").select(
            "url", F.lit("x").alias("source"), F.lit("rss").alias("type"), F.lit("").alias("matched_symbols"),
            F.timestamp_seconds("s").alias("fetched_ts"))
        write_batches(dedup_items(items), f"{base}/table", f"{base}/state").awaitTermination()
        return spark.read.parquet(f"{base}/table").count()

    assert run() == 2
    spark.createDataFrame([("https://a.example/2", 30), ("https://a.example/3", 40)], "url string, s long").write.mode("append").json(f"{base}/in")
    assert run() == 3


@pytest.mark.parametrize("kind, magnitude, hours, previous, want", [
    ("price_move", 10, 13, 9, True), ("price_move", 16.9, 2, 9, False), ("price_move", 17, 2, 9, True),
    ("liquidation", 140, 1, 100, False), ("liquidation", 150, 1, 100, True), ("liquidation", 1, 1, 0, True)])
def test_may_emit(kind, magnitude, hours, previous, want):
    assert may_emit(kind, magnitude, hours, previous) is want


def test_cooldown_stream(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k1", "price_move", 10.0, t0), ("k1", "price_move", 12.0, t0 + dt.timedelta(hours=2)),
            ("k1", "price_move", 18.5, t0 + dt.timedelta(hours=3)), ("k2", "liquidation", 5e6, t0)]
    spark.createDataFrame(rows, "key string, kind string, magnitude double, at timestamp").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("key string, kind string, magnitude double, at timestamp").parquet(f"{base}/in")
    try:
        q = cooldown_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/c").trigger(
            availableNow=True).start(f"{base}/out")
        done = q.awaitTermination(60)
        q.stop()
        assert done
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.key, r.magnitude) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("k1", 10.0), ("k1", 18.5), ("k2", 5e6)]
    assert sorted(r.key for r in cooldown_state(spark, f"{base}/c").collect()) == ["k1", "k2"]


def test_a_batch_counts_once_and_only_when_recorded(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")

    def die(batch_id):
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        CM.commit(rows, 0, f"{base}/t", f"{base}/l", die)
    assert CM.committed(spark, f"{base}/t", f"{base}/l", rows.schema).count() == 0
    CM.commit(rows, 0, f"{base}/t", f"{base}/l")
    CM.commit(rows.where("id = 1"), 0, f"{base}/t", f"{base}/l")          # recorded: nothing is written
    CM.commit(rows.where("id = 1"), 1, f"{base}/t", f"{base}/l")
    got = sorted((r.id, r.batch_id) for r in CM.committed(spark, f"{base}/t", f"{base}/l", rows.schema).collect())
    assert got == [(1, 0), (1, 1), (2, 0)]


def test_consumed_only_when_stored_and_not_deferred(spark):
    queue = spark.createDataFrame([(1, None, 0, None), (2, None, 1, "quota"), (3, None, 0, None), (4, dt.datetime(2024, 1, 1), 0, None)],
                                  "id long, consumed_at timestamp_ntz, deferred_count int, defer_reason string")
    done = spark.createDataFrame([(1,), (2,), (1,)], "id long")
    held = spark.createDataFrame([(2, "budget")], "id long, defer_reason string")
    got = CM.mark_consumed(queue, done, held, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).orderBy("id").collect()
    assert [(r.id, r.consumed_at is not None, r.deferred_count, r.defer_reason) for r in got] == [
        (1, True, 0, None), (2, False, 2, "budget"), (3, False, 0, None), (4, True, 0, None)]


def test_cooldown_in_batches_walks_each_key_once_and_forgets_old_ones(spark):
    from newsrank.streaming.cooldown import batch_state, cooldown_batches

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    t0, h = dt.datetime(2024, 1, 1), lambda n: dt.timedelta(hours=n)
    schema = "key string, kind string, magnitude double, at timestamp"
    runs = [[("k1", "price_move", 10.0, t0), ("k1", "price_move", 12.0, t0 + h(2)), ("k2", "liquidation", 5e6, t0)],
            [("k1", "price_move", 17.0, t0 + h(3)), ("k1", "price_move", 18.0, t0 + h(4)), ("k1", "price_move", 99.0, t0 - h(1)),
             ("k3", "price_move", 1.0, t0 + h(721))],
            [("k2", "liquidation", 1.0, t0 + h(722))]]
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        assert cooldown_batches(stream, f"{base}/s", f"{base}/out", f"{base}/c").awaitTermination(60)
    got = sorted((r.key, r.magnitude) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("k1", 10.0), ("k1", 18.0), ("k2", 1.0), ("k2", 5e6), ("k3", 1.0)]
    assert sorted(r.key for r in batch_state(spark, f"{base}/s").collect()) == ["k1", "k2", "k3"]
