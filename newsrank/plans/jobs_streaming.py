"""Streaming jobs run to the end of the given tables (STR)."""

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import times as T
from ..session import cut_lineage, shared_folder
from ..streaming import commit as CM
from ..streaming import ingest as IN
from ..streaming.cooldown import batch_state, cooldown_batches
from .jobs_sources import ISO_TS
from .registry import job
from .views import NOW, DuckWords, SparkWords

GATE = "2024-01-21 00:00:00"


def _scratch(spark, name):
    """A new folder for this run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _instant(wall):
    """A wall clock as an instant (read as UTC), for watermarks."""
    return F.concat(wall.cast("string"), F.lit("Z")).cast("timestamp")


def _in_runs(f, rows, runs, name, start):
    """The stream over ``rows`` (with their run number ``run``) as a schedule runs it: each run finds what has landed since.

    ``start`` gets the stream and the folder of this job and starts a query that ends when all is read. Returns the folder.
    """
    base, rows = _scratch(f.spark, name), cut_lineage(rows)
    schema = rows.drop("run").schema
    for r in range(runs):
        rows.where(F.col("run") == r).drop("run").write.mode("append").parquet(f"{base}/in")
        start(f.spark.readStream.schema(schema).parquet(f"{base}/in"), base, r)
    return base


INGEST_RUNS = 6
_LANDED = """
SELECT doc_id AS id, 'https://site.example.com/' || CAST(doc_id % (CAST(floor(top / 4) AS BIGINT) + 1) AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END AS url,
  CAST(floor(doc_id * 6 / (top + 1)) AS INT) AS run, {fetched} AS fetched_at,
  CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 43 = 0 THEN 'soon' ELSE {published} || 'Z' END AS published_at
FROM (SELECT doc_id, max(doc_id) OVER () AS top FROM documents)"""


def _landed_text(w):
    fetched = w.add_seconds(w.ts("2024-01-01 00:00:00"), "CAST(floor(doc_id * 5184000 / (top + 1)) AS BIGINT)")
    return _LANDED.format(fetched=fetched, published=w.iso(w.add_hours(fetched, "CASE WHEN doc_id % 41 = 0 THEN 300 ELSE -(doc_id % 200) END")))


INGEST_CHECK = f"""
WITH RECURSIVE landed AS ({_landed_text(DuckWords)}),
seen AS (
  SELECT *, TRY_CAST(replace(published_at, 'Z', '') AS TIMESTAMP) AS said FROM landed),
gated AS (
  SELECT *, CASE WHEN said IS NULL OR fetched_at - said > INTERVAL 7 DAY THEN 'late' ELSE 'items' END AS kind,
    sha256(regexp_replace(url, '/+$', '')) AS url_hash FROM seen),
ends AS (SELECT run, max(max(fetched_at)) OVER (ORDER BY run) AS top FROM gated GROUP BY run),
turns AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY id) AS k FROM gated WHERE kind = 'items'),
walk AS (  -- one url's items in turn; ``held`` is when the one in state came, until the watermark of an earlier run has passed it by the delay
  SELECT url_hash, k, id, true AS passed, fetched_at AS held FROM turns WHERE k = 1
  UNION ALL
  SELECT t.url_hash, t.k, t.id, e.top - INTERVAL 7 DAY >= w.held + INTERVAL 7 DAY,
    CASE WHEN e.top - INTERVAL 7 DAY >= w.held + INTERVAL 7 DAY THEN t.fetched_at ELSE w.held END
  FROM walk w JOIN turns t ON t.url_hash = w.url_hash AND t.k = w.k + 1 JOIN ends e ON e.run = CASE WHEN t.run = 0 THEN 0 ELSE t.run - 1 END)
"""


def _ingested(f):
    landed = f.sql("SELECT * FROM (" + _landed_text(SparkWords) + ")")

    def start(stream, base, run):
        IN.write_kinds(IN.ingest_once(IN.gated_items(stream), "id"), f"{base}/table", f"{base}/state").awaitTermination()

    return f.spark.read.parquet(f"{_in_runs(f, landed, INGEST_RUNS, 'ingest', start)}/table")


@job("str01_incremental_ingest", INGEST_CHECK + "SELECT id, url_hash FROM walk JOIN turns USING (url_hash, k, id) WHERE passed")
def _(f):
    return _ingested(f).where("kind = 'items'").select("id", "url_hash")


@job("str02_late_side_table", INGEST_CHECK + "SELECT id, kind FROM gated WHERE kind = 'late'")
def _(f):
    return _ingested(f).where("kind = 'late'").select("id", F.col("kind").cast("string").alias("kind"))


@job("str02_late_rows", f"""
SELECT item_id FROM (SELECT *, {ISO_TS} AS ts FROM raw_items) WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-14'
""", "raw_items")
def _(f):
    return IN.split_late(f.raw_items, GATE)[1].select("item_id")


@job("str05_previous_values", """
SELECT s_suppkey AS key, s_acctbal AS value, CAST(s_suppkey % 40 AS DOUBLE) AS hours FROM supplier WHERE s_suppkey % 40 <= 24 AND s_nationkey >= 5
""")
def _(f):
    s = f.supplier.select(
        F.col("s_suppkey").alias("state_key"), F.when(F.col("s_nationkey") < 5, "oi").otherwise("price").alias("state_kind"),
        F.col("s_acctbal").alias("numeric_value"), F.timestamp_add("HOUR", -(F.col("s_suppkey") % 40), T.wall(NOW)).alias("updated_at"))
    return IN.previous_values(s, "price", NOW, 24)


@job("str06_recent_reference", """
SELECT id FROM news_events WHERE time_get_data >= TIMESTAMP '2024-01-26' - INTERVAL 96 HOUR
""", "news_events")
def _(f):
    return IN.recent_reference(f.news_events, "2024-01-26 00:00:00", 96).select("id")


WINDOW_RUNS = 5
_EVENT_RUN = "CAST(floor((day(ts) - 1) / 6) + CASE WHEN event_id % 50 = 0 AND day(ts) < 25 THEN 1 ELSE 0 END AS INT)"


@job("str07_streamed_windows", f"""
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, {_EVENT_RUN} AS run FROM events),
t AS (SELECT run, max(max(ts)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM e GROUP BY run),
b AS (SELECT time_bucket(INTERVAL 12 HOUR, e.ts, TIMESTAMP '2024-01-01') AS start, t.top - INTERVAL 1 DAY AS mark
      FROM e LEFT JOIN t ON t.run = e.run - 1)
SELECT CAST(epoch(start) AS BIGINT) AS run_start, count(*) AS events FROM b
WHERE (mark IS NULL OR start + INTERVAL 12 HOUR > mark) AND start + INTERVAL 12 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 DAY GROUP BY 1
""")
def _(f):
    """Six days a run; one event in fifty lands a run late. Windows that the watermark has closed take no more events."""
    rows = f.events.select(_instant(F.col("ts")).alias("ts"), F.expr(_EVENT_RUN).alias("run"))

    def start(stream, base, run):
        IN.closed_windows(stream, f"{base}/table", f"{base}/state").awaitTermination()

    out = f.spark.read.parquet(f"{_in_runs(f, rows, WINDOW_RUNS, 'windows', start)}/table")
    return out.select(F.unix_seconds("run_start").alias("run_start"), "events")


@job("str05_previous_stream", """
WITH e AS (SELECT user_id, value, ts, CAST(floor((day(ts) - 1) / 6) AS INT) AS run FROM events),
l AS (SELECT user_id, run, max(ts) AS ts, arg_max(value, ts) AS value FROM e GROUP BY ALL),
p AS (SELECT *, lag(value) OVER w AS was, lag(ts) OVER w AS was_ts FROM l WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS at_us, value, CASE WHEN epoch_us(ts) - epoch_us(was_ts) <= 120 * 3600000000 THEN was END AS previous FROM p
""")
def _(f):
    """The last value of each user in each run beside the one stored before it, if at most five days old."""
    rows = f.events.select("user_id", "value", _instant(F.col("ts")).alias("ts"), F.expr("CAST(floor((day(ts) - 1) / 6) AS INT)").alias("run"))

    def start(stream, base, run):
        IN.with_previous(stream, "user_id", "value", "ts", f"{base}/store", f"{base}/table", f"{base}/state", 120).awaitTermination()

    out = f.spark.read.parquet(f"{_in_runs(f, rows, WINDOW_RUNS, 'previous', start)}/table")
    return out.select("user_id", F.unix_micros("ts").alias("at_us"), "value", "previous")


_REFERENCE = """SELECT doc_id AS id, 'fp' || CAST(CAST(floor(doc_id / 5) AS BIGINT) AS STRING) AS fp, CAST(floor((doc_id * 37 % 720) / 144) AS INT) AS run,
  {ts} AS at FROM documents"""


@job("str06_reference_stream", f"""
WITH d AS ({_REFERENCE.format(ts=DuckWords.add_hours(DuckWords.ts("2024-01-01 00:00:00"), "doc_id * 37 % 720"))})
SELECT a.id, b.id AS ref_id, a.fp FROM d AS a JOIN d AS b ON a.fp = b.fp AND b.at < a.at AND b.at >= a.at - INTERVAL 72 HOUR
""")
def _(f):
    """Events met by earlier ones of the same fingerprint within 72 hours, both sides as streams over five runs."""
    rows = f.sql(_REFERENCE.format(ts=SparkWords.add_hours(SparkWords.ts("2024-01-01 00:00:00"), "doc_id * 37 % 720")))
    rows = rows.select("id", "fp", _instant(F.col("at")).alias("ts"), "run")

    def start(stream, base, run):
        again = f.spark.readStream.schema(rows.drop("run").schema).parquet(f"{base}/in")
        IN.reference_pairs(stream, again, "fp").writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(
            availableNow=True).start(f"{base}/table").awaitTermination()

    return f.spark.read.schema("id bigint, ref_id bigint, fp string").parquet(f"{_in_runs(f, rows, WINDOW_RUNS, 'reference', start)}/table")


SIGNAL_RUNS = 4
_SIGNALS = """SELECT 'price_move:C' || CAST(o_custkey AS STRING) AS key,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'liquidation' WHEN o_orderpriority LIKE '4%' THEN 'funding_extreme' ELSE 'price_move' END AS kind,
  floor(o_totalprice / 100) / 100 AS magnitude, {at} AS stamp, CAST(floor((year(o_orderdate) - 1995) * 4 / 6) AS INT) AS run FROM orders WHERE o_orderdate < DATE '2001-01-01'"""
_AT = "(CAST(dayofyear(o_orderdate) AS BIGINT) * 3 + o_orderkey % 24)"


def _signal_text(w):
    """Orders as signals over four runs; days are pressed to three hours, so that keys come again inside their cooldown."""
    return _SIGNALS.format(at=w.add_hours(w.ts("2024-01-01 00:00:00"), f"{_AT} + (year(o_orderdate) - 1995) * 1200"))


SIGNAL_CHECK = f"""
WITH RECURSIVE s AS ({_signal_text(DuckWords)}),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stamp, magnitude) AS k FROM s),
walk AS (
  SELECT key, k, kind, magnitude, stamp, true AS passed, round(magnitude, 4) AS m, stamp AS t FROM o WHERE k = 1
  UNION ALL
  SELECT key, k, kind, magnitude, stamp, ok, CASE WHEN ok THEN round(magnitude, 4) ELSE m END, CASE WHEN ok THEN stamp ELSE t END
  FROM (SELECT o.*, w.m, w.t, epoch(o.stamp - w.t) / 3600 >= {{cool}} OR CASE WHEN o.kind = 'liquidation' THEN w.m <= 0 OR o.magnitude >= w.m * 1.5 ELSE o.magnitude >= w.m + 8 END AS ok
        FROM walk w JOIN o ON o.key = w.key AND o.k = w.k + 1))
""".replace("{cool}", "CASE o.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.COOLDOWN_HOURS.items()) + " ELSE 12 END")


def _cooled(f):
    rows = f.sql(_signal_text(SparkWords))
    rows = rows.select("key", "kind", "magnitude", _instant(F.col("stamp")).alias("at"), "run")

    def start(stream, base, run):
        cooldown_batches(stream, f"{base}/store", f"{base}/table", f"{base}/state").awaitTermination()

    return _in_runs(f, rows, SIGNAL_RUNS, "cooldown", start)


@job("str03_cooldown_stream", SIGNAL_CHECK + "SELECT key, kind, magnitude, CAST(epoch(stamp) AS BIGINT) AS at_s FROM walk WHERE passed")
def _(f):
    """Signals that the running cooldown lets out, over four runs."""
    out = f.spark.read.parquet(f"{_cooled(f)}/table")
    return out.select("key", "kind", "magnitude", F.unix_seconds("at").alias("at_s"))


@job("str04_cooldown_state", SIGNAL_CHECK + """SELECT key, m AS magnitude, CAST(epoch(t) AS BIGINT) AS at_s
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC) AS r FROM walk) WHERE r = 1 AND t + INTERVAL 30 DAY > (SELECT max(stamp) FROM s) - INTERVAL 1 HOUR
""")
def _(f):
    """What the running cooldown still holds after four runs: keys older than thirty days were cleared."""
    state = batch_state(f.spark, f"{_cooled(f)}/store")
    return state.select("key", "magnitude", F.expr("at_ms DIV 1000").alias("at_s"))


COMMIT_RUNS = 4
_STAGED = "SELECT id, source, title, deferred_count, defer_reason, CAST(id % 4 AS INT) AS run FROM staging WHERE consumed_at IS NULL"


@job("str08_idempotent_commit", """
SELECT id, CASE WHEN consumed_at IS NOT NULL OR id % 13 <> 0 THEN 1 ELSE 0 END AS consumed,
  deferred_count + CASE WHEN consumed_at IS NULL AND id % 13 = 0 THEN 1 ELSE 0 END AS deferred_count,
  CASE WHEN consumed_at IS NULL AND id % 13 = 0 THEN 'budget' ELSE defer_reason END AS defer_reason,
  CASE WHEN consumed_at IS NULL THEN 1 ELSE 0 END AS stored FROM staging
""", "staging")
def _(f):
    """Four runs over the open queue; the second and third die between write and record and are replayed.

    ``stored`` counts an item's rows in recorded batches: one, however often its batch ran.
    """
    queue, died = f.staging, set()

    def dies_once(batch_id):
        if batch_id in (1, 2) and batch_id not in died:
            died.add(batch_id)
            raise RuntimeError("the run ended before its record")

    def start(stream, base, run):
        for _ in range(3):
            query = CM.commit_stream(stream, f"{base}/table", f"{base}/ledger", f"{base}/state", dies_once)
            try:
                query.awaitTermination()
                return
            except StreamingQueryException:
                if not died:
                    raise
        raise RuntimeError("the batch could not be replayed")

    rows = f.sql(_STAGED, "staging")
    base = _in_runs(f, rows, COMMIT_RUNS, "commit", start)
    done = CM.committed(f.spark, f"{base}/table", f"{base}/ledger", rows.drop("run").schema)
    deferred = done.where("id % 13 = 0").select("id", F.lit("budget").alias("defer_reason"))
    marked = CM.mark_consumed(queue, done, deferred, T.wall(NOW))
    counts = done.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("n"))
    return marked.join(counts, F.col("id") == F.col("_id"), "left").select(
        "id", F.col("consumed_at").isNotNull().cast("int").alias("consumed"), "deferred_count", "defer_reason", F.coalesce("n", F.lit(0)).cast("int").alias("stored"))
