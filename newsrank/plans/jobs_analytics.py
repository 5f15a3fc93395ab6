"""Jobs over monitoring, quality and run nodes (AGG, DQ, STR7)."""

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import analytics as A
from ..operators import quality as Q
from .registry import job
from .views import NOW


def runs(f):
    """Order days as rounds: counts, seconds, status and cost."""
    return f.orders.groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("run_at")).agg(
        F.count("*").alias("events_count"), (F.round(F.sum("o_totalprice") / 10000, 2)).alias("duration_seconds"),
        F.when(F.count_if(F.col("o_orderstatus") == "P") * 2 > F.count("*"), "error").otherwise("success").alias("status"),
        F.round(F.sum("o_totalprice") / 1e6, 4).alias("estimated_cost_usd"))


RUNS = """runs AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS run_at, count(*) AS events_count,
  round(sum(o_totalprice) / 10000, 2) AS duration_seconds,
  CASE WHEN count(*) FILTER (o_orderstatus = 'P') * 2 > count(*) THEN 'error' ELSE 'success' END AS status,
  round(sum(o_totalprice) / 1e6, 4) AS estimated_cost_usd FROM orders GROUP BY 1)"""


@job("agg01_staging_level", """
SELECT count(*) AS total, count(*) FILTER (consumed_at IS NULL) AS unconsumed,
  count(*) FILTER (fetched_at >= TIMESTAMP '2024-01-30') AS fetched_24h,
  round(floor(date_diff('second', min(fetched_at) FILTER (consumed_at IS NULL), TIMESTAMP '2024-01-31') / 60) / 60, 1)
    AS oldest_unconsumed_hours FROM staging
""", "staging")
def _(f):
    return A.staging_level(f.staging, "2024-01-31 00:00:00")


@job("agg01_backlog_by_priority", "SELECT priority, count(*) AS rows FROM staging WHERE consumed_at IS NULL GROUP BY priority", "staging")
def _(f):
    return A.backlog_by_priority(f.staging)


@job("agg02_throughput", f"""
WITH {RUNS}, top AS (SELECT * FROM runs ORDER BY run_at DESC LIMIT 6)
SELECT round(avg(events_count) FILTER (status = 'success'), 1) AS avg_events_per_run,
  round(avg(duration_seconds) FILTER (status = 'success'), 1) AS avg_duration_s,
  round(1 - avg(CASE WHEN status = 'success' THEN 1 ELSE 0 END), 3) AS failure_rate FROM top
""")
def _(f):
    return A.throughput(runs(f))


@job("agg02_recent_runs", f"""
WITH {RUNS} SELECT strftime(run_at, '%Y-%m-%d') AS run_at, events_count,
  round(events_count / greatest(duration_seconds / 60, 0.01), 1) AS events_per_min FROM runs ORDER BY run_at DESC LIMIT 6
""")
def _(f):
    return A.recent_runs(runs(f)).select(F.date_format("run_at", "yyyy-MM-dd").alias("run_at"), "events_count", "events_per_min")


@job("agg03_scope_buckets", """
WITH t AS (SELECT CASE WHEN market_scope = 'crypto' THEN 'crypto' WHEN market_scope IS NOT NULL THEN 'non_crypto' END AS bucket,
  event_tier IN ('S', 'A') AS sa, COALESCE(date >= DATE '2024-01-25', false) AS week FROM news_events),
u AS (SELECT 'overall' AS bucket, sa, week FROM t UNION ALL SELECT * FROM t WHERE bucket IS NOT NULL)
SELECT bucket, count(*) AS total, count(*) FILTER (sa) AS effective_sa, count(*) FILTER (week) AS recent_7d,
  count(*) FILTER (sa AND week) AS recent_7d_sa, round(count(*) FILTER (sa) / count(*), 4) AS effective_rate FROM u GROUP BY bucket
""", "news_events")
def _(f):
    return A.scope_buckets(f.news_events, NOW)


@job("agg03_scopes_7d", """
SELECT COALESCE(market_scope, '(none)') AS scope, count(*) AS events, count(*) FILTER (event_tier IN ('S', 'A')) AS sa
FROM news_events WHERE date >= DATE '2024-01-25' GROUP BY 1
""", "news_events")
def _(f):
    return A.scopes_7d(f.news_events, NOW)


@job("agg04_factor_coverage", """
SELECT count(*) AS total, count(breadth_level) AS breadth_tagged, count(score_punch) AS punch_scored,
  round(count(breadth_level) / count(*), 4) AS breadth_pct, round(count(score_punch) / count(*), 4) AS punch_pct FROM news_events
""", "news_events")
def _(f):
    return A.factor_coverage(f.news_events)


@job("agg05_stall_verdict", """
SELECT CASE WHEN h >= 3 THEN 'down' WHEN h >= 1.5 THEN 'warn' ELSE 'ok' END AS verdict, h AS hours_since_last_event, backlog,
  h >= 1.5 AND backlog > 2000 AS backlog_growing_while_idle
FROM (SELECT round(floor(date_diff('second', max(time_get_data), TIMESTAMP '2024-02-01') / 60) / 60, 1) AS h FROM news_events),
  (SELECT count(*) FILTER (consumed_at IS NULL) AS backlog FROM staging)
""", "news_events staging")
def _(f):
    return A.stall_verdict(f.news_events, f.staging, NOW)


@job("agg06_events_per_source", """
SELECT name, count(*) AS events FROM (SELECT unnest(source_names) AS name FROM news_events) GROUP BY name
""", "news_events")
def _(f):
    return A.events_per_source(f.news_events)


@job("agg07_last_runs", f"""
WITH {RUNS} SELECT strftime(run_at, '%Y-%m-%d') AS run_at, events_count, duration_seconds, status FROM runs
ORDER BY run_at DESC LIMIT 20
""")
def _(f):
    return runs(f).orderBy(F.col("run_at").desc()).limit(20).select(
        F.date_format("run_at", "yyyy-MM-dd").alias("run_at"), "events_count", "duration_seconds", "status")


@job("agg08_token_cost", """
WITH p AS (SELECT event_type AS model, CAST(user_id AS DOUBLE) AS pi, CAST(user_id AS DOUBLE) / 10 AS pc, CAST(user_id AS DOUBLE) * 6 AS po
  FROM (SELECT event_type, count(DISTINCT user_id) AS user_id FROM events WHERE event_type <> 'error' GROUP BY event_type)),
u AS (SELECT event_type AS model, sum(user_id * 1000) AS i, sum(user_id * 300) AS c, sum(user_id * 50) AS o FROM events GROUP BY 1),
c AS (SELECT u.model, CASE WHEN u.model = 'signup' THEN i * COALESCE(p.pi, d.pi) ELSE greatest(0, i - c) * COALESCE(p.pi, d.pi)
  + c * COALESCE(p.pc, d.pc) + o * COALESCE(p.po, d.po) END / 1e6 AS cost
  FROM u LEFT JOIN p ON u.model = p.model CROSS JOIN (SELECT * FROM p WHERE model = 'click') AS d)
SELECT model, round(cost, 6) AS cost_usd FROM c UNION ALL SELECT 'total', round(sum(cost), 6) FROM c
""")
def _(f):
    usage = f.events.select(F.col("event_type").alias("model"), (F.col("user_id") * 1000).alias("input"),
                            (F.col("user_id") * 300).alias("cached"), (F.col("user_id") * 50).alias("output"))
    n = F.countDistinct("user_id").cast("double")
    prices = f.events.where("event_type != 'error'").groupBy(F.col("event_type").alias("model")).agg(
        n.alias("input_price"), (n / 10).alias("cached_price"), (n * 6).alias("output_price"))
    return A.token_cost(usage, prices, "click", "signup").select("model", "cost_usd")


@job("agg09_usage_summary", f"""
WITH {RUNS} SELECT count(*) AS runs, count(*) FILTER (status = 'success') AS success, round(sum(estimated_cost_usd), 4) AS cost_usd,
  round(sum(estimated_cost_usd) / d, 4) AS daily_cost_usd, round(sum(estimated_cost_usd) / d * 30, 4) AS monthly_cost_usd
FROM runs, (SELECT greatest(0.1, date_diff('second', min(run_at), max(run_at)) / 86400.0) AS d FROM runs) GROUP BY d
""")
def _(f):
    return A.usage_summary(runs(f))


@job("agg10_tool_runs", """
SELECT COALESCE(json_extract_string(props, '$.k'), 'unknown') AS tool, count(*) AS runs FROM events
WHERE event_type = 'click' AND CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-12' GROUP BY 1
""")
def _(f):
    e = f.events.select("event_type", F.col("props").alias("meta"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return A.tool_runs(e, NOW, days=20, path="$.k", kind="click")


@job("agg11_backlog_view", """
SELECT backlog, deferred, urgent, cold, drained_24h, CASE WHEN drained_24h > 0 THEN round(backlog / (drained_24h / 24.0), 1) END
  AS hours_to_drain FROM (SELECT count(*) FILTER (o AND y) AS backlog, count(*) FILTER (o AND y AND deferred_count > 0) AS deferred,
  count(*) FILTER (o AND y AND priority <= 2) AS urgent, count(*) FILTER (o AND NOT y) AS cold,
  count(*) FILTER (consumed_at >= TIMESTAMP '2024-01-30') AS drained_24h
  FROM (SELECT *, consumed_at IS NULL AS o, fetched_at >= TIMESTAMP '2024-01-11' AS y FROM staging))
""", "staging")
def _(f):
    return A.backlog_view(f.staging, "2024-01-31 00:00:00", max_age_days=20)


@job("agg11_backlog_by_reason", """
SELECT COALESCE(defer_reason, 'none') AS part, count(*) AS rows FROM staging WHERE consumed_at IS NULL GROUP BY 1
""", "staging")
def _(f):
    return A.backlog_by(f.staging, F.coalesce("defer_reason", F.lit("none")))


@job("agg11_backlog_by_day", """
SELECT strftime(fetched_at, '%Y-%m-%d') AS part, count(*) AS rows FROM staging WHERE consumed_at IS NULL GROUP BY 1
""", "staging")
def _(f):
    return A.backlog_by(f.staging, F.date_format("fetched_at", "yyyy-MM-dd"))


@job("agg11_cache_totals", """
SELECT count(*) AS rows, count(*) FILTER (turn > 1) AS consumed, count(*) FILTER (role = 'user') AS current_prompt,
  round(count(*) FILTER (role = 'user') / count(*), 4) AS current_share FROM conversations
""")
def _(f):
    cache = f.conversations.select(F.col("role").alias("prompt_hash"), F.when(F.col("turn") > 1, F.col("turn")).alias("consumed_at"))
    return A.cache_totals(cache, "user")


@job("agg12_momentum", """
SELECT id, CASE WHEN time_event IS NOT NULL THEN round(social_interactions / greatest(1.0, date_diff('second', time_event, TIMESTAMP '2024-02-01') / 3600.0), 4) END AS momentum
FROM news_events
""", "news_events")
def _(f):
    return A.momentum(f.news_events, NOW)


@job("agg13_novelty", """
SELECT a.id, CASE WHEN a.embedding IS NULL OR a.time_event IS NULL THEN NULL
  ELSE round(1 - COALESCE(max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 0), 5) END AS novelty
FROM news_events AS a LEFT JOIN news_events AS b ON a.event_subject = b.event_subject AND b.embedding IS NOT NULL
  AND b.time_event < a.time_event AND b.time_event >= a.time_event - INTERVAL 30 DAY AND a.embedding IS NOT NULL
GROUP BY a.id, a.embedding, a.time_event
""", "news_events")
def _(f):
    return A.novelty(f.news_events).select("id", F.round("novelty", 5).alias("novelty"))


PERSONA = """results AS (SELECT c.conv_id * 100 + c.turn AS result_id, c.conv_id AS run_id, c.turn AS persona_id,
  CAST(1 + c.conv_id % 3 AS INT) AS persona_version, CAST(1 + length(c.text) % 10 AS INT) AS score, length(c.text) % 2 = 0 AS is_understandable,
  CAST(CASE WHEN l.quality = 1 THEN 8 WHEN l.quality = 0 THEN 3 END AS INT) AS human_score,
  CASE WHEN c.conv_id % 13 = 0 THEN 'timeout' END AS error, c.conv_id % 4 AS batch_uid, n_chars / 1000.0 AS importance_score
  FROM conversations AS c LEFT JOIN labels AS l ON l.doc_id = c.conv_id LEFT JOIN documents AS d ON d.doc_id = c.conv_id)"""


def results(f):
    return f.sql(f"""SELECT c.conv_id * 100 + c.turn AS result_id, c.conv_id AS run_id, c.turn AS persona_id,
        CAST(1 + c.conv_id % 3 AS INT) AS persona_version, CAST(1 + length(c.text) % 10 AS INT) AS score,
        length(c.text) % 2 = 0 AS is_understandable,
        CAST(CASE WHEN l.quality = 1 THEN 8 WHEN l.quality = 0 THEN 3 END AS INT) AS human_score,
        CASE WHEN c.conv_id % 13 = 0 THEN 'timeout' END AS error, c.conv_id % 4 AS batch_uid,
        CAST(d.n_chars AS DOUBLE) / 1000 AS importance_score
        FROM conversations AS c LEFT JOIN labels AS l ON l.doc_id = c.conv_id LEFT JOIN documents AS d ON d.doc_id = c.conv_id""")


BINS = ", ".join(f"count(*) FILTER (score = {k}) AS s{k}" for k in range(1, 11))
STATS = f"""count(*) FILTER (error IS NULL) AS n, round(avg(score) FILTER (error IS NULL), 2) AS mean_score,
  round(avg(CASE WHEN is_understandable THEN 1 ELSE 0 END) FILTER (error IS NULL), 3) AS understandable_rate,
  count(human_score) FILTER (error IS NULL) AS labelled, round(avg(abs(score - human_score)) FILTER (error IS NULL), 2) AS mae, {BINS}"""


@job("agg14_persona_stats", f"WITH {PERSONA} SELECT persona_id, {STATS} FROM results GROUP BY persona_id")
def _(f):
    return A.persona_stats(results(f))


@job("agg14_calibration_counts", """
SELECT conv_id % 5 AS persona_id, count(*) AS calibrations, count(*) FILTER (turn < 2) AS pending FROM conversations GROUP BY 1
""")
def _(f):
    c = f.conversations.select((F.col("conv_id") % 5).alias("persona_id"), F.when(F.col("turn") >= 2, F.col("turn")).alias("applied_version"))
    return A.calibration_counts(c)


@job("agg15_persona_versions", f"WITH {PERSONA} SELECT persona_id, persona_version, {STATS} FROM results GROUP BY persona_id, persona_version")
def _(f):
    return A.persona_stats(results(f), ["persona_id", "persona_version"])


@job("agg16_score_correlation", f"""
WITH {PERSONA} SELECT persona_id, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(score) > 0 AND stddev_pop(importance_score) > 0
  THEN round(corr(score, importance_score), 3) END AS correlation
FROM results WHERE error IS NULL AND importance_score IS NOT NULL GROUP BY persona_id
""")
def _(f):
    r = results(f)
    return A.score_correlation(r.drop("importance_score"), r.select("run_id", "importance_score").distinct())


@job("agg17_eval_runs", f"""
WITH {PERSONA}, page AS (SELECT DISTINCT run_id FROM results WHERE run_id IN (SELECT run_id FROM results WHERE persona_id = 2)
  ORDER BY run_id DESC LIMIT 50)
SELECT r.run_id, count(*) AS results, sum(score) AS total FROM results AS r JOIN page USING (run_id) GROUP BY r.run_id
""")
def _(f):
    r = results(f)
    runs_ = r.select("run_id", "batch_uid", F.col("run_id").alias("created_at")).distinct()
    return A.eval_runs(runs_, r, persona_id=2).select("run_id", F.size("results").cast("long").alias("results"), F.aggregate(
        "results", F.lit(0).cast("long"), lambda a, x: a + x["score"]).alias("total"))


@job("agg17_batch_summary", f"""
WITH {PERSONA} SELECT batch_uid, persona_id, count(*) AS n, round(avg(score), 2) AS mean_score FROM results WHERE error IS NULL
GROUP BY batch_uid, persona_id
""")
def _(f):
    r = results(f)
    return A.batch_summary(r.select("run_id", "batch_uid").distinct(), r.drop("batch_uid"))


@job("agg18_calibration_list", f"""
WITH {PERSONA} SELECT c.conv_id * 100 + c.turn AS calibration_id, r.score AS persona_score, 'run ' || CAST(r.run_id AS STRING) AS title
FROM conversations AS c LEFT JOIN results AS r ON r.result_id = c.conv_id * 100 + c.turn + 1 WHERE c.turn < 2
ORDER BY calibration_id DESC LIMIT 100
""")
def _(f):
    r = results(f)
    key = F.col("conv_id") * 100 + F.col("turn")
    c = f.conversations.select(key.alias("calibration_id"), (key + 1).alias("result_id"), key.alias("created_at"),
                               F.when(F.col("turn") >= 2, F.lit(1)).alias("applied_version"))
    titles = r.select("run_id", F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("title")).distinct()
    return A.calibration_list(c, r, titles, pending_only=True).select("calibration_id", "persona_score", "title")


@job("agg19_quality_summary", """
SELECT event_tier, count(*) AS n, round(avg(importance_score), 4) AS mean_importance, round(avg(credibility_score), 4) AS mean_credibility,
  round(avg(CASE WHEN is_rumor THEN 1 ELSE 0 END), 4) AS rumor_rate FROM news_events GROUP BY event_tier
""", "news_events")
def _(f):
    return A.quality_summary(f.news_events, ["event_tier"])


@job("agg20_verdict_tally", """
SELECT COALESCE(v, 'same') AS verdict, count(*) AS pairs, round(count(*) / (SELECT count(*) FROM documents), 4) AS rate
FROM (SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1
""")
def _(f):
    v = f.labels.select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("verdict"))
    return A.verdict_tally(f.documents.select(F.col("doc_id").alias("pair_id")), v)


@job("agg21_result_page", """
SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 40
""")
def _(f):
    e = f.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.col("ts").alias("created_at"))
    return A.result_page(e, "view", 100, 40)[0].select("id")


@job("agg22_list_from_events", """
SELECT id, title_zh AS title, array_to_string(source_names, ' / ') AS source FROM news_events
WHERE list_contains(sectors, 'EUROPE') AND date >= DATE '2024-01-05' AND date <= DATE '2024-01-20'
ORDER BY importance_score DESC, id LIMIT 30
""", "news_events")
def _(f):
    return A.list_from_events(f.news_events, "EUROPE", "2024-01-05", "2024-01-20").select("id", "title", "source")


@job("str07_run_nodes", """
SELECT strftime(CASE WHEN hour(t) >= 20 THEN date_trunc('day', t) + INTERVAL 20 HOUR WHEN hour(t) >= 8 THEN date_trunc('day', t) + INTERVAL 8 HOUR
  ELSE date_trunc('day', t) - INTERVAL 4 HOUR END, '%Y-%m-%d %H:%M:%S') AS run_at, count(*) AS events
FROM (SELECT time_get_data AS t FROM news_events) GROUP BY 1
""", "news_events")
def _(f):
    return A.run_nodes(f.news_events)


# --- quality rules ------------------------------------------------------------------------------

@job("dq01_repeated_fingerprints", """
SELECT event_fingerprint, count(*) AS n FROM news_events GROUP BY 1 HAVING count(*) > 1
""", "news_events")
def _(f):
    return Q.repeated_fingerprints(f.news_events)


@job("dq02_ranges_and_nulls", """
SELECT count(*) FILTER (importance_score IS NULL OR importance_score NOT BETWEEN 0 AND 1) AS bad_score,
  count(*) FILTER (sectors IS NULL) AS no_sectors, count(*) FILTER (r AND verification_status IS NULL) AS recent_unverified,
  count(*) FILTER (r AND description_short_zh = '') AS recent_no_text
FROM (SELECT *, time_get_data >= TIMESTAMP '2024-01-30' AS r FROM news_events)
""", "news_events")
def _(f):
    return Q.range_and_null_counts(f.news_events, NOW)


@job("dq03_formula_mismatches", """
SELECT id, round(e, 6) AS expected FROM (SELECT *, 0.26 * score_market_impact + 0.16 * 0.15 + 0.16 * score_timeliness
  + 0.14 * COALESCE(score_punch, 0) + 0.10 * score_hotness + 0.10 * score_authority + 0.08 * COALESCE(score_quality, 0) AS e FROM news_events
  WHERE scoring_version = 6 AND score_market_impact IS NOT NULL ORDER BY time_get_data DESC, id LIMIT 300)
WHERE abs(importance_score - e) > 0.01
""", "news_events")
def _(f):
    e = f.news_events.withColumn("score_breadth", F.lit(0.15))
    return Q.formula_mismatches(e).select("id", F.round("expected", 6).alias("expected"))


@job("dq04_version_lag", """
SELECT count(*) AS behind FROM news_events WHERE scoring_version < 6 AND score_market_impact IS NOT NULL
""", "news_events")
def _(f):
    return Q.version_lag(f.news_events)


@job("dq05_run_bucket_cover", "SELECT count(*) AS in_buckets, count(*) AS rows, true AS ok FROM news_events", "news_events")
def _(f):
    return Q.run_bucket_cover(f.news_events)


@job("dq06_entity_counts", """
SELECT id FROM news_events WHERE tradable_count > len(coins)
""", "news_events")
def _(f):
    return Q.entity_count_mismatches(f.news_events.withColumn("tradable_entities", F.col("coins"))).select("id")


@job("dq07_excluded_and_stale", """
SELECT count(*) FILTER (date >= DATE '2024-01-25' AND market_scope = 'cn_a_share') AS excluded_titles,
  count(*) FILTER (date_diff('day', CAST(event_date AS DATE), CAST(time_get_data AS DATE)) > 7) AS stale_events,
  count(*) FILTER (list_contains(source_names, 'src3')) AS disabled_sources,
  count(*) FILTER (len(sources) = 1 AND sources[1].type = 'web_search') AS lone_aggregators FROM news_events
""", "news_events")
def _(f):
    return Q.excluded_or_stale(f.news_events, NOW, "event_date", ("src3",))


@job("dq08_backlog_age", f"""
WITH {RUNS} SELECT (SELECT count(*) FROM staging WHERE consumed_at IS NULL AND fetched_at < TIMESTAMP '2024-01-29') AS open_too_long,
  (SELECT status FROM runs ORDER BY run_at DESC LIMIT 1) AS last_status
""", "staging")
def _(f):
    return Q.backlog_age(f.staging, runs(f), NOW)
