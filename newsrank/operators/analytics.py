"""Monitoring and analytics aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from .dedup import event_hours
from .similarity import nearest, vector_rows


def _day(now) -> Column:
    return T.wall(now).cast("date")


def staging_level(staged: DataFrame, now) -> DataFrame:
    open_ = F.col("consumed_at").isNull()
    return staged.agg(
        F.count("*").alias("total"), F.count_if(open_).alias("unconsumed"),
        F.count_if(F.col("fetched_at") >= F.timestamp_add("HOUR", F.lit(-24), T.wall(now))).alias("fetched_24h"),
        F.round(F.floor(T.seconds_between(T.wall(now), F.min(F.when(open_, F.col("fetched_at")))) / 60) / 60, 1)
        .alias("oldest_unconsumed_hours"))


def backlog_by_priority(staged: DataFrame) -> DataFrame:
    return staged.where("consumed_at IS NULL").groupBy("priority").agg(F.count("*").alias("rows"))


def recent_runs(runs: DataFrame, n: int = 6) -> DataFrame:
    top = runs.orderBy(F.col("run_at").desc()).limit(n)
    minutes = F.greatest(F.coalesce("duration_seconds", F.lit(1.0)) / 60, F.lit(0.01))
    return top.withColumn("events_per_min", F.round(F.coalesce("events_count", F.lit(0)) / minutes, 1))


def throughput(runs: DataFrame, n: int = 6) -> DataFrame:
    ok = F.col("status") == "success"
    return recent_runs(runs, n).agg(
        F.coalesce(F.round(F.avg(F.when(ok, F.col("events_count"))), 1), F.lit(0.0)).alias("avg_events_per_run"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("duration_seconds"))), 1), F.lit(0.0)).alias("avg_duration_s"),
        F.round(1 - F.avg(ok.cast("int")), 3).alias("failure_rate"))


def scope_buckets(events: DataFrame, now) -> DataFrame:
    """Overall, crypto and other totals with their S and A share and 7-day counts, in one pass.

    Each row counts for "overall" and for its own bucket through one grouping-set aggregate; rows
    without a scope count overall only.
    """
    bucket = F.when(F.col("market_scope") == "crypto", "crypto").when(F.col("market_scope").isNotNull(), "non_crypto")
    sa = F.col("event_tier").isin("S", "A")
    week = F.col("date") >= F.date_sub(_day(now), 7)
    rows = events.select(bucket.alias("bucket"), F.coalesce(sa, F.lit(False)).alias("sa"), F.coalesce(week, F.lit(False)).alias("week"))
    out = rows.rollup("bucket").agg(
        F.grouping("bucket").alias("whole"), F.count("*").alias("total"), F.count_if("sa").alias("effective_sa"),
        F.count_if("week").alias("recent_7d"), F.count_if(F.col("sa") & F.col("week")).alias("recent_7d_sa"))
    out = out.where("whole = 1 OR bucket IS NOT NULL").withColumn("bucket", F.when(F.col("whole") == 1, "overall")
                                                                 .otherwise(F.col("bucket")))
    return out.withColumn("effective_rate", F.round(F.col("effective_sa") / F.col("total"), 4)).drop("whole")


def scopes_7d(events: DataFrame, now) -> DataFrame:
    return events.where(F.col("date") >= F.date_sub(_day(now), 7)).groupBy(
        F.coalesce("market_scope", F.lit("(none)")).alias("scope")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_tier").isin("S", "A")).alias("sa"))


def factor_coverage(events: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.avg(F.col(c).isNotNull().cast("int")), F.lit(0.0)), 4)
    return events.agg(F.count("*").alias("total"), F.count("breadth_level").alias("breadth_tagged"),
                      F.count("score_punch").alias("punch_scored"), share("breadth_level").alias("breadth_pct"),
                      share("score_punch").alias("punch_pct"))


def stall_verdict(events: DataFrame, staged: DataFrame, now, created: str = "time_get_data") -> DataFrame:
    last = events.agg(F.max(created).alias("last")).crossJoin(staged.agg(F.count_if(F.col("consumed_at").isNull()).alias("backlog")))
    hours = F.coalesce(F.round(F.floor(T.seconds_between(T.wall(now), F.col("last")) / 60) / 60, 1), F.lit(999.0))
    verdict = F.when(hours >= 3, "down").when(hours >= 1.5, "warn").otherwise("ok")
    return last.select(verdict.alias("verdict"), hours.alias("hours_since_last_event"), "backlog",
                       ((verdict != "ok") & (F.col("backlog") > 2000)).alias("backlog_growing_while_idle"))


def events_per_source(events: DataFrame) -> DataFrame:
    return events.select(F.explode("source_names").alias("name")).groupBy("name").agg(F.count("*").alias("events"))


def token_cost(usage: DataFrame, prices: DataFrame, default_model: str, embedding_model: str) -> DataFrame:
    """Cost by model in dollars; a model without a price takes the default model's; the last row is the total."""
    p = prices.select(F.col("model").alias("_m"), "input_price", "cached_price", "output_price")
    fallback = prices.where(F.col("model") == default_model).select(
        F.col("input_price").alias("d_in"), F.col("cached_price").alias("d_cached"), F.col("output_price").alias("d_out"))
    total = usage.groupBy("model").agg(F.sum("input").alias("input"), F.sum("cached").alias("cached"), F.sum("output").alias("output"))
    j = total.join(p, F.col("model") == F.col("_m"), "left").crossJoin(F.broadcast(fallback))
    pi, pc, po = (F.coalesce(a, b) for a, b in (("input_price", "d_in"), ("cached_price", "d_cached"), ("output_price", "d_out")))
    chat = F.greatest(F.lit(0), F.col("input") - F.col("cached")) * pi + F.col("cached") * pc + F.col("output") * po
    cost = F.when(F.col("model") == embedding_model, F.col("input") * pi).otherwise(chat) / 1e6
    return j.withColumn("cost", cost).rollup("model").agg(F.round(F.sum("cost"), 6).alias("cost_usd")).withColumn(
        "model", F.coalesce("model", F.lit("total")))


def usage_summary(runs: DataFrame) -> DataFrame:
    days = F.greatest(F.lit(0.1), T.days_between(F.max("run_at"), F.min("run_at")))
    cost = F.sum("estimated_cost_usd")
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("success"),
                    F.round(cost, 4).alias("cost_usd"), F.round(cost / days, 4).alias("daily_cost_usd"),
                    F.round(cost / days * 30, 4).alias("monthly_cost_usd"))


def tool_runs(events: DataFrame, now, days: int = 30, path: str = "$.tool", kind: str = "tool_run") -> DataFrame:
    recent = events.where((F.col("event_type") == kind)
                          & (F.col("created_at") >= F.timestamp_add("DAY", F.lit(-days), T.wall(now))))
    return recent.groupBy(F.coalesce(F.get_json_object("meta", path), F.lit("unknown")).alias("tool")).agg(F.count("*").alias("runs"))


def cache_totals(cache: DataFrame, prompt_hash: str) -> DataFrame:
    mine = F.col("prompt_hash") == prompt_hash
    return cache.agg(F.count("*").alias("rows"), F.count("consumed_at").alias("consumed"),
                     F.count_if(mine).alias("current_prompt"), F.round(F.avg(mine.cast("int")), 4).alias("current_share"))


def backlog_view(staged: DataFrame, now, max_age_days: int = 30) -> DataFrame:
    """One row: open rows inside the age limit, deferred and urgent ones, cold rows, drained in 24 hours, hours to drain."""
    open_ = F.col("consumed_at").isNull()
    young = open_ & (F.col("fetched_at") >= F.timestamp_add("DAY", F.lit(-max_age_days), T.wall(now)))
    day = F.timestamp_add("HOUR", F.lit(-24), T.wall(now))
    out = staged.agg(
        F.count_if(young).alias("backlog"), F.count_if(young & (F.col("deferred_count") > 0)).alias("deferred"),
        F.count_if(young & (F.col("priority") <= 2)).alias("urgent"), F.count_if(open_ & ~young).alias("cold"),
        F.count_if(F.col("consumed_at") >= day).alias("drained_24h"))
    return out.withColumn("hours_to_drain", F.when(F.col("drained_24h") > 0, F.round(
        F.col("backlog") / (F.col("drained_24h") / 24.0), 1)))


def backlog_by(staged: DataFrame, key: Column) -> DataFrame:
    return staged.where("consumed_at IS NULL").groupBy(key.alias("part")).agg(F.count("*").alias("rows"))


def momentum(events: DataFrame, now, published: str = "time_event") -> DataFrame:
    """Interactions for each hour since publication (an hour at least)."""
    hours = F.greatest(F.lit(1.0), T.hours_between(T.wall(now), F.col(published)))
    return events.select("id", F.when(F.col(published).isNotNull(), F.round(
        F.coalesce("social_interactions", F.lit(0)) / hours, 4)).alias("momentum"))


def novelty(events: DataFrame, days: int = 30, published: str = "time_event", **kw) -> DataFrame:
    """One minus the best cosine with an earlier event of the same subject in the last thirty days.

    Null without a subject, a time or a vector; 1 when there is no such event. The join is cut by
    subject and time, and each task returns one best partner a row.
    """
    subject = F.lower(T.strip(F.coalesce("event_subject", F.lit(""))))
    rows = vector_rows(events.where((subject != "") & F.col(published).isNotNull()), "id", "embedding",
                       event_hours(F.col(published)), group=subject)
    best = nearest(rows, rows, -2.0, window_hours=days * 24.0, missing_time="block", past_only=True, **kw)
    j = events.select("id").join(rows.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left").join(
        best.select("a", "cosine"), F.col("id") == F.col("a"), "left")
    return j.select("id", F.when(F.col("_i").isNotNull(), F.coalesce(1 - F.col("cosine"), F.lit(1.0))).alias("novelty"))


# --- personas ------------------------------------------------------------------------------------------------

def persona_stats(results: DataFrame, by: list[str] = ("persona_id",)) -> DataFrame:
    """Count, mean, understandable share, labelled rows and error to the human score, with a 1-10 histogram."""
    ok = F.col("error").isNull()
    gap = F.abs(F.col("score") - F.col("human_score"))
    bins = [F.count_if(F.col("score") == k).alias(f"s{k}") for k in range(1, 11)]
    return results.groupBy(*by).agg(
        F.count_if(ok).alias("n"), F.round(F.avg(F.when(ok, F.col("score"))), 2).alias("mean_score"),
        F.round(F.avg(F.when(ok, F.col("is_understandable").cast("int"))), 3).alias("understandable_rate"),
        F.count_if(ok & F.col("human_score").isNotNull()).alias("labelled"), F.round(F.avg(F.when(ok, gap)), 2).alias("mae"), *bins)


def calibration_counts(calibrations: DataFrame) -> DataFrame:
    return calibrations.groupBy("persona_id").agg(F.count("*").alias("calibrations"),
                                                  F.count_if(F.col("applied_version").isNull()).alias("pending"))


def score_correlation(results: DataFrame, runs: DataFrame, min_rows: int = 5) -> DataFrame:
    """Pearson correlation of persona score and event importance; needs five rows and both to vary."""
    j = results.where("score IS NOT NULL AND error IS NULL").join(runs.where("importance_score IS NOT NULL").select(
        F.col("run_id").alias("_r"), "importance_score"), F.col("run_id") == F.col("_r"))
    g = j.groupBy("persona_id").agg(F.count("*").alias("n"), F.corr("score", "importance_score").alias("r"),
                                    F.stddev_pop("score").alias("a"), F.stddev_pop("importance_score").alias("b"))
    ok = (F.col("n") >= min_rows) & (F.col("a") > 0) & (F.col("b") > 0)
    return g.select("persona_id", "n", F.when(ok, F.round("r", 3)).alias("correlation"))


def eval_runs(runs: DataFrame, results: DataFrame, persona_id=None, batch_uid=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Runs newest first with their results nested, of one persona or one batch when asked."""
    rows = runs
    if persona_id is not None:
        rows = rows.join(results.where(F.col("persona_id") == persona_id).select("run_id"), "run_id", "left_semi")
    if batch_uid is not None:
        rows = rows.where(F.col("batch_uid") == batch_uid)
    page = rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).offset(offset).limit(limit)
    nested = results.join(page.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("persona_id", "score"))).alias("results"))
    return page.join(nested, "run_id", "left")


def batch_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    good = results.where("error IS NULL AND score IS NOT NULL")
    return good.join(runs.select("run_id", "batch_uid"), "run_id").groupBy("batch_uid", "persona_id").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean_score"))


def calibration_list(calibrations: DataFrame, results: DataFrame, runs: DataFrame, persona_id=None, pending_only: bool = False,
                     limit: int = 100) -> DataFrame:
    rows = calibrations
    if persona_id is not None:
        rows = rows.where(F.col("persona_id") == persona_id)
    if pending_only:
        rows = rows.where("applied_version IS NULL")
    top = rows.orderBy(F.col("created_at").desc(), F.col("calibration_id").desc()).limit(limit)
    r = results.select(F.col("result_id").alias("_r"), "run_id", F.col("score").alias("persona_score"))
    u = runs.select(F.col("run_id").alias("_u"), "title")
    return top.join(r, F.col("result_id") == F.col("_r"), "left").join(u, F.col("run_id") == F.col("_u"), "left").drop("_r", "_u")


def quality_summary(items: DataFrame, by: list[str] = ()) -> DataFrame:
    return items.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("importance_score"), 4).alias("mean_importance"),
                                  F.round(F.avg("credibility_score"), 4).alias("mean_credibility"),
                                  F.round(F.avg(F.col("is_rumor").cast("int")), 4).alias("rumor_rate"))


def verdict_tally(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Good, same and bad counts with their share; a pair without a verdict counts as same."""
    j = pairs.join(verdicts.select(F.col("pair_id").alias("_p"), "verdict"), F.col("pair_id") == F.col("_p"), "left")
    counts = j.groupBy(F.coalesce("verdict", F.lit("same")).alias("verdict")).agg(F.count("*").alias("pairs"))
    return counts.crossJoin(counts.agg(F.sum("pairs").alias("all"))).select(
        "verdict", "pairs", F.round(F.col("pairs") / F.col("all"), 4).alias("rate"))


def result_page(results: DataFrame, tool: str | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page newest first, total of the same predicate)."""
    rows = results if tool is None else results.where(F.col("tool") == tool)
    page = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(max(0, offset)).limit(max(1, min(limit, 100)))
    return page, rows.agg(F.count("*").alias("total"))


def list_from_events(events: DataFrame, sector: str | None = None, date_from: str | None = None, date_to: str | None = None,
                     sort: str = "importance", limit: int = 30) -> DataFrame:
    rows = events
    if sector:
        rows = rows.where(F.array_contains("sectors", sector))
    if date_from:
        rows = rows.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.where(F.col("date") <= F.lit(date_to).cast("date"))
    order = "importance_score" if sort == "importance" else "time_get_data"
    return rows.orderBy(F.col(order).desc(), "id").limit(min(limit, 30)).select(
        "id", F.coalesce("title_zh", "title_en").alias("title"), F.array_join(F.slice("source_names", 1, 2), " / ").alias("source"),
        "date")


def run_nodes(events: DataFrame, stamp: str = "time_get_data", limit: int | None = None) -> DataFrame:
    """Events by 12-hour run: buckets open at 08:00 and 20:00 of the wall clock, newest first."""
    shifted = F.timestamp_add("HOUR", F.lit(-8), F.col(stamp))
    start = F.timestamp_add("HOUR", F.lit(8) + F.floor(F.hour(shifted) / 12) * 12, F.to_date(shifted).cast("timestamp_ntz"))
    out = events.where(F.col(stamp).isNotNull()).groupBy(T.wall_text(start).alias("run_at")).agg(F.count("*").alias("events"))
    return out if limit is None else out.orderBy(F.col("run_at").desc()).limit(limit)
