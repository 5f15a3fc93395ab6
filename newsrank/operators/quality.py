"""Data quality rules: each returns the offending rows or one row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scores as S
from ..functions import times as T
from .analytics import run_nodes
from .filters import all_aggregated


def repeated_fingerprints(events: DataFrame) -> DataFrame:
    return events.where(F.coalesce("event_fingerprint", F.lit("")) != "").groupBy("event_fingerprint").agg(
        F.count("*").alias("n")).where("n > 1")


def range_and_null_counts(events: DataFrame, now, days: int = 2) -> DataFrame:
    recent = F.coalesce(F.col("time_get_data") >= F.timestamp_add("DAY", F.lit(-days), T.wall(now)), F.lit(False))
    bad = F.col("importance_score").isNull() | ~F.col("importance_score").between(0, 1)
    return events.agg(F.count_if(bad).alias("bad_score"), F.count_if(F.col("sectors").isNull()).alias("no_sectors"),
                      F.count_if(recent & F.col("verification_status").isNull()).alias("recent_unverified"),
                      F.count_if(recent & (F.coalesce("description_short_zh", F.lit("")) == "")).alias("recent_no_text"))


def formula_mismatches(events: DataFrame, newest: int = 300, tolerance: float = 0.01, breadth: str = "score_breadth") -> DataFrame:
    """Newest rows of the current version whose stored total is not the weighted sum of their factors."""
    current = events.where((F.col("scoring_version") == D.SCORING_VERSION) & F.col("score_market_impact").isNotNull()).orderBy(F.col("time_get_data").desc(), "id").limit(newest)
    part = lambda c: F.coalesce(c, F.lit(0.0))
    total = S.weighted_total({"M": part("score_market_impact"), "B": part(breadth), "T": part("score_timeliness"),
                              "I": part("score_punch"), "H": part("score_hotness"), "A": part("score_authority"),
                              "Q": part("score_quality")})
    return current.withColumn("expected", total).where(F.abs(F.col("importance_score") - F.col("expected")) > tolerance)


def version_lag(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if((F.coalesce("scoring_version", F.lit(0)) < D.SCORING_VERSION)
                                 & F.col("score_market_impact").isNotNull()).alias("behind"))


def run_bucket_cover(events: DataFrame) -> DataFrame:
    """Rows in the run buckets against all rows that have a fetch time."""
    inside = run_nodes(events).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("in_buckets"))
    return inside.crossJoin(events.agg(F.count("time_get_data").alias("rows"))).withColumn(
        "ok", F.col("in_buckets") == F.col("rows"))


def entity_count_mismatches(events: DataFrame) -> DataFrame:
    size = F.coalesce(F.size("tradable_entities"), F.lit(0))
    n = F.coalesce("tradable_count", F.lit(0))
    return events.where((n > size) | ((n > 0) & (size <= 0)))


def excluded_or_stale(events: DataFrame, now, dated: str = "date", disabled: tuple[str, ...] = D.DISABLED_SOURCES) -> DataFrame:
    """Counts: excluded-market titles of 7 days, events dated a week before fetch, disabled sources, lone aggregators."""
    week = F.coalesce(F.col("date") >= F.date_sub(T.wall(now).cast("date"), 7), F.lit(False))
    stale = F.datediff(F.col("time_get_data").cast("date"), F.col(dated).cast("date")) > 7
    return events.agg(
        F.count_if(week & (F.coalesce("title_zh", F.lit("")).rlike(D.EXCLUDED_MARKET)
                           | F.col("market_scope").eqNullSafe("cn_a_share"))).alias("excluded_titles"),
        F.count_if(F.coalesce(stale, F.lit(False))).alias("stale_events"),
        F.count_if(F.exists("source_names", lambda n: n.isin(*disabled))).alias("disabled_sources"),
        F.count_if((F.size("sources") == 1) & all_aggregated(F.col("sources"))).alias("lone_aggregators"))


def backlog_age(staged: DataFrame, runs: DataFrame, now, days: int = 3) -> DataFrame:
    old = staged.agg(F.count_if(F.col("consumed_at").isNull() & (F.col("fetched_at") < F.timestamp_add(
        "DAY", F.lit(-days), T.wall(now)))).alias("open_too_long"))
    return old.crossJoin(runs.agg(F.max_by("status", "run_at").alias("last_status")))


def rank_parity(lab: DataFrame, production: DataFrame, top: int = 10, need: int = 9) -> DataFrame:
    """Equal positions among the first ten of two rankings (rank, id)."""
    a = lab.where(F.col("rank") <= top).select("rank", F.col("id").alias("a"))
    b = production.where(F.col("rank") <= top).select(F.col("rank").alias("_r"), F.col("id").alias("b"))
    return a.join(b, F.col("rank") == F.col("_r")).agg(F.count_if(F.col("a") == F.col("b")).alias("equal")).withColumn(
        "ok", F.col("equal") >= need)
