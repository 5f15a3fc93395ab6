"""Table maintenance: re-scoring, snapshots, purges, clock shifts, back links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scores as S
from ..functions import text as X
from ..functions import times as T
from .dedup import link_posts
from .filters import all_aggregated
from .score import with_move

MUTATED = ["score_breadth", "score_punch", "punch_magnitude_pct", "score_authority", "importance_score", "scoring_version"]


def rescore(events: DataFrame, price_move: str | None = None) -> DataFrame:
    """Breadth, punch and total recomputed; stored impact, time, heat, authority and quality kept.

    Stored factors are short fractions, so totals often end in a half of the fourth digit: it goes up.
    """
    c = F.col
    pct = c("pct")
    b = S.breadth(c("breadth_level"))
    i = S.punch(pct, c("title_zh"), c("title_en"), c("description_short_zh"), c("sources"))
    part = lambda name: F.coalesce(name, F.lit(0.0))
    total = X.round_settled(S.weighted_total({"M": part("score_market_impact"), "B": b, "T": part("score_timeliness"), "I": i,
                                      "H": part("score_hotness"), "A": part("score_authority"), "Q": part("score_quality")}), 4)
    return with_move(events.where("score_market_impact IS NOT NULL"), price_move).select(
        "id", "date", F.round(b, 4).alias("score_breadth"), F.round(i, 4).alias("score_punch"), pct.alias("punch_magnitude_pct"),
        F.round(part("score_authority"), 4).alias("score_authority"), total.alias("importance_score"),
        F.lit(D.SCORING_VERSION).alias("scoring_version"), c("importance_score").alias("old_importance"))


def rescore_report(rescored: DataFrame, events: DataFrame, now, top: int = 20, days: int = 5) -> DataFrame:
    """Dry run: rows, rows whose total changes, and how many of the first twenty are swapped."""
    recent = F.col("date") >= F.date_sub(T.wall(now).cast("date"), days)
    after = rescored.where(recent).orderBy(F.col("importance_score").desc(), F.col("id").desc()).limit(top).select("id")
    before = events.where(recent).orderBy(F.col("importance_score").desc(), F.col("id").desc()).limit(top).select("id")
    swapped = after.join(before, "id", "left_anti").agg(F.count("*").alias("swapped"))
    changed = F.abs(F.coalesce("old_importance", F.lit(0.0)) - F.col("importance_score")) > 1e-4
    return rescored.agg(F.count("*").alias("rows"), F.count_if(changed).alias("changed")).crossJoin(swapped)


def snapshot(events: DataFrame, batch: str) -> DataFrame:
    """The columns a re-score touches, under a batch name; append it to the backup table."""
    return events.where("score_market_impact IS NOT NULL").select(F.lit(batch).alias("batch"), "id", *[
        c for c in MUTATED if c in events.columns])


def restore(events: DataFrame, backup: DataFrame, batch: str) -> DataFrame:
    cols = [c for c in MUTATED if c in backup.columns]
    b = backup.where(F.col("batch") == batch).select(F.col("id").alias("_b"), *[F.col(c).alias(f"_{c}") for c in cols])
    j = events.join(b, F.col("id") == F.col("_b"), "left")
    for c in cols:
        j = j.withColumn(c, F.when(F.col("_b").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    return j.drop("_b", *[f"_{c}" for c in cols])


def purge_untrusted(events: DataFrame, include_top: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, backup): events that only aggregators report go to the backup; S and A stay unless asked."""
    lone = all_aggregated(F.col("sources"))
    if not include_top:
        lone &= ~F.coalesce(F.col("event_tier").isin("S", "A"), F.lit(False))
    return events.where(~lone), events.where(lone)


def shift_clock(table: DataFrame, hours: int, event_columns: list[str], system_columns: list[str], boundary,
                marker: DataFrame, name: str, date_from: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(shifted table, marker table): event times move on all rows, system stamps before the boundary.

    A row ``name`` in the marker table makes a second run a no-op; the date is taken anew from the
    shifted event time.
    """
    done = F.broadcast(marker.where(F.col("name") == name).agg((F.count("*") > 0).alias("_done")))
    out = table.crossJoin(done)
    move = lambda c: F.timestamp_add("HOUR", F.lit(hours), F.col(c))
    for c in event_columns:
        out = out.withColumn(c, F.when(~F.col("_done"), move(c)).otherwise(F.col(c)))
    for c in system_columns:
        out = out.withColumn(c, F.when(~F.col("_done") & (F.col(c) < T.wall(boundary)), move(c)).otherwise(F.col(c)))
    if date_from:
        out = out.withColumn("date", F.when(~F.col("_done") & F.col(date_from).isNotNull(), F.col(date_from).cast("date"))
                             .otherwise(F.col("date")))
    mark = marker.unionByName(marker.sparkSession.range(1).select(F.lit(name).alias("name"))).distinct()
    return out.drop("_done"), mark


def relink_posts(posts: DataFrame, events: DataFrame) -> DataFrame:
    """All posts linked again from the sources of all events."""
    return link_posts(posts.drop("news_event_id"), events)


def vector_requests(events: DataFrame) -> DataFrame:
    """Rows without a vector and the text to compute one from."""
    text = F.concat(F.coalesce("title_en", F.lit("")), F.lit(". "), F.coalesce("description_short_en", F.lit("")))
    return events.where("embedding IS NULL").select("id", F.substring(text, 1, 1000).alias("text"))
