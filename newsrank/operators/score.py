"""The seven factors and the weighted total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scores as S
from ..functions import times as T
from .ordering import running_total


def social_baseline(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """(baseline): the value at index ``min(n-1, floor(0.95 n))`` of the sorted positive interactions.

    Values are counted first and their counts run up inside range partitions, so no task sorts all of them.
    """
    by = list(by)
    counts = events.where("social_interactions > 0").groupBy(*by, "social_interactions").agg(F.count("*").alias("k"))
    run = running_total(counts, by, "social_interactions", "k", "upto")
    whole = run.groupBy(*by).agg(F.sum("k").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in by], "n")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    run = run.join(whole, same) if by else run.crossJoin(F.broadcast(whole))           # without groups: one row
    run = run.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))
    return run.groupBy(*by).agg(F.greatest(F.coalesce(F.min("social_interactions").cast("double"), F.lit(D.SOCIAL_FLOOR)),
                                           F.lit(D.SOCIAL_FLOOR)).alias("baseline"))


def factor_columns(now, published: Column) -> dict[str, Column]:
    """The seven factors of an event row that carries ``baseline`` and the move ``pct``."""
    c = F.col
    return {
        "M": S.impact(c("score_market_impact"), c("event_tier")),
        "B": S.breadth(c("breadth_level")),
        "T": S.timeliness(published, T.wall(now)),
        "I": S.punch(c("pct"), c("title_zh"), c("title_en"), c("description_short_zh"), c("sources")),
        "H": S.hotness(c("social_interactions"), c("source_count"), c("baseline")),
        "A": S.authority(c("score_authority"), c("is_rumor"), c("verification_status")),
        "Q": S.quality(c("score_quality")),
    }


def with_move(events: DataFrame, price_move: str | None = None) -> DataFrame:
    """Add the move ``pct`` as a column of its own, so the rules that read it do not work it out again."""
    pm = F.col(price_move) if price_move else None
    return events.withColumn("pct", S.punch_pct(pm, F.col("title_zh"), F.col("title_en"), F.col("description_short_zh")))


def score_events(events: DataFrame, now, published: str = "time_event", price_move: str | None = None) -> DataFrame:
    """Scored events: seven factors with 4 digits, the move, the total of the unrounded factors, the version."""
    based = with_move(events, price_move).crossJoin(F.broadcast(social_baseline(events)))
    raw = based.select("id", "pct", *[col.alias(k) for k, col in factor_columns(now, F.col(published)).items()])
    names = {"M": "score_market_impact", "B": "score_breadth", "T": "score_timeliness", "I": "score_punch",
             "H": "score_hotness", "A": "score_authority", "Q": "score_quality"}
    return raw.select("id", *[F.round(k, 4).alias(n) for k, n in names.items()], F.col("pct").alias("punch_magnitude_pct"),
                      F.round(S.weighted_total({k: F.col(k) for k in names}), 4).alias("importance_score"),
                      F.lit(D.SCORING_VERSION).alias("scoring_version"))


def price_move_overturns(events: DataFrame, verdicts: DataFrame, now, days: int = 7) -> DataFrame:
    """Rows of the last days with a magnitude: how many are judged, and the share judged no move."""
    recent = events.where(F.col("punch_magnitude_pct").isNotNull()
                          & (F.col("date") >= F.date_sub(T.wall(now).cast("date"), days)))
    j = recent.join(verdicts.select(F.col("id").alias("_v"), "is_price_move"), F.col("id") == F.col("_v"), "left")
    return j.agg(F.count("*").alias("with_magnitude"), F.count("is_price_move").alias("judged"),
                 F.round(F.avg((~F.col("is_price_move")).cast("int")), 6).alias("overturned"))
