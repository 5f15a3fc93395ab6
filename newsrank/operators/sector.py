"""Sector recommendation: events against every sector at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scores as S
from ..functions import text as X
from ..functions import times as T
from .dedup import event_hours
from .graph import cluster_of
from .score import social_baseline
from .similarity import similar_links, vector_rows


def candidates(events: DataFrame, now, hours: int = 72) -> DataFrame:
    when = F.coalesce("time_event", "time_get_data")
    return events.withColumn("published", when).where(
        F.col("published") >= F.timestamp_add("HOUR", F.lit(-hours), T.wall(now)))


def _has_word(text: Column, words: Column) -> Column:
    return F.coalesce(F.exists(words, lambda w: F.contains(text, F.lower(w))), F.lit(False))


def entity_hit(names: Column) -> Column:
    """1.0 a coin or an entity is a member, .8 a word in a title, .5 a word in a description, else 0.

    The row carries the sector's ``tickers`` and ``keywords`` arrays.
    """
    coins = F.transform(F.coalesce("coins", F.array().cast("array<string>")),
                        lambda c: F.regexp_replace(F.upper(T.strip(c)), r"^\$+", ""))
    title = F.lower(F.concat(F.coalesce("title_en", F.lit("")), F.lit(" "), F.coalesce("title_zh", F.lit(""))))
    body = F.lower(F.concat(F.coalesce("description_short_en", F.lit("")), F.lit(" "),
                            F.coalesce("description_short_zh", F.lit(""))))
    member = F.coalesce(F.arrays_overlap(coins, "tickers"), F.lit(False)) | F.coalesce(
        F.arrays_overlap(names, F.col("tickers")), F.lit(False))
    return F.when(member, 1.0).when(_has_word(title, F.col("keywords")), 0.8).when(
        _has_word(body, F.col("keywords")), 0.5).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, size(a) * size(b)), F.lit(0.0))


def prefilter(cands: DataFrame, sectors: DataFrame, threshold: float = 0.6, entities: str | None = None) -> DataFrame:
    """Every event against every sector (a table of about twenty rows): score and pass mark.

    ``sectors`` has sector, kind, tickers, keywords, anchor (vector).
    """
    names = F.transform(entities, lambda e: F.upper(T.strip(F.coalesce(e["name"], F.lit(""))))) if entities else (
        F.array().cast("array<string>"))
    j = cands.crossJoin(F.broadcast(sectors))
    semantic = F.when(F.col("embedding").isNotNull(), cosine(F.col("embedding"), F.col("anchor"))).otherwise(0.0)
    j = j.withColumn("semantic", semantic).withColumn("entity", entity_hit(names))
    score = F.lit(0.55) * F.greatest(F.lit(0.0), F.col("semantic")) + F.lit(0.45) * F.col("entity")
    return j.withColumn("prefilter_score", score).withColumn("passed", score >= threshold)


def relevance(kind: Column, tickers: Column) -> Column:
    """Relevance composed from a judgment row, held under the caps."""
    c = lambda name: X.clamp(F.coalesce(name, F.lit(0.0)))
    hit = F.coalesce("title_hit", F.lit(False))
    focus = X.clamp(c("focus_ratio") * F.when(hit, 1.5).otherwise(1.0))
    raw = X.clamp(F.lit(0.5) * c("entity_match") + F.lit(0.3) * c("semantic_sim") + F.lit(0.2) * focus)
    genre = X.lookup(D.GENRE_CAP, F.coalesce("content_genre", F.lit("EVENT")), 1.0)
    hops = F.coalesce("transmission_hops", F.lit(0))
    member = F.coalesce("is_constituent_anchor", F.lit(False))
    chain = (F.when(hops >= 2, 0.4).when((hops == 1) & ~member, F.when(kind == "chain", 0.4).otherwise(0.55)).otherwise(1.0))
    named = F.transform(F.coalesce("matched_tickers", F.array().cast("array<string>")),
                        lambda t: F.regexp_replace(F.upper(T.strip(t)), r"^\$+", ""))
    stray = ((F.size(tickers) > 0) & (F.size(named) > 0) & (F.size(F.array_intersect(named, tickers)) == 0)
             & (c("semantic_sim") < 0.5))
    return F.round(X.clamp(F.least(raw, genre, chain, F.when(F.coalesce(stray, F.lit(False)), 0.3).otherwise(1.0))), 4)


def gate_and_score(passed: DataFrame, judgments: DataFrame, pool: DataFrame, now, gate: float = 0.5) -> DataFrame:
    """Score of the candidates that passed: zero under the gate or without a judgment.

    The interaction baseline comes from the whole candidate pool, not from the rows that passed.
    """
    j = passed.join(judgments.select(F.col("candidate_id").alias("_c"), F.col("sector").alias("_s"), *[
        c for c in judgments.columns if c not in ("candidate_id", "sector")]),
        (F.col("id") == F.col("_c")) & (F.col("sector") == F.col("_s")), "left")
    j = j.withColumn("rel", F.when(F.col("_c").isNotNull(), relevance(F.col("kind"), F.col("tickers"))).otherwise(0.0))
    j = j.crossJoin(F.broadcast(social_baseline(pool)))
    t = S.timeliness(F.col("published"), T.wall(now))
    h = S.hotness(F.col("social_interactions"), F.col("source_count"), F.col("baseline"))
    a = S.authority(F.col("score_authority"), F.col("is_rumor"), F.col("verification_status"))
    m = S.impact(F.col("score_market_impact"), F.col("event_tier"))
    mix = F.lit(0.25) * t + F.lit(0.25) * h + F.lit(0.20) * a + F.lit(0.30) * m
    return j.withColumn("A", a).withColumn("score", F.when(F.col("rel") < gate, 0.0).otherwise(
        F.round(F.pow("rel", F.lit(1.5)) * mix, 4))).drop("_c", "_s")


def dedup_survivors(scored: DataFrame, threshold: float = D.COSINE_SECTOR, window_hours: float = 48.0, **kw) -> DataFrame:
    """Survivors of every sector with their keeper: (sector, id, keeper, folded)."""
    alive = scored.where("score > 0").withColumn("node", F.concat_ws("/", "sector", F.col("id").cast("string")))
    rows = vector_rows(alive, "node", "embedding", event_hours(F.col("published")), "id", F.col("sector"))
    links = similar_links(rows, threshold, window_hours, "pass", **kw)
    c = cluster_of(alive.select(F.col("node").alias("id")), links).withColumnRenamed("id", "node")
    best = F.struct("score", F.round("A", 4), -F.col("id"))
    j = alive.select("node", "sector", "id", "score", "A").join(c, "node")
    keepers = j.groupBy("cluster").agg(F.max_by("id", best).alias("keeper"))
    return j.join(keepers, "cluster").select("sector", "id", "score", "keeper", (F.col("id") != F.col("keeper")).alias("folded"))


def recommend(screened: DataFrame, scored: DataFrame, survivors: DataFrame, top: int = 3, listed: int = 30) -> DataFrame:
    """Recommended rows by sector, then the filtered ones with their reason, at most ``listed``.

    Reasons in order: not selected, gate, folded, prefilter.
    """
    keep = survivors.where(~F.col("folded")).withColumn("rank", F.row_number().over(
        Window.partitionBy("sector").orderBy(F.col("score").desc(), "id")))
    best = keep.where(F.col("rank") <= top).select("sector", "id", "score", F.lit(0).alias("part"), F.lit("recommended").alias("reason"))
    chosen = best.select("sector", "id")
    rest = survivors.where(~F.col("folded")).join(chosen, ["sector", "id"], "left_anti")
    part = lambda df, n, why, score: df.select("sector", "id", score.cast("double").alias("score"), F.lit(n).alias("part"),
                                               F.lit(why).alias("reason"))
    pool = (part(rest, 1, "not_selected", F.col("score"))
            .unionByName(part(scored.where("score <= 0"), 2, "gate", F.col("score")))
            .unionByName(part(survivors.where("folded"), 3, "folded", F.col("score")))
            .unionByName(part(screened.where(~F.col("passed")), 4, "prefilter", F.col("prefilter_score"))))
    shown = pool.withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy(
        "part", F.col("score").desc(), "id"))).where(F.col("place") <= listed).drop("place")
    return best.unionByName(shown)


def funnel(screened: DataFrame, scored: DataFrame, survivors: DataFrame, sectors: DataFrame, top: int = 3) -> DataFrame:
    """Counts of each stage by sector and why a sector came out empty."""
    a = screened.groupBy("sector").agg(F.count("*").alias("pool_size"), F.count_if("passed").alias("prefilter_passed"))
    bad = F.coalesce("content_genre", F.lit("")).isin("ROUNDUP", "PROMO", "PRICE_NOISE")
    b = scored.groupBy("sector").agg(F.count_if(F.col("score") > 0).alias("gate_survivors"),
                                     F.count_if((F.col("score") <= 0) & ~bad).alias("_other"))
    c = survivors.groupBy("sector").agg(F.count_if(~F.col("folded")).alias("after_dedup"), F.count_if("folded").alias("folded"))
    j = sectors.select("sector").join(a, "sector", "left").join(b, "sector", "left").join(c, "sector", "left")
    names = ["pool_size", "prefilter_passed", "gate_survivors", "after_dedup", "folded", "_other"]
    j = j.select("sector", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    reason = (F.when(F.col("pool_size") == 0, "EMPTY_POOL").when(F.col("prefilter_passed") == 0, "NO_RELEVANT_CONTENT")
              .when(F.col("gate_survivors") == 0, F.when(F.col("_other") == 0, "ALL_GENRE_DISQUALIFIED")
                    .otherwise("NO_RELEVANT_CONTENT")))
    return j.withColumn("returned", F.least("after_dedup", F.lit(top))).withColumn("empty_reason", reason).drop("_other")
