"""Jobs over scores and rankings (SCO, RNK, DQ9)."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import times as T
from ..functions.percent import percent_marks, title_move
from ..operators import filters as FL
from ..operators import quality as Q
from ..operators import rank as RK
from ..operators import score as SC
from ..session import cut_lineage
from .registry import job
from .views import NOW

C = F.col
IMPACT = """greatest(CASE event_tier WHEN 'S' THEN 0.85 WHEN 'A' THEN 0.6 WHEN 'B' THEN 0.35 WHEN 'C' THEN 0.15 ELSE 0.0 END,
  least(CASE event_tier WHEN 'S' THEN 1.0 WHEN 'A' THEN 0.84 WHEN 'B' THEN 0.59 WHEN 'C' THEN 0.34 WHEN 'D' THEN 0.14 ELSE 1.0 END,
  COALESCE(score_market_impact, 0.5)))"""
TIME = "CASE WHEN {t} IS NULL THEN 0.5 ELSE exp(-greatest(0, date_diff('second', {t}, TIMESTAMP '2024-02-01') / 3600.0) * ln(2) / 24) END".format
BREADTH = """CASE breadth_level WHEN 'cross_market' THEN 1.0 WHEN 'market_index' THEN 0.8 WHEN 'sector' THEN 0.6 WHEN 'multi_asset' THEN 0.35
  ELSE 0.15 END"""
BASELINE = """(SELECT greatest(500.0, COALESCE((SELECT v[1 + least(n - 1, CAST(floor(n * 0.95) AS BIGINT))] FROM
  (SELECT list(social_interactions ORDER BY social_interactions) AS v, count(*) AS n FROM {src} WHERE social_interactions > 0) WHERE n > 0), 500)))""".format
HOT = """least(1.0, 0.6 * least(1.0, log10(1 + social_interactions) / log10(1 + {b})) + 0.4 * least(source_count / 8.0, 1.0))""".format
AUTH = """score_authority * CASE WHEN is_rumor THEN 0.7 ELSE 1 END * CASE verification_status WHEN 'PROBABLE' THEN 0.95 WHEN 'UNVERIFIED' THEN 0.75
  WHEN 'DISPUTED' THEN 0.5 ELSE 1 END"""
RESO = """CASE WHEN len(list_filter(sources, lambda s: s.type NOT IN ('web_search', 'calendar') AND s.authority >= 4)) >= 3 THEN 1.0
  WHEN len(list_filter(sources, lambda s: s.type NOT IN ('web_search', 'calendar') AND s.authority >= 4)) = 2 THEN 0.65
  WHEN len(list_filter(sources, lambda s: s.type NOT IN ('web_search', 'calendar') AND s.authority >= 5)) > 0 THEN 0.45 ELSE 0.15 END"""
# the move each family of titles carries, worked out from the text rule by hand
MOVE = """CASE id % 8 WHEN 0 THEN NULLIF(CAST(id % 40 AS DOUBLE), 0)
  WHEN 2 THEN CAST(id % 12 AS DOUBLE) + 0.5 WHEN 4 THEN NULLIF(CAST(id % 9 AS DOUBLE), 0) END"""
BAND = """CASE WHEN id % 8 = 7 OR regexp_matches(title_zh || ' ' || title_en || ' ' || description_short_zh,
    '(?i)circuit breaker|crash|plunge|plummet|soar|surge|collapse|rout') THEN 1.0
  WHEN {m} >= 15 THEN 1.0 WHEN {m} >= 8 THEN 0.75 WHEN {m} >= 4 THEN 0.55 WHEN {m} >= 2 THEN 0.35 ELSE 0.10 END""".format
PUNCH = f"least(1.0, 0.65 * {BAND(m='move')} + 0.35 * {RESO})"
MARKET = """CASE WHEN breadth_level = 'cross_market' THEN greatest(1.0, {w}) ELSE {w} END""".format(
    w="CASE market_scope WHEN 'us_stock' THEN 1.2 WHEN 'crypto' THEN 1.0 WHEN 'macro_policy' THEN 1.0 WHEN 'social_signal' THEN 0.85 "
      "WHEN 'general' THEN 0.7 WHEN 'hk_stock' THEN 0.65 WHEN 'jp_stock' THEN 0.6 WHEN 'kr_stock' THEN 0.55 ELSE 0.7 END")
FRESH = """CASE WHEN {t} IS NULL OR {t} >= {n} THEN 1.0 ELSE greatest(0.15, exp(-(date_diff('second', {t}, {n}) / 3600.0) * ln(2) / 48)) END""".format(
    t="COALESCE(time_event, CAST(date AS TIMESTAMP))", n="TIMESTAMP '2024-02-01'")


@job("sco01_impact", f"SELECT id, {IMPACT} AS impact FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", S.impact(C("score_market_impact"), C("event_tier")).alias("impact"))


@job("sco02_timeliness", f"SELECT id, round({TIME(t='time_event')}, 6) AS timeliness FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", F.round(S.timeliness(C("time_event"), T.wall(NOW)), 6).alias("timeliness"))


@job("sco03_social_baseline", f"SELECT CAST({BASELINE(src='news_events')} AS DOUBLE) AS baseline", "news_events")
def _(f):
    return SC.social_baseline(f.news_events)


@job("sco04_hotness", f"SELECT id, round({HOT(b='b')}, 6) AS hotness FROM news_events, (SELECT {BASELINE(src='news_events')} AS b)", "news_events")
def _(f):
    e = f.news_events.crossJoin(SC.social_baseline(f.news_events))
    return e.select("id", F.round(S.hotness(C("social_interactions"), C("source_count"), C("baseline")), 6).alias("hotness"))


@job("sco05_authority", f"SELECT id, round({AUTH}, 6) AS authority FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", F.round(S.authority(C("score_authority"), C("is_rumor"), C("verification_status")), 6).alias("authority"))


@job("sco06_quality", "SELECT id, round(COALESCE(score_quality, 0.5), 6) AS quality FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", F.round(S.quality(C("score_quality")), 6).alias("quality"))


@job("sco07_breadth", f"SELECT id, CAST({BREADTH} AS DOUBLE) AS breadth FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", S.breadth(C("breadth_level")).alias("breadth"))


@job("sco08_percent_moves", f"SELECT id, {MOVE} AS move FROM news_events WHERE id % 8 <> 3".replace(" WHERE id % 8 <> 3", ""), "news_events")
def _(f):
    return f.news_events.select("id", title_move(C("title_zh"), F.lit(""), F.lit("")).alias("move"))


@job("sco08_percent_marks", r"""
SELECT doc_id, len(regexp_extract_all(text, '(^|[^0-9])\d{1,3}(\.\d+)?\s*%')) AS marks FROM documents
""")
def _(f):
    return f.documents.select("doc_id", F.size(percent_marks(C("text"))).cast("long").alias("marks"))


JUDGED = """CASE WHEN event_tier = 'S' THEN NULL WHEN event_tier = 'A' THEN CAST(source_count AS DOUBLE) * 2 WHEN event_tier = 'B' THEN NULL ELSE {m} END"""


def _judged(f):
    pm = F.when(C("event_tier") == "S", F.struct(F.lit(False).alias("is_price_move"), F.lit(9.0).alias("move_pct"), F.lit("none").alias("move_horizon"))).when(
        C("event_tier") == "A", F.struct(F.lit(True).alias("is_price_move"), (C("source_count") * -2.0).alias("move_pct"), F.lit("intraday").alias("move_horizon"))).when(
        C("event_tier") == "B", F.struct(F.lit(True).alias("is_price_move"), F.lit(38.0).alias("move_pct"), F.lit("long_term").alias("move_horizon")))
    return f.news_events.withColumn("price_move", pm)


@job("sco09_punch", f"""
SELECT id, CAST({PUNCH} AS DOUBLE) AS punch, move AS magnitude_pct
FROM (SELECT *, {JUDGED.format(m=MOVE)} AS move FROM news_events)
""", "news_events")
def _(f):
    e = _judged(f)
    pct = S.punch_pct(C("price_move"), C("title_zh"), C("title_en"), C("description_short_zh"))
    return e.select("id", F.round(S.punch(pct, C("title_zh"), C("title_en"), C("description_short_zh"), C("sources")), 6).alias("punch"),
                    pct.alias("magnitude_pct"))


@job("sco10_resonance", f"SELECT id, CAST({RESO} AS DOUBLE) AS resonance FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", S.resonance(C("sources")).alias("resonance"))


TOTAL = f"""0.26 * {IMPACT} + 0.16 * {BREADTH} + 0.16 * {TIME(t='time_event')} + 0.14 * {PUNCH} + 0.10 * {HOT(b='b')} + 0.10 * {AUTH}
  + 0.08 * COALESCE(score_quality, 0.5)"""


@job("sco11_scored_events", f"""
SELECT id, round({IMPACT}, 4) AS score_market_impact, CAST(round({PUNCH}, 4) AS DOUBLE) AS score_punch, round({HOT(b='b')}, 4) AS score_hotness,
  round({TOTAL}, 4) AS importance_score, 6 AS scoring_version
FROM (SELECT *, {MOVE} AS move FROM news_events), (SELECT {BASELINE(src='news_events')} AS b)
""", "news_events")
def _(f):
    return SC.score_events(f.news_events, NOW).select("id", "score_market_impact", "score_punch", "score_hotness", "importance_score",
                                                      "scoring_version")


@job("sco12_price_move_overturns", f"""
SELECT count(*) AS with_magnitude, count(quality) AS judged, round(avg(1 - quality), 6) AS overturned
FROM (SELECT *, {MOVE} AS move FROM news_events) LEFT JOIN labels ON doc_id = id WHERE move IS NOT NULL AND date >= DATE '2024-01-12'
""", "news_events")
def _(f):
    e = f.news_events.withColumn("punch_magnitude_pct", title_move(C("title_zh"), F.lit(""), F.lit("")))
    v = f.labels.select(C("doc_id").alias("id"), (C("quality") == 1).alias("is_price_move"))
    return SC.price_move_overturns(e, v, NOW, days=20)


# --- ranking ----------------------------------------------------------------------------------------

POOL = """pool AS (SELECT *, row_number() OVER (ORDER BY pt DESC, id) AS pool_order FROM (
  SELECT *, COALESCE(time_event, CAST(date AS TIMESTAMP), time_get_data) AS pt FROM news_events)
  WHERE pt >= TIMESTAMP '2024-02-01' - INTERVAL 40 DAY ORDER BY pt DESC, id LIMIT 1200)"""


def _pool(f):
    return cut_lineage(RK.candidate_pool(f.news_events, NOW, 40))   # at most 1200 rows, read several times


@job("rnk01_candidate_pool", f"WITH {POOL} SELECT id, pool_order FROM pool", "news_events")
def _(f):
    return _pool(f).select("id", F.col("pool_order").cast("long").alias("pool_order"))


def _sets(f):
    """Weight sets, one a region: the default, a heavier one, text that is no number, all zero, and one with relevance."""
    k = C("r_regionkey")
    txt = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), k + 1)
    return f.region.select(
        k.alias("set_id"), txt("0.26", "35", "x", "0", "1").alias("M"), txt("0.16", "10", "0.16", "0", "1").alias("B"),
        txt("0.16", "20", "-3", "0", "1").alias("T"), txt("0.14", "0", "0.14", "0", "0").alias("I"), txt("0.10", "15", "0.10", "0", "2").alias("H"),
        txt("0.10", "15", "0.10", "0", "1").alias("A"), txt("0.08", "15", "", "0", "1").alias("Q"), txt("0", "45", "0", "0", "3").alias("Rel"))


SETS = """sets AS (SELECT s AS set_id, M / tot AS M, B / tot AS B, T / tot AS T, I / tot AS I, H / tot AS H, A / tot AS A, Q / tot AS Q FROM (
  SELECT *, CAST(M + B + T + I + H + A + Q AS DOUBLE) AS tot FROM (VALUES (0, 0.26::DOUBLE, 0.16::DOUBLE, 0.16::DOUBLE, 0.14::DOUBLE, 0.10::DOUBLE, 0.10::DOUBLE, 0.08::DOUBLE), (1, 35, 10, 20, 0, 15, 15, 15),
  (2, 0.26, 0.16, 0, 0.14, 0.10, 0.10, 0.08), (3, 1, 0, 1, 0, 1, 1, 1), (4, 1, 1, 1, 0, 2, 1, 1)) AS v(s, M, B, T, I, H, A, Q)))"""


@job("rnk02_weight_sets", f"WITH {SETS} SELECT set_id, round(M, 6) AS w_m, round(I, 6) AS w_i, round(Q, 6) AS w_q FROM sets")
def _(f):
    return RK.normalize_weights(_sets(f), False).select("set_id", *[F.round(f"w_{k}", 6).alias(f"w_{k.lower()}") for k in ("M", "I", "Q")])


@job("rnk03_cheap_relevance", """
SELECT id, CASE WHEN len(list_filter(sector_tags, lambda t: t.sector = 'ASIA')) > 0
    THEN list_filter(sector_tags, lambda t: t.sector = 'ASIA')[1].relevance
  WHEN list_contains(sectors, 'ASIA') THEN 0.6 WHEN list_has_any(coins, ['C2', 'C7', 'C12']) THEN 0.55
  WHEN contains(lower(title_en || ' ' || title_zh), 'gains') THEN 0.4 ELSE 0.0 END AS rel FROM (SELECT id, title_en, title_zh, coins, sectors,
  CASE WHEN event_tier = 'S' THEN sector_tags ELSE list_filter(sector_tags, lambda t: t.sector <> 'ASIA') END AS sector_tags FROM news_events)
""", "news_events")
def _(f):
    e = f.news_events.withColumn("sector_tags", F.when(C("event_tier") == "S", C("sector_tags")).otherwise(
        F.filter("sector_tags", lambda t: t["sector"] != "ASIA")))
    return e.select("id", RK.cheap_relevance("ASIA", ["C2", "C7", "C12"], ["gains"]).alias("rel"))


FACT = f"""fact AS (SELECT pool.*, {IMPACT} AS M, {BREADTH} AS B, {TIME(t='COALESCE(time_event, time_get_data)')} AS T,
  COALESCE(score_punch, least(1.0, 0.65 * {BAND(m=f'({MOVE})')} + 0.35 * {RESO})) AS I, {HOT(b='b')} AS H, score_authority AS A,
  COALESCE(score_quality, 0.5) AS Q FROM pool, (SELECT {BASELINE(src='pool')} AS b))"""


@job("rnk04_lab_factors", f"WITH {POOL}, {FACT} SELECT id, round(M, 6) AS m, round(T, 6) AS t, round(I, 6) AS i, round(H, 6) AS h FROM fact", "news_events")
def _(f):
    return RK.lab_factors(_pool(f), NOW).select("id", *[F.round(k, 6).alias(k.lower()) for k in ("M", "T", "I", "H")])


@job("rnk05_market_weights", f"SELECT id, CAST({MARKET} AS DOUBLE) AS market_weight FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", S.market_weight(C("market_scope"), C("breadth_level")).alias("market_weight"))


@job("rnk06_freshness", f"SELECT id, round({FRESH}, 6) AS freshness FROM news_events", "news_events")
def _(f):
    return f.news_events.select("id", F.round(S.freshness(RK.event_clock(), T.wall(NOW)), 6).alias("freshness"))


MOOD = f"""mw AS (SELECT *, importance_score * {MARKET} * {FRESH} AS w FROM {{src}} WHERE sentiment_score IS NOT NULL AND event_tier IN ('S', 'A')),
mood AS (SELECT sum(sentiment_score * w) / sum(w) AS raw, round(sum(sentiment_score * w) / sum(w), 3) AS mood, count(*) AS n FROM mw)""".format


MOOD_NOW = "2024-01-12 00:00:00"      # a busy day of the table: what had been fetched by then
DAY = f"(SELECT * FROM news_events WHERE time_get_data BETWEEN TIMESTAMP '{MOOD_NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{MOOD_NOW}')"
DAY_MOOD = MOOD(src=DAY).replace("TIMESTAMP '2024-02-01'", f"TIMESTAMP '{MOOD_NOW}'")


def _fetched(f):
    return f.news_events.where(C("time_get_data") <= T.wall(MOOD_NOW))


@job("rnk07_market_mood", f"""
WITH {DAY_MOOD} SELECT mood AS mood_score, CASE WHEN raw >= 0.5 THEN 'extreme_bullish' WHEN raw >= 0.15 THEN 'bullish'
  WHEN raw >= -0.15 THEN 'neutral' WHEN raw >= -0.5 THEN 'bearish' ELSE 'extreme_bearish' END AS label, n AS sample_size, n > 0 AS available FROM mood
""", "news_events")
def _(f):
    return RK.market_mood(_fetched(f), MOOD_NOW, hours=24).select("mood_score", "label", "sample_size", "available")


@job("rnk07_mood_top", f"""
WITH {DAY_MOOD} SELECT id FROM mw, mood WHERE (sentiment_score >= 0) = (raw >= 0) ORDER BY abs(sentiment_score) * w DESC, id LIMIT 3
""", "news_events")
def _(f):
    return RK.mood_top(_fetched(f), MOOD_NOW, hours=24).select("id")


ALIGN = "CASE WHEN sentiment_score IS NOT NULL AND (sentiment_score >= 0) = (mood >= 0) THEN 0.25 * abs(mood) * abs(sentiment_score) ELSE 0 END"
REV = """CASE WHEN sentiment_score IS NOT NULL AND (sentiment_score >= 0) <> (mood >= 0) AND event_tier IN ('S', 'A')
  THEN 0.20 * abs(mood) * abs(sentiment_score) ELSE 0 END"""
TRADE = "CASE WHEN tradable_count <= 0 THEN 0 WHEN tradable_count >= 5 THEN 0.02 ELSE 0.06 END"
SCORED = f"""scored AS (SELECT fact.*, set_id, mood, {ALIGN} AS b1, {REV} AS b2, {TRADE} AS b3,
    sets.M * fact.M + sets.B * fact.B + sets.T * fact.T + sets.I * fact.I + sets.H * fact.H + sets.A * fact.A + sets.Q * fact.Q AS base,
    round({MARKET}, 4) AS mkt, {FRESH} AS fr FROM fact, sets, mood),
ranked AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(final, 9) DESC, pool_order) AS rank FROM (
    SELECT *, base * mkt * fr * CAST(format('{{:.4f}}', 1 + least(0.5, b1 + b2 + b3)) AS DOUBLE) AS final FROM scored))"""
ALL = f"WITH {POOL}, {FACT}, {SETS}, {MOOD(src='pool')}, {SCORED}"


def _scored(f):
    pool = _pool(f)
    return RK.final_scores(cut_lineage(RK.lab_factors(pool, NOW)), RK.normalize_weights(_sets(f), False), RK.market_mood(pool, NOW), NOW)


@job("rnk08_bonuses", f"{ALL} SELECT id, round(b1, 6) AS align, round(b2, 6) AS reversal, CAST(b3 AS DOUBLE) AS tradable FROM scored WHERE set_id = 0", "news_events")
def _(f):
    return _scored(f).where("set_id = 0").select("id", F.round("bonus_align", 6).alias("align"), F.round("bonus_reversal", 6).alias("reversal"),
                                                 F.round(C("bonus_tradable").cast("double"), 6).alias("tradable"))


@job("rnk09_final_rank", f"{ALL} SELECT set_id, id, rank, round(final, 6) AS final_score FROM ranked", "news_events")
def _(f):
    return RK.ranked(_scored(f)).select("set_id", "id", F.col("rank").cast("long").alias("rank"), F.round("final_score", 6).alias("final_score"))


@job("rnk10_quota_mix")
def _(f):
    return RK.remix(RK.ranked(_scored(f)), quota=9)


@job("rnk11_pinned_top", f"""
{ALL}, a AS (SELECT set_id, id, COALESCE(tradable_count > 0, false) AS ok, rank - 1 AS p FROM ranked),
f AS (SELECT set_id, min(p) AS q FROM a WHERE ok GROUP BY set_id),
b AS (SELECT a.set_id, id, ok, CASE WHEN p = q THEN 0 WHEN p < q THEN p + 1 ELSE p END AS p, CASE WHEN p = q AND q > 0 THEN 'pin:1' END AS why FROM a LEFT JOIN f USING (set_id)),
g AS (SELECT set_id, min(p) AS q FROM b WHERE ok AND p >= 2 GROUP BY set_id)
SELECT b.set_id, id, CAST(1 + CASE WHEN p = q THEN 2 WHEN p >= 2 AND p < q THEN p + 1 ELSE p END AS INT) AS mixed_rank,
  CASE WHEN p = q AND q > 2 THEN 'pin:3' ELSE why END AS mix_reason FROM b LEFT JOIN g USING (set_id)
""", "news_events")
def _(f):
    return RK.remix(RK.ranked(_scored(f)), pin=True)


@job("rnk12_ranked_page", f"""
{ALL} SELECT rank, id, title_zh, event_tier, round(final, 6) AS final_score FROM ranked WHERE set_id = 0 AND rank BETWEEN 1 AND 20
""", "news_events")
def _(f):
    r = RK.ranked(_scored(f).where("set_id = 0"))
    return r.where(C("rank") <= 20).select(C("rank").cast("long").alias("rank"), "id", "title_zh", "event_tier",
                                           F.round("final_score", 6).alias("final_score"))


PAGE_FILTER = dict(date_from="2024-01-05", date_to="2024-01-30", is_rumor=False)
PAGE_WHERE = "date >= DATE '2024-01-05' AND date <= DATE '2024-01-30' AND NOT is_rumor"
PAGE_POOL = f"""pool AS (SELECT *, row_number() OVER (ORDER BY pt DESC, id) AS pool_order FROM (
  SELECT *, COALESCE(time_event, CAST(date AS TIMESTAMP), time_get_data) AS pt FROM news_events WHERE {PAGE_WHERE}) ORDER BY pt DESC, id LIMIT 1200)"""
PAGE = f"WITH {PAGE_POOL}, {FACT}, {SETS}, {MOOD(src='pool')}, {SCORED}"


def _production(f, **options):
    config = RK.normalize_weights(_sets(f).where("set_id = 0"), False)
    return RK.production_page(f.news_events, FL.feed_predicate(NOW, **PAGE_FILTER), config, NOW, **options)


@job("rnk12_production_page", f"""
{PAGE} SELECT rank AS position, id, title_zh, event_tier, round(final, 6) AS final_score, round(base, 6) AS base_score, CAST(mkt AS DOUBLE) AS market_multiplier,
  CAST(format('{{:.4f}}', s.M * r.M) AS DOUBLE) AS part_m, round(fr, 4) AS fresh, CAST(format('{{:.4f}}', least(0.5, b1 + b2 + b3)) AS DOUBLE) AS bonus_total,
  (SELECT count(*) FROM news_events WHERE {PAGE_WHERE}) AS total
FROM ranked AS r JOIN sets AS s USING (set_id) WHERE set_id = 0 AND rank BETWEEN 11 AND 35
""", "news_events")
def _(f):
    """A filtered page of 25 from position 11, with what explains each place and the total of the filter."""
    page = _production(f, limit=25, offset=10)
    return page.select(C("position").cast("long").alias("position"), "id", "title_zh", "event_tier", F.round("final_score", 6).alias("final_score"),
                       F.round("base_score", 6).alias("base_score"), "market_multiplier", C("part_M").alias("part_m"), "fresh", "bonus_total", "total")


@job("rnk12_stored_page", f"""
WITH {DAY_MOOD}, top AS (SELECT *, row_number() OVER (ORDER BY importance_score DESC NULLS LAST, id) AS pool_order FROM news_events WHERE {PAGE_WHERE}
  ORDER BY importance_score DESC NULLS LAST, id LIMIT 105),
s AS (SELECT top.*, mood, {ALIGN} AS b1, {REV} AS b2, {TRADE} AS b3, round({MARKET}, 4) AS mkt, {FRESH} AS fr FROM top, mood),
v AS (SELECT *, importance_score * mkt * fr * CAST(format('{{:.4f}}', 1 + least(0.5, b1 + b2 + b3)) AS DOUBLE) AS final FROM s)
SELECT position, id, round(final, 6) AS final_score, round(fr, 4) AS fresh, (SELECT count(*) FROM news_events WHERE {PAGE_WHERE}) AS total
FROM (SELECT *, row_number() OVER (ORDER BY final DESC, pool_order) AS position FROM v) WHERE position BETWEEN 6 AND 25
""", "news_events")
def _(f):
    """The page that is shown while no version is deployed, from position 6."""
    mood = RK.market_mood(_fetched(f), MOOD_NOW, hours=24)
    page = RK.stored_page(f.news_events, FL.feed_predicate(NOW, **PAGE_FILTER), mood, NOW, limit=20, offset=5)
    return page.select(C("position").cast("long").alias("position"), "id", F.round("final_score", 6).alias("final_score"), "fresh", "total")


@job("rnk13_rank_delta", f"""
{ALL} SELECT set_id, id, row_number() OVER (PARTITION BY set_id ORDER BY importance_score DESC, pool_order) - rank AS rank_delta FROM ranked
""", "news_events")
def _(f):
    return RK.rank_delta(RK.ranked(_scored(f))).select("set_id", "id", C("rank_delta").cast("long").alias("rank_delta"))


PAIRS = f"""{ALL}, pr AS (SELECT a.id, a.rank AS ra, b.rank AS rb FROM ranked AS a JOIN ranked AS b ON a.id = b.id AND a.set_id = 0 AND b.set_id = 1)"""


def _pairs(f):
    return RK.pair_ranks(RK.ranked(_scored(f)), 0, 1)


@job("rnk14_turnover", f"""
{PAIRS} SELECT count(*) FILTER (ra <= 20 AND rb <= 20) AS overlap, least(20, count(*)) AS top_n,
  round(1 - count(*) FILTER (ra <= 20 AND rb <= 20) / least(20, count(*)), 4) AS turnover FROM pr
""", "news_events")
def _(f):
    return RK.turnover(_pairs(f), 20)


@job("rnk14_movers", f"""
{PAIRS}, z AS (SELECT *, rb - ra AS delta FROM pr WHERE least(ra, rb) <= 60)
SELECT * FROM (SELECT id, delta, 'up' AS direction FROM z WHERE delta > 0 ORDER BY delta DESC, ra LIMIT 8)
UNION ALL SELECT * FROM (SELECT id, delta, 'down' AS direction FROM z WHERE delta < 0 ORDER BY delta, ra LIMIT 8)
""", "news_events")
def _(f):
    return RK.movers(_pairs(f), 20).select("id", C("delta").cast("long").alias("delta"), "direction")


@job("rnk14_only_in_one", f"{PAIRS} SELECT id, CASE WHEN ra <= 20 THEN 'a' ELSE 'b' END AS side FROM pr WHERE (ra <= 20) <> (rb <= 20)", "news_events")
def _(f):
    return RK.only_in(_pairs(f), 20).select("id", "side")


@job("rnk15_class_shift", f"""
{PAIRS} SELECT CASE WHEN len(list_filter(source_names, lambda s: s LIKE 'X/%')) > 0 THEN 'social' ELSE 'media' END AS source_class,
  count(*) AS events, round(avg(rb - ra), 6) AS mean_shift FROM pr JOIN news_events AS e ON e.id = pr.id GROUP BY 1
""", "news_events")
def _(f):
    return RK.class_shift(_pairs(f), f.news_events)


@job("rnk16_top_profile", """
SELECT count(*) AS n, round(avg(CASE WHEN market_scope = 'crypto' THEN 0.0 ELSE 100.0 END), 1) AS non_crypto_pct,
  round(avg(CASE WHEN event_tier IN ('S', 'A') THEN 100.0 ELSE 0.0 END), 1) AS sa_pct, count(DISTINCT COALESCE(market_scope, 'none')) AS scope_kinds
FROM (SELECT * FROM news_events WHERE date >= DATE '2024-01-20' ORDER BY importance_score DESC, id LIMIT 20)
""", "news_events")
def _(f):
    return RK.top_profile(f.news_events, "importance_score", "2024-01-27 00:00:00")


@job("rnk16_factor_contrast", """
WITH r AS (SELECT *, score_hotness AS sb, row_number() OVER (ORDER BY importance_score DESC, id) AS rk FROM news_events WHERE date >= DATE '2024-01-20')
SELECT round(avg(sb) FILTER (rk <= 20), 4) AS breadth_top, round(avg(score_punch) FILTER (rk <= 20), 4) AS punch_top,
  round(avg(sb), 4) AS breadth_all, round(avg(score_punch), 4) AS punch_all FROM r
""", "news_events")
def _(f):
    return RK.factor_contrast(f.news_events.withColumn("score_breadth", C("score_hotness")), "2024-01-27 00:00:00")


@job("rnk17_explanations", f"""
{ALL} SELECT id, CAST(format('{{:.4f}}', s.M * r.M) AS DOUBLE) AS part_m, CAST(format('{{:.4f}}', s.H * r.H) AS DOUBLE) AS part_h, round(fr, 4) AS fresh,
  CAST(format('{{:.4f}}', least(0.5, b1 + b2 + b3)) AS DOUBLE) AS bonus_total
FROM ranked AS r JOIN sets AS s USING (set_id) WHERE set_id = 1
""", "news_events")
def _(f):
    return RK.explain(_scored(f).where("set_id = 1"), NOW).select("id", C("part_M").alias("part_m"), C("part_H").alias("part_h"), "fresh", "bonus_total")


@job("dq09_rank_parity", f"""
{PAGE}, lab AS (SELECT rank, id FROM ranked WHERE set_id = 0 AND rank <= 10), page AS (
  SELECT row_number() OVER (ORDER BY round(final, 9) DESC, pool_order) AS rank, id FROM ranked WHERE set_id = 0)
SELECT count(*) AS equal, count(*) >= 9 AS ok FROM lab JOIN page USING (rank, id)
""", "news_events")
def _(f):
    """The lab's ranking of the page's pool beside the served page: two paths that have to agree."""
    rows = f.news_events.where(FL.feed_predicate(NOW, **PAGE_FILTER))
    pool = cut_lineage(RK.candidate_pool(rows, NOW, 40))
    lab = RK.ranked(RK.final_scores(RK.lab_factors(pool, NOW), RK.normalize_weights(_sets(f), False), RK.market_mood(pool, NOW), NOW)).where("set_id = 0")
    return Q.rank_parity(lab.select("rank", "id"), _production(f, limit=10).select(C("position").alias("rank"), "id"))


@job("dq09_rank_divergence", f"""
{PAGE} SELECT count(*) AS equal, count(*) >= 9 AS ok FROM ranked AS a JOIN ranked AS b ON a.rank = b.rank AND a.id = b.id AND a.set_id = 1 AND b.set_id = 0 WHERE a.rank <= 10
""", "news_events")
def _(f):
    """The same test of a lab set that is not the deployed one: it has to tell them apart."""
    rows = f.news_events.where(FL.feed_predicate(NOW, **PAGE_FILTER))
    pool = cut_lineage(RK.candidate_pool(rows, NOW, 40))
    lab = RK.ranked(RK.final_scores(RK.lab_factors(pool, NOW), RK.normalize_weights(_sets(f), False), RK.market_mood(pool, NOW), NOW)).where("set_id = 1")
    return Q.rank_parity(lab.select("rank", "id"), _production(f, limit=10).select(C("position").alias("rank"), "id"))
