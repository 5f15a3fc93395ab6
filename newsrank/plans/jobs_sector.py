"""Jobs over sector recommendation (SEC, DED15)."""

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import sector as SE
from ..session import cut_lineage
from .jobs_rank import AUTH, BASELINE, HOT, IMPACT, TIME
from .registry import job
from .views import NOW

HOURS = 240
PASS = 0.22
THR = 0.30


def _sectors(f):
    """Five sectors: member coins from the nations of a region, one keyword each, a vector as anchor."""
    coins = f.nation.groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit("C"), F.col("n_nationkey").cast("string"))).alias("tickers"))
    anchor = f.embeddings.select(F.col("vec_id").alias("v"), F.col("embedding").alias("anchor"))
    r = f.region.join(coins, F.col("r_regionkey") == F.col("n_regionkey")).join(anchor, F.col("r_regionkey") == F.col("v"))
    word = F.element_at(F.array(*[F.lit(w) for w in ("gains", "否认", "关税", "theou", "市场")]), F.col("r_regionkey") + 1)
    kind = F.element_at(F.array(*[F.lit(w) for w in ("track", "chain", "track", "mechanism", "chain")]), F.col("r_regionkey") + 1)
    return r.select(F.col("r_name").alias("sector"), kind.alias("kind"), "tickers", F.array(word).alias("keywords"), "anchor")


SECTORS = """sec AS (SELECT r_name AS sector, ['track', 'chain', 'track', 'mechanism', 'chain'][r_regionkey + 1] AS kind,
  (SELECT list('C' || CAST(n_nationkey AS STRING)) FROM nation WHERE n_regionkey = r_regionkey) AS tickers,
  ['gains', '否认', '关税', 'theou', '市场'][r_regionkey + 1] AS word, embedding AS anchor FROM region JOIN embeddings ON vec_id = r_regionkey),
cand AS (SELECT *, COALESCE(time_event, time_get_data) AS published FROM news_events
  WHERE COALESCE(time_event, time_get_data) >= TIMESTAMP '2024-01-22'),
scr AS (SELECT cand.*, sec.*, CASE WHEN list_has_any(coins, tickers) THEN 1.0 WHEN contains(lower(title_en || ' ' || title_zh), word) THEN 0.8
    WHEN contains(lower(description_short_en || ' ' || description_short_zh), word) THEN 0.5 ELSE 0.0 END AS entity,
  COALESCE(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), 0) AS semantic FROM cand, sec)"""
PRE = "0.55 * greatest(0, semantic) + 0.45 * entity"


def _screened(f):
    return SE.prefilter(SE.candidates(f.news_events, NOW, HOURS), _sectors(f), PASS)


def _judgments(f):
    """One judgment for each labelled document and sector."""
    g = F.element_at(F.array(*[F.lit(x) for x in ("EVENT", "DATA", "ANALYSIS", "ROUNDUP", "PROMO", "PRICE_NOISE")]),
                     (F.col("doc_id") % 6 + 1).cast("int"))
    return f.labels.crossJoin(F.broadcast(f.region)).select(
        F.col("doc_id").alias("candidate_id"), F.col("r_name").alias("sector"), g.alias("content_genre"),
        ((F.col("doc_id") + F.col("r_regionkey")) % 2 == 0).alias("is_constituent_anchor"),
        ((F.col("doc_id") + F.col("r_regionkey")) % 3).cast("int").alias("transmission_hops"),
        (F.col("quality") * 0.6 + (F.col("doc_id") % 5) / 10.0).alias("entity_match"), ((F.col("doc_id") % 11) / 10.0).alias("semantic_sim"),
        ((F.col("doc_id") % 7) / 6.0).alias("focus_ratio"), (F.col("toxic") == 0).alias("title_hit"),
        F.array(F.concat(F.lit("c"), (F.col("doc_id") % 25).cast("string"))).alias("matched_tickers"))


REL = """rel AS (SELECT scr.*, CASE WHEN l.doc_id IS NULL THEN NULL ELSE ['EVENT', 'DATA', 'ANALYSIS', 'ROUNDUP', 'PROMO', 'PRICE_NOISE'][id % 6 + 1] END AS genre,
    CASE WHEN l.doc_id IS NULL THEN 0 ELSE round(least(CASE id % 6 WHEN 2 THEN 0.85 WHEN 3 THEN 0.2 WHEN 4 THEN 0.3 WHEN 5 THEN 0.4 ELSE 1.0 END,
    least(1, 0.5 * least(1, quality * 0.6 + (id % 5) / 10.0) + 0.3 * ((id % 11) / 10.0) + 0.2 * least(1, (id % 7) / 6.0 * CASE WHEN toxic = 0 THEN 1.5 ELSE 1 END)),
    CASE WHEN (id + r_regionkey) % 3 = 2 THEN 0.4 WHEN (id + r_regionkey) % 3 = 1 AND (id + r_regionkey) % 2 <> 0
      THEN CASE WHEN kind = 'chain' THEN 0.4 ELSE 0.55 END ELSE 1 END,
    CASE WHEN NOT list_contains(tickers, 'C' || CAST(id % 25 AS STRING)) AND (id % 11) / 10.0 < 0.5 THEN 0.3 ELSE 1 END), 4) END AS rel
  FROM scr JOIN region ON r_name = sector LEFT JOIN labels AS l ON l.doc_id = id WHERE {p} >= {t})""".format(p=PRE, t=PASS)
SCORE = f"""sco AS (SELECT *, CASE WHEN rel < 0.5 THEN 0 ELSE round(pow(rel, 1.5) * (0.25 * {TIME(t='published')} + 0.25 * {HOT(b='b')} + 0.20 * {AUTH}
  + 0.30 * {IMPACT}), 4) END AS score, {AUTH} AS au FROM rel, (SELECT {BASELINE(src='cand')} AS b))"""


def _scored(f, screened):
    return SE.gate_and_score(screened.where("passed"), _judgments(f), SE.candidates(f.news_events, NOW, HOURS), NOW)


@job("sec01_candidates", """
SELECT id, strftime(COALESCE(time_event, time_get_data), '%Y-%m-%d %H:%M:%S') AS published FROM news_events
WHERE COALESCE(time_event, time_get_data) >= TIMESTAMP '2024-01-29'
""", "news_events")
def _(f):
    return SE.candidates(f.news_events, NOW).select("id", T.wall_text(F.col("published")).alias("published"))


@job("sec02_entity_hits", f"WITH {SECTORS} SELECT sector, entity, count(*) AS events FROM scr GROUP BY sector, entity".replace(
    "entity, count", "CAST(entity AS DOUBLE) AS entity, count"), "news_events")
def _(f):
    return _screened(f).groupBy("sector", "entity").agg(F.count("*").alias("events"))


@job("sec03_prefilter", f"WITH {SECTORS} SELECT sector, id, round({PRE}, 5) AS prefilter_score FROM scr WHERE {PRE} >= {PASS}", "news_events")
def _(f):
    return _screened(f).where("passed").select("sector", "id", F.round("prefilter_score", 5).alias("prefilter_score"))


@job("sec04_relevance", f"WITH {SECTORS}, {REL} SELECT sector, id, CAST(rel AS DOUBLE) AS rel FROM rel", "news_events")
def _(f):
    return _scored(f, _screened(f)).select("sector", "id", "rel")


@job("sec05_gated_scores", f"WITH {SECTORS}, {REL}, {SCORE} SELECT sector, id, CAST(score AS DOUBLE) AS score FROM sco", "news_events")
def _(f):
    return _scored(f, _screened(f)).select("sector", "id", "score")


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
FOLD = f"""al AS (SELECT * FROM sco WHERE score > 0),
ed AS (SELECT a.sector, a.id AS x, b.id AS y FROM al AS a JOIN al AS b ON a.sector = b.sector AND a.id <> b.id AND {COS} >= {THR}
  AND abs(date_diff('second', a.published, b.published)) <= 48 * 3600),
reach(sector, id, seen) AS (SELECT sector, id, id FROM al UNION SELECT r.sector, r.id, ed.y FROM reach AS r JOIN ed ON ed.sector = r.sector AND ed.x = r.seen),
cl AS (SELECT sector, id, min(seen) AS c FROM reach GROUP BY sector, id),
kp AS (SELECT *, first_value(id) OVER (PARTITION BY sector, c ORDER BY score DESC, round(au, 4) DESC, id) AS keeper FROM al JOIN cl USING (sector, id))"""


def _survivors(scored):
    return SE.dedup_survivors(scored, THR)


@job("ded15_sector_survivors", f"WITH RECURSIVE {SECTORS}, {REL}, {SCORE}, {FOLD} SELECT sector, id, keeper, id <> keeper AS folded FROM kp", "news_events")
def _(f):
    return _survivors(cut_lineage(_scored(f, _screened(f)))).select("sector", "id", "keeper", "folded")


@job("sec06_recommended", f"""
WITH RECURSIVE {SECTORS}, {REL}, {SCORE}, {FOLD},
k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, id) AS rn FROM kp WHERE id = keeper),
pl AS (SELECT sector, id, CAST(score AS DOUBLE) AS score, 1 AS part, 'not_selected' AS reason FROM k WHERE rn > 3
  UNION ALL SELECT sector, id, 0, 2, 'gate' FROM sco WHERE score <= 0 UNION ALL SELECT sector, id, score, 3, 'folded' FROM kp WHERE id <> keeper
  UNION ALL SELECT sector, id, {PRE}, 4, 'prefilter' FROM scr WHERE {PRE} < {PASS})
SELECT sector, id, 'recommended' AS reason FROM k WHERE rn <= 3 UNION ALL
SELECT sector, id, reason FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY part, score DESC, id) AS p FROM pl) WHERE p <= 30
""", "news_events")
def _(f):
    screened = cut_lineage(_screened(f))
    scored = cut_lineage(_scored(f, screened))
    return SE.recommend(screened, scored, cut_lineage(_survivors(scored))).select("sector", "id", "reason")


@job("sec07_funnel", f"""
WITH RECURSIVE {SECTORS}, {REL}, {SCORE}, {FOLD} SELECT sec.sector, count(DISTINCT scr.id) AS pool_size,
  (SELECT count(*) FROM sco WHERE sco.sector = sec.sector) AS prefilter_passed,
  (SELECT count(*) FROM kp WHERE kp.sector = sec.sector) AS gate_survivors,
  (SELECT count(*) FROM kp WHERE kp.sector = sec.sector AND id = keeper) AS after_dedup,
  least(3, (SELECT count(*) FROM kp WHERE kp.sector = sec.sector AND id = keeper)) AS returned
FROM sec JOIN scr ON scr.sector = sec.sector GROUP BY sec.sector
""", "news_events")
def _(f):
    screened = cut_lineage(_screened(f))
    scored = cut_lineage(_scored(f, screened))
    return SE.funnel(screened, scored, cut_lineage(_survivors(scored)), _sectors(f)).select(
        "sector", "pool_size", "prefilter_passed", "gate_survivors", "after_dedup", F.col("returned").cast("long").alias("returned"))
