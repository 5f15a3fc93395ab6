"""Jobs over source verification (VER)."""

from pyspark.sql import functions as F

from ..operators import verify as V
from ..session import cut_lineage
from .registry import job
from .views import NOW

THR = 0.30

ROWS = """nm AS (SELECT id, list_concat(list_transform(sources, lambda s: struct_pack(name := s.name, url := s.url, type := s.type, t := s.x_tweet_id)),
    list_transform(list_filter(source_names, lambda n: NOT list_contains(list_transform(sources, lambda s: s.name), n)),
      lambda n: struct_pack(name := n, url := '', type := 'rss', t := NULL))) AS ss FROM news_events),
sr AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM nm),
dm AS (SELECT *, lower(s.name) AS n, CASE WHEN lower(s.name) LIKE 'x/%' THEN substring(lower(s.name), 3) END AS h,
    regexp_extract(s.url, '://([^/]*)', 1) AS d FROM sr),
w AS (SELECT unnest(['official', 'top_media', 'established', 'secondary', 'unknown', 'anonymous']) AS tier,
    unnest([1.0, 0.85, 0.7, 0.45, 0.25, 0.15]) AS weight),
j AS (SELECT dm.id, pos, s, CASE WHEN a.inst IS NOT NULL THEN a.inst WHEN h IS NOT NULL THEN COALESCE(b.inst, 'x:' || h)
      WHEN c.inst IS NOT NULL THEN c.inst WHEN d <> '' THEN 'web:' || d ELSE 'name:' || n END AS inst,
    CASE WHEN a.inst IS NOT NULL THEN COALESCE(t.tier, a.tier) WHEN b.inst IS NOT NULL THEN b.tier WHEN h IS NOT NULL THEN 'anonymous'
      WHEN c.inst IS NOT NULL THEN c.tier WHEN s.type = 'web_search' THEN 'unknown' ELSE 'secondary' END AS tier
  FROM dm LEFT JOIN institutions AS a ON a.kind = 'name' AND a.key = n LEFT JOIN institutions AS b ON b.kind = 'handle' AND b.key = h
  LEFT JOIN institutions AS c ON c.kind = 'domain' AND (d = c.key OR d LIKE '%.' || c.key)
  LEFT JOIN institutions AS t ON t.kind = 'name_tier' AND t.key = n),
r AS (SELECT j.*, CAST(weight AS DOUBLE) AS weight FROM j JOIN w USING (tier))"""


@job("ver01_resolved_sources", f"WITH {ROWS} SELECT id, pos, inst, tier, weight FROM r", "news_events institutions")
def _(f):
    return V.source_rows(f.news_events, f.institutions).select("id", F.col("pos").cast("long").alias("pos"), "inst", "tier", "weight")


@job("ver02_event_sources", f"WITH {ROWS} SELECT id, pos, s.name AS name, s.url AS url FROM sr", "news_events institutions")
def _(f):
    e = f.news_events
    return e.select("id", F.posexplode(V.event_sources(e)).alias("pos", "s")).select(
        "id", F.col("pos").cast("long").alias("pos"), "s.name", "s.url")


KEY = r"""substring(regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tweet_body, 'https?://\S+', ' ', 'g'),
  '@[\w\p{L}]+', ' ', 'g'), '#[\w\p{L}]+', ' ', 'g'), '\s+', ' ', 'g'))), '[^\p{L}\p{M}\p{N}_]+', '', 'g'), 1, 120)"""
PROFILE = rf"""{ROWS}, k AS (SELECT r.*, NULLIF({KEY}, '') AS k FROM r LEFT JOIN posts ON tweet_id = s.t),
b AS (SELECT id, k, inst AS bi FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY weight DESC, pos) AS rn FROM k WHERE k IS NOT NULL) WHERE rn = 1),
f AS (SELECT k.*, COALESCE(inst <> bi, false) AS folded FROM k LEFT JOIN b ON b.id = k.id AND b.k = k.k),
i AS (SELECT id, inst, max(weight) AS w, min(pos) AS pos, bool_or(tier = 'official') AS o FROM f WHERE NOT folded GROUP BY id, inst),
i2 AS (SELECT *, w * CASE WHEN inst IN ('i1') THEN 0.5 ELSE 1 END AS worth, row_number() OVER (PARTITION BY id ORDER BY w DESC, pos) AS rn FROM i),
p AS (SELECT id, max(w) AS best_weight, max(inst) FILTER (rn = 1) AS best_inst,
    least(1.0, COALESCE(sum(worth) FILTER (rn > 1), 0) / 1.2) AS corroboration, count(*) AS n_institutions,
    count(*) FILTER (w >= 0.45) AS n_credible, bool_or(o) AS has_official FROM i2 GROUP BY id),
prof AS (SELECT p.*, n_folded FROM p JOIN (SELECT id, count(*) FILTER (folded) AS n_folded FROM f GROUP BY id) USING (id))"""


def _profile(f):
    return V.evidence(V.fold_reposts(V.source_rows(f.news_events, f.institutions, f.posts)), ["i1"])


@job("ver03_folded_reposts", f"WITH {PROFILE} SELECT id, n_folded FROM prof WHERE n_folded > 0", "news_events institutions posts")
def _(f):
    return _profile(f).where("n_folded > 0").select("id", "n_folded")


@job("ver04_evidence_profile", f"""
WITH {PROFILE} SELECT id, best_inst, best_weight, round(corroboration, 6) AS corroboration, n_institutions, n_credible, has_official FROM prof
""", "news_events institutions posts")
def _(f):
    return _profile(f).select("id", "best_inst", "best_weight", F.round("corroboration", 6).alias("corroboration"), "n_institutions",
                              "n_credible", "has_official")


TIMES = r"""tm AS (SELECT id, CASE WHEN cal THEN 1.0 WHEN time_event IS NULL THEN 0.6 ELSE least(1.0, CASE WHEN h < -6 THEN 0.0 ELSE 1.0 END,
    CASE WHEN h > 720 THEN 0.4 ELSE 1.0 END, CASE WHEN brk THEN 0.3 ELSE 1.0 END, CASE WHEN gap > 7 THEN 0.5 ELSE 1.0 END) END AS time_score,
  CASE WHEN cal THEN '' WHEN time_event IS NULL THEN 'TIME_UNPARSEABLE' ELSE concat_ws(',', CASE WHEN h < -6 THEN 'TIME_FUTURE_PUBLISH' END,
    CASE WHEN h > 720 THEN 'TIME_STALE' END, CASE WHEN brk THEN 'TIME_RECYCLED_BREAKING' END, CASE WHEN gap > 7 THEN 'TIME_DATE_MISMATCH' END) END AS flags
FROM (SELECT *, len(list_filter(sources, lambda s: s.type = 'calendar')) > 0 AS cal,
    date_diff('second', time_event, TIMESTAMP '2024-01-28') / 3600.0 AS h,
    date_diff('second', time_event, TIMESTAMP '2024-01-28') > 48 * 3600 AND regexp_matches(title_zh || ' ' || title_en || ' ' || description_short_zh,
      '(?i)\bbreaking\b|\bjust in\b|\bmoments ago\b|\bminutes ago\b|快讯|突发|刚刚|最新消息|重磅') AS brk,
    abs(date_diff('second', CAST(event_date AS TIMESTAMP), time_event)) / 86400.0 AS gap FROM news_events))"""
AT = "2024-01-28 00:00:00"


@job("ver05_time_consistency", f"WITH {TIMES} SELECT id, CAST(time_score AS DOUBLE) AS time_score, flags FROM tm", "news_events")
def _(f):
    return V.time_consistency(f.news_events, AT).select("id", "time_score", F.array_join("time_flags", ",").alias("flags"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
DENY = rf"""dn AS (SELECT a.id, count(*) AS n FROM news_events AS a, news_events AS b, prof WHERE prof.id = b.id AND prof.best_weight >= 0.45
  AND a.title_zh NOT LIKE '%否认%' AND b.title_zh LIKE '%否认%' AND {COS} >= {THR}
  AND (a.time_event IS NULL OR b.time_event IS NULL OR abs(date_diff('second', a.time_event, b.time_event)) <= 96 * 3600) GROUP BY a.id)"""


def _denials(f, profile):
    return V.denial_disputes(f.news_events, None, profile, threshold=THR)


@job("ver06_denials", f"WITH {PROFILE}, {DENY} SELECT id, n FROM dn", "news_events institutions posts")
def _(f):
    return _denials(f, cut_lineage(_profile(f))).select("id", "n")


OPP = """op AS (SELECT a.id, count(*) AS n FROM news_events AS a JOIN news_events AS b ON a.event_subject = b.event_subject
  AND abs(date_diff('day', CAST(a.event_date AS DATE), CAST(b.event_date AS DATE))) <= 2 AND (a.event_action, b.event_action) IN (
  ('net_inflow', 'net_outflow'), ('net_outflow', 'net_inflow'), ('price_surge', 'price_drop'), ('listed', 'delisted'), ('delisted', 'listed'),
  ('approved', 'rejected'), ('rejected', 'approved'), ('approved', 'banned'), ('banned', 'approved'), ('launched', 'shutdown'),
  ('shutdown', 'launched')) GROUP BY a.id)"""


@job("ver07_opposite_actions", f"WITH {OPP} SELECT id, n FROM op", "news_events")
def _(f):
    return V.opposite_disputes(f.news_events)


VERDICT = f"""{PROFILE}, {TIMES}, {DENY}, {OPP}, ds AS (SELECT id, sum(n) AS n FROM (SELECT * FROM dn UNION ALL SELECT * FROM op) GROUP BY id),
v0 AS (SELECT e.id, prof.*, is_rumor, flags, source_count, COALESCE(ds.n, 0) > 0 AS disputed,
    (0.9 * (0.55 * best_weight + 0.30 * corroboration + 0.15 * time_score) + 0.1 * COALESCE(credibility_score, 0.5)) * CASE WHEN is_rumor THEN 0.9 ELSE 1 END AS raw
  FROM news_events AS e JOIN prof ON prof.id = e.id JOIN tm ON tm.id = e.id LEFT JOIN ds ON ds.id = e.id),
v1 AS (SELECT *, CASE WHEN disputed THEN least(raw, 0.35) ELSE raw END AS score, n_institutions <= 1 AND best_weight < 0.45 AS lone FROM v0),
v2 AS (SELECT *, CASE WHEN lone THEN CASE WHEN disputed THEN 'DISPUTED' ELSE 'UNVERIFIED' END WHEN disputed THEN 'DISPUTED'
    WHEN has_official AND flags = '' THEN 'VERIFIED' WHEN n_credible >= 2 AND score >= 0.7 THEN 'VERIFIED' WHEN score >= 0.5 THEN 'PROBABLE'
    ELSE 'UNVERIFIED' END AS s FROM v1),
v AS (SELECT *, CASE WHEN is_rumor AND s = 'VERIFIED' AND NOT has_official AND n_credible < 3 THEN 'PROBABLE' ELSE s END AS status FROM v2)"""


def _verdicts(f):
    profile = cut_lineage(_profile(f))
    both = _denials(f, profile).select("id", "n").unionByName(V.opposite_disputes(f.news_events))
    disputes = both.groupBy("id").agg(F.sum("n").alias("n"))
    return V.verdicts(V.time_consistency(f.news_events.drop("verification_status"), AT), profile, disputes)


@job("ver08_verdicts", f"WITH {VERDICT} SELECT id, status AS verification_status, round(score, 6) AS verification_score FROM v",
     "news_events institutions posts")
def _(f):
    return _verdicts(f).select("id", "verification_status", F.round("verification_raw", 6).alias("verification_score"))


@job("ver09_status_counts", f"""
WITH {VERDICT} SELECT status AS verification_status, count(*) AS events, count(*) FILTER (disputed) AS disputed,
  CAST(sum(n_institutions) AS BIGINT) AS institutions, CAST(sum(n_institutions - source_count) AS BIGINT) AS diff_to_source_count FROM v GROUP BY status
""", "news_events institutions posts")
def _(f):
    return V.status_counts(_verdicts(f))


@job("ver09_flag_counts", f"""
WITH {VERDICT}, fl AS (SELECT unnest(string_split(flags, ',')) AS flag FROM v WHERE flags <> '' UNION ALL SELECT 'REPOST_FOLDED' FROM v WHERE n_folded > 0
  UNION ALL SELECT 'LLM_RUMOR' FROM v WHERE is_rumor UNION ALL SELECT 'CONTRADICTED' FROM v WHERE disputed
  UNION ALL SELECT 'SINGLE_LOW_TRUST_SOURCE' FROM v WHERE lone) SELECT flag, count(*) AS events FROM fl GROUP BY flag
""", "news_events institutions posts")
def _(f):
    return V.flag_counts(_verdicts(f))


@job("ver09_reasons")
def _(f):
    return _verdicts(f).select("id", V.reason_text(F.when(F.col("disputed"), F.lit("存在辟谣/否认报道"))).alias("verification_reason"))
