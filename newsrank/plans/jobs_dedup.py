"""Jobs over de-duplication, clustering and merging (DED)."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..operators import dedup as DD
from ..operators.graph import cluster_of, key_links
from ..operators.similarity import nearest, vector_rows
from .registry import job
from .views import NOW

COS = "list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[]))".format
THR = 0.40   # the vectors of the given tables are nearly random: at 0.82 nothing would match


@job("ded01_stage_upsert", """
WITH b AS (SELECT regexp_replace(url, '/+$', '') AS u, min(item_id) AS first, min(authority) AS p,
  arg_max(matched_symbols, CASE WHEN matched_symbols <> '' THEN item_id END) AS s, count(*) AS seen FROM raw_items WHERE url <> '' GROUP BY 1),
o AS (SELECT regexp_replace(url, '/+$', '') AS u, min(item_id) AS id FROM raw_items WHERE url <> '' AND lang = 'en' GROUP BY 1)
SELECT sha256(b.u) AS url_hash, CASE WHEN o.u IS NULL THEN b.p ELSE least(b.p, 3) END AS priority,
  COALESCE(CASE WHEN b.s <> '' THEN b.s END, CASE WHEN o.u IS NOT NULL THEN 'OLD' END) AS matched_symbols FROM b LEFT JOIN o ON b.u = o.u
""", "raw_items")
def _(f):
    staged, fetched = _staged_and_fetched(f)
    return DD.stage_upsert(staged, fetched, NOW)[0].select("url_hash", "priority", "matched_symbols")


def _staged_and_fetched(f):
    r = f.raw_items.where("url != ''").withColumn("url_hash", X.url_hash(F.col("url")))
    staged = r.where("lang = 'en'").groupBy("url_hash").agg(F.min("item_id").alias("item_id")).select(
        "url_hash", F.lit(3).alias("priority"), F.lit("OLD").alias("matched_symbols"), T.wall("2024-01-01 00:00:00").alias("fetched_at"),
        "item_id")
    fetched = r.select("url_hash", F.col("authority").alias("priority"), "matched_symbols", F.col("item_id").alias("ord"), "item_id")
    return staged, fetched


@job("ded01_stage_counts", """
WITH b AS (SELECT regexp_replace(url, '/+$', '') AS u, count(*) AS seen, bool_or(lang = 'en') AS known FROM raw_items WHERE url <> '' GROUP BY 1)
SELECT count(*) FILTER (NOT known) AS new, CAST(sum(seen - CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS duplicate FROM b
""", "raw_items")
def _(f):
    return DD.stage_upsert(*_staged_and_fetched(f), NOW)[1]


@job("ded02_first_by_url", r"""
SELECT item_id FROM (SELECT item_id, url, row_number() OVER (PARTITION BY regexp_replace(url, '/+$', '') ORDER BY item_id) AS rn FROM raw_items)
WHERE rn = 1 OR url = ''
""", "raw_items")
def _(f):
    return DD.first_by_url(f.raw_items, "item_id").select("item_id")


@job("ded03_title_prefilter")
def _(f):
    return DD.prefilter_titles(DD.first_by_url(f.raw_items, "item_id"), "item_id").select("item_id")


@job("ded04_vector_prefilter", f"""
WITH RECURSIVE v AS (SELECT id AS o, authority AS auth, embedding, row_number() OVER (ORDER BY id) AS r FROM news_events WHERE embedding IS NOT NULL),
d AS (SELECT a.o, list({{'o': b.o, 'auth': b.auth}} ORDER BY b.o) AS dups FROM v AS a JOIN v AS b ON a.o < b.o AND {COS(a='a', b='b')} > {THR} GROUP BY a.o),
walk AS (  -- a row in play drops its later duplicates up to the first of higher authority, which ends it as well
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT r, CASE WHEN stop IS NULL THEN list_concat(gone, list_transform(open, lambda x: x.o))
                 ELSE list_append(list_concat(gone, list_transform(list_filter(open, lambda x: x.o < stop), lambda x: x.o)), o) END
  FROM (SELECT *, list_min(list_transform(list_filter(open, lambda x: x.auth > auth), lambda x: x.o)) AS stop
        FROM (SELECT v.r, v.o, v.auth, w.gone, CASE WHEN list_contains(w.gone, v.o) OR d.dups IS NULL THEN [] ELSE list_filter(d.dups, lambda x: NOT list_contains(w.gone, x.o)) END AS open
              FROM walk w JOIN v ON v.r = w.r + 1 LEFT JOIN d ON d.o = v.o)))
SELECT id FROM news_events WHERE NOT list_contains((SELECT gone FROM walk ORDER BY r DESC LIMIT 1), id)
""", "news_events")
def _(f):
    return DD.prefilter_vectors(f.news_events, "ord", threshold=THR).select("id")


@job("ded05_normalized_titles", r"""
SELECT id, regexp_replace(CASE id % 4
  WHEN 0 THEN '净流出<' || CAST(CAST(floor((n + 0.5) * 100000000) AS BIGINT) AS STRING) || '>美元' WHEN 1 THEN 'raises<' || CAST((n * 1000000) AS STRING) || '>today'
  WHEN 2 THEN '<' || CAST(n * 1000 + 500 AS STRING) || '>xrpmoved' ELSE 'nonumbers' || lang END, ' ', '') AS title_key
FROM (SELECT id, id % 900 + 1 AS n, lang FROM news_events)
""", "news_events")
def _(f):
    n = (F.col("id") % 900 + 1).cast("string")
    title = (F.when(F.col("id") % 4 == 0, F.concat(F.lit("PANews 消息，净流出 "), n, F.lit(".5 亿美元")))
             .when(F.col("id") % 4 == 1, F.concat(F.lit(" Raises $"), n, F.lit("M - today!")))
             .when(F.col("id") % 4 == 2, F.concat(n, F.lit(",500 XRP moved"))).otherwise(F.concat(F.lit("No 'numbers': "), "lang")))
    return f.news_events.select("id", X.normalize_title(title).alias("title_key"))


@job("ded06_fingerprints", """
SELECT id, event_action = '' AS fingerprint_missing, CASE WHEN event_action = '' THEN substring(sha256(trim(lower(title_en), E' \\t\\n\\r') || '_'), 1, 16)
  ELSE substring(sha256(replace(event_subject, ' ', '_') || '|' || event_action || '|' || event_date), 1, 16) END AS event_fingerprint
FROM news_events
""", "news_events")
def _(f):
    e = f.news_events.withColumn("published_at", F.lit(""))
    return DD.with_fingerprints(e).select("id", "fingerprint_missing", "event_fingerprint")


@job("ded07_fill_vectors", """
SELECT id, CASE WHEN embedding IS NULL THEN 'none' WHEN lang = 'en' THEN 'cache' ELSE 'computed' END AS vector_from,
  round(CASE WHEN embedding IS NULL THEN 0.0 WHEN lang = 'en' THEN embedding[1]
    ELSE embedding[1] / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) END, 5) AS first_value FROM news_events
""", "news_events")
def _(f):
    e = f.news_events.withColumn("url_hash", F.col("id"))
    v = e.where("embedding IS NOT NULL")
    twice = v.where("lang != 'en'").select("url_hash", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    out = DD.fill_vectors(e.select("id", "url_hash"), v.where("lang = 'en'").select("url_hash", "embedding"), twice, size=64)
    return out.select("id", "vector_from", F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value"))


PAIRS = f"""SELECT a.id AS a, b.id AS b FROM news_events AS a JOIN news_events AS b ON a.id < b.id AND {COS(a='a', b='b')} >= {THR}
  AND (a.time_event IS NULL OR b.time_event IS NULL OR abs(date_diff('second', a.time_event, b.time_event)) <= 48 * 3600)"""


@job("ded08_similar_pairs", PAIRS.replace("AS a, b.id AS b", f"AS a, b.id AS b, round({COS(a='a', b='b')}, 5) AS cosine"), "news_events")
def _(f):
    from ..operators.similarity import similar_pairs

    rows = vector_rows(f.news_events, "id", "embedding", DD.event_hours(F.col("time_event")))
    return similar_pairs(rows, THR, window_hours=48.0).select("a", "b", F.round("cosine", 5).alias("cosine"))


TITLE_NORM = "regexp_replace(lower(title_en), '[^\\p{L}\\p{N}<>]+', '', 'g')"


@job("ded09_clusters", rf"""
WITH RECURSIVE k AS (SELECT id, event_fingerprint AS fp, regexp_replace(lower(title_en), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM news_events),
e AS ({PAIRS} UNION SELECT x.id, y.id FROM k AS x JOIN k AS y ON x.fp = y.fp AND x.id < y.id
  UNION SELECT x.id, y.id FROM k AS x JOIN k AS y ON x.t = y.t AND x.t <> '' AND x.id < y.id),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, seen) AS (SELECT id, id FROM k UNION SELECT reach.id, n.b FROM reach JOIN n ON reach.seen = n.a)
SELECT id, min(seen) AS cluster FROM reach GROUP BY id
""", "news_events")
def _(f):
    return DD.cluster_items(f.news_events, threshold=THR)


@job("ded10_cross_run_match", f"""
WITH old AS (SELECT * FROM news_events WHERE time_get_data < TIMESTAMP '2024-01-16'),
new AS (SELECT * FROM news_events WHERE time_get_data >= TIMESTAMP '2024-01-16'),
fp AS (SELECT event_fingerprint AS fp, max(id) AS fid FROM old GROUP BY 1),
best AS (SELECT new.id, arg_max(old.id, {COS(a='new', b='old')} - old.id * 1e-12) AS vid, max({COS(a='new', b='old')}) AS c
  FROM new, old WHERE new.embedding IS NOT NULL AND old.embedding IS NOT NULL GROUP BY new.id),
near AS (SELECT best.id, vid FROM best JOIN new ON best.id = new.id JOIN old ON old.id = vid WHERE c >= 0.3
  AND abs(date_diff('second', new.time_event, old.time_event)) <= 720 * 3600)
SELECT new.id, COALESCE(fid, vid) AS existing_id, CASE WHEN fid IS NOT NULL THEN 'fingerprint' WHEN vid IS NOT NULL THEN 'vector' END AS via
FROM new LEFT JOIN fp ON new.event_fingerprint = fp LEFT JOIN near ON near.id = new.id
""", "news_events")
def _(f):
    e = f.news_events
    old, new = _old_and_new(e)
    return DD.match_existing(new, old, threshold=0.3, window_hours=720)


def _old_and_new(e):
    at = T.wall("2024-01-16 00:00:00")
    return e.where(F.col("time_get_data") < at), e.where(F.col("time_get_data") >= at)


MERGED_VIEW = """m AS (SELECT event_fingerprint AS cluster, id, ord, authority, length(description_short_en) AS dl,
  source_names[1] AS source, lang FROM news_events)"""


def _cluster_inputs(f):
    e = f.news_events.select(
        "id", "ord", "authority", "description_short_en", F.col("source_names")[0].alias("source"),
        F.concat(F.lit("u"), (F.col("id") / 2).cast("bigint").cast("string")).alias("url"), F.lit("rss").alias("type"),
        F.lit("2024-01-01").alias("published_at"), F.lit(None).cast("bigint").alias("tweet_id"),
        F.concat("lang", F.lit(",X")).alias("matched_symbols"), "event_fingerprint", "title_en", "embedding")
    return e, e.select("id", F.col("event_fingerprint").alias("cluster"))


@job("ded11_merged_clusters", f"""
WITH {MERGED_VIEW}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY authority DESC, dl DESC, ord) AS rn FROM m),
u AS (SELECT cluster, source FROM (SELECT cluster, source, row_number() OVER (PARTITION BY cluster, id // 2 ORDER BY ord) AS k FROM m) WHERE k = 1)
SELECT r.cluster AS event_id, r.id AS rep_id, n AS merged_sources_count, len(names) AS source_count,
  array_to_string(list_sort(names), ',') AS source_names, syms AS matched_symbols FROM r
JOIN (SELECT cluster, count(*) AS n FROM m GROUP BY 1) USING (cluster)
JOIN (SELECT cluster, list_distinct(list(source)) AS names FROM u GROUP BY 1) USING (cluster)
JOIN (SELECT cluster, arg_min(lang, ord) || ',X' || COALESCE(string_agg(CASE WHEN first THEN ',' || lang END, '' ORDER BY ord), '') AS syms FROM
  (SELECT cluster, lang, ord, row_number() OVER (PARTITION BY cluster, lang ORDER BY ord) = 1
    AND row_number() OVER (PARTITION BY cluster ORDER BY ord) > 1 AS first FROM m) GROUP BY cluster) USING (cluster)
WHERE rn = 1
""", "news_events")
def _(f):
    return DD.merge_clusters(*_cluster_inputs(f)).select(
        "event_id", "rep_id", "merged_sources_count", "source_count", F.array_join("source_names", ",").alias("source_names"), "matched_symbols")


@job("ded11_centroids", """
WITH u AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label)
SELECT label, CAST(i - 1 AS INT) AS i, round(m / n, 5) AS value FROM c JOIN n USING (label)
""")
def _(f):
    c = DD.centroids(f.embeddings, "label")
    return c.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round(F.col("x").cast("double"), 5).alias("value"))


@job("ded12_merge_into_existing", """
WITH old AS (SELECT * FROM news_events WHERE time_get_data < TIMESTAMP '2024-01-16'),
new AS (SELECT * FROM news_events WHERE time_get_data >= TIMESTAMP '2024-01-16'),
fp AS (SELECT event_fingerprint AS fp, max(id) AS fid FROM old GROUP BY 1),
m AS (SELECT new.*, fid, COALESCE(fid, new.id) AS k FROM new LEFT JOIN fp ON event_fingerprint = fp),
nm AS (SELECT k, unnest(source_names) AS n FROM m UNION SELECT k, unnest(old.source_names) FROM m JOIN old ON old.id = fid),
g AS (SELECT k, sum(merged_sources_count) AS merged, arg_min(title_zh, ord) AS t, max(fid) AS fid FROM m GROUP BY k)
SELECT g.k AS id, COALESCE(old.title_zh, t) AS title_zh, CAST(merged + COALESCE(old.merged_sources_count, 0) AS BIGINT) AS merged_sources_count,
  array_to_string(names, ',') AS source_names, greatest(len(list_distinct(list_transform(names, lambda n: split_part(n, '/', 1)))),
  COALESCE(old.source_count, 0)) AS source_count FROM g JOIN (SELECT k, list(n ORDER BY n) AS names FROM nm GROUP BY k) AS s ON s.k = g.k
LEFT JOIN old ON old.id = g.fid
""", "news_events")
def _(f):
    old, new = _old_and_new(f.news_events)
    fp = old.groupBy(F.col("event_fingerprint").alias("fp")).agg(F.max("id").alias("existing_id"))
    matches = new.join(fp, F.col("event_fingerprint") == F.col("fp")).select("id", "existing_id")
    return DD.merge_into_existing(new, old, matches).select(
        "id", "title_zh", "merged_sources_count", F.array_join("source_names", ",").alias("source_names"), "source_count")


@job("ded13_duplicate_stars")
def _(f):
    return DD.duplicate_stars(f.news_events, THR)


@job("ded14_history_merge")
def _(f):
    from ..operators.score import social_baseline

    return DD.merge_history(f.news_events, DD.duplicate_stars(f.news_events, THR), social_baseline(f.news_events)).select(
        "id", "source_count", "merged_sources_count", "social_interactions", F.round("importance_score", 4).alias("importance_score"))


@job("ded16_similarity_groups", f"""
WITH RECURSIVE s AS (SELECT vec_id AS id, embedding FROM embeddings),
e AS (SELECT a.id AS a, b.id AS b FROM s AS a JOIN s AS b ON a.id <> b.id AND {COS(a='a', b='b')} >= {THR}),
reach(id, seen) AS (SELECT id, id FROM s UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.seen = e.a),
c AS (SELECT id, min(seen) AS first_member FROM reach GROUP BY id)
SELECT x.id, x.first_member, count(y.id) + 1 AS size, round(CASE WHEN count(y.id) = 0 THEN 1.0
  ELSE avg({COS(a='p', b='q')}) END, 5) AS mean_similarity
FROM c AS x JOIN s AS p ON p.id = x.id LEFT JOIN c AS y ON y.first_member = x.first_member AND y.id <> x.id LEFT JOIN s AS q ON q.id = y.id
GROUP BY x.id, x.first_member
""")
def _(f):
    rows = vector_rows(f.embeddings, "vec_id", "embedding")
    return DD.similarity_groups(rows, THR).select("id", "first_member", "size", F.round("mean_similarity", 5).alias("mean_similarity"))


def _two_lists(f):
    a = vector_rows(f.embeddings.where("label < 3"), "vec_id", "embedding")
    b = vector_rows(f.embeddings.where("label >= 3"), "vec_id", "embedding")
    return a, b


GREEDY = f"""WITH RECURSIVE p AS (SELECT a, b, c, row_number() OVER (ORDER BY c DESC, a, b) AS r FROM (
  SELECT x.vec_id AS a, y.vec_id AS b, {COS(a='x', b='y')} AS c FROM embeddings AS x JOIN embeddings AS y ON x.label < 3 AND y.label >= 3) WHERE c >= 0.3),
walk AS (  -- pairs by falling similarity, each side used once
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS c, false AS taken, CAST([] AS BIGINT[]) AS left_used, CAST([] AS BIGINT[]) AS right_used
  UNION ALL
  SELECT r, a, b, c, free, CASE WHEN free THEN list_append(left_used, a) ELSE left_used END, CASE WHEN free THEN list_append(right_used, b) ELSE right_used END
  FROM (SELECT p.*, w.left_used, w.right_used, NOT list_contains(w.left_used, p.a) AND NOT list_contains(w.right_used, p.b) AS free FROM walk w JOIN p ON p.r = w.r + 1))"""


@job("ded17_list_overlap", GREEDY + """
SELECT n_a, n_b, overlap, round(overlap / n_a, 4) AS rate_a, round(overlap / n_b, 4) AS rate_b, round(overlap / (n_a + n_b - overlap), 4) AS jaccard
FROM (SELECT count(*) FILTER (label < 3) AS n_a, count(*) FILTER (label >= 3) AS n_b FROM embeddings), (SELECT count(*) AS overlap FROM walk WHERE taken)
""")
def _(f):
    return DD.list_overlap(*_two_lists(f), threshold=0.3)[1]


@job("ded17_matched_pairs", GREEDY + " SELECT a, b, round(c, 5) AS cosine FROM walk WHERE taken")
def _(f):
    return DD.list_overlap(*_two_lists(f), threshold=0.3)[0].select("a", "b", F.round("cosine", 5).alias("cosine"))


@job("ded18_nearest_counterpart", f"""
SELECT a, b, cosine FROM (SELECT a.vec_id AS a, b.vec_id AS b, round({COS(a='a', b='b')}, 5) AS cosine,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS(a='a', b='b')} DESC, b.vec_id) AS rn
  FROM embeddings AS a, embeddings AS b WHERE a.label < 3 AND b.label >= 3) WHERE rn = 1
""")
def _(f):
    return nearest(*_two_lists(f)).select("a", "b", F.round("cosine", 5).alias("cosine"))


def _cache(f):
    enriched = F.concat(F.lit('{"title_en": "t", "event_tier": "A"'), F.when(F.col("role") == "user", ', "title_zh": "z"').otherwise(""),
                        F.lit("}"))
    return f.conversations.select(F.col("conv_id").alias("url_hash"), F.col("role").alias("prompt_hash"), enriched.alias("enriched"),
                                  F.timestamp_add("HOUR", F.col("turn"), T.wall("2024-01-30 00:00:00")).alias("created_at"),
                                  F.lit(None).cast("timestamp_ntz").alias("consumed_at"), "turn")


REQUIRED = ["title_en", "title_zh", "event_tier"]


@job("ded19_cache_lookup", """
SELECT d.doc_id AS id, COALESCE(c.role = 'user', false) AS hit FROM documents AS d LEFT JOIN
  (SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id) AS c ON c.conv_id = d.doc_id
""")
def _(f):
    hashes = f.documents.select("doc_id", F.col("doc_id").alias("url_hash"))
    return DD.cache_lookup(hashes, _cache(f), "title_en string, title_zh string, event_tier string", REQUIRED).select(
        F.col("doc_id").alias("id"), "hit")


@job("ded20_cache_write_back", """
WITH c AS (SELECT conv_id AS h, 'old' AS prompt_hash, conv_id % 2 AS used FROM conversations GROUP BY conv_id)
SELECT COALESCE(c.h, d.doc_id) AS url_hash, CASE WHEN d.doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS prompt_hash,
  c.used = 1 AND d.doc_id IS NULL AS consumed FROM c FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'fr') AS d ON d.doc_id = c.h
""".replace("c.used = 1 AND d.doc_id IS NULL", "COALESCE(c.used = 1 AND d.doc_id IS NULL, false)"))
def _(f):
    cache = f.conversations.groupBy(F.col("conv_id").alias("url_hash")).agg(
        F.lit("old").alias("prompt_hash"), F.lit("{}").alias("enriched"), F.lit(NOW).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("consumed_at"))
    entries = f.documents.where("lang = 'fr'").select(F.col("doc_id").alias("url_hash"), F.lit("new").alias("prompt_hash"),
                                                      F.lit("{}").alias("enriched"))
    used = f.conversations.select(F.when(F.col("conv_id") % 2 == 1, F.col("conv_id")).alias("url_hash"))
    return DD.cache_write_back(cache, entries, used, NOW).select("url_hash", "prompt_hash", F.col("consumed_at").isNotNull().alias("consumed"))


@job("ded21_pending_work", """
SELECT id, priority FROM staging WHERE consumed_at IS NULL AND fetched_at >= TIMESTAMP '2024-01-02'
  AND id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant') ORDER BY priority, fetched_at DESC, id LIMIT 1000
""", "staging")
def _(f):
    return DD.pending_work(f.staging.withColumn("url_hash", F.col("id")), _cache(f), "assistant", NOW, 1000).select("id", "priority")


def _results(f):
    return f.news_events.select(
        F.when(F.col("event_tier") != "D", F.sha2(F.col("id").cast("string"), 256)).otherwise("short").alias("url_hash"), "id",
        F.when(F.col("lang") == "de", '{"title_en": "x"}').otherwise('{"title_en": "x", "title_zh": "y", "event_tier": "A"}').alias("enriched"),
        "embedding")


@job("ded22_accepted_results", """
SELECT id, embedding IS NOT NULL AS has_vector FROM news_events WHERE event_tier <> 'D' AND lang <> 'de'
""", "news_events")
def _(f):
    return DD.validate_results(_results(f), REQUIRED, size=64)[0].select("id", F.col("embedding").isNotNull().alias("has_vector"))


@job("ded22_rejected_results", "SELECT id FROM news_events WHERE event_tier = 'D' OR lang = 'de'", "news_events")
def _(f):
    return DD.validate_results(_results(f), REQUIRED, size=64)[1].select("id")


@job("ded23_mark_consumed", """
SELECT id, consumed_at IS NOT NULL OR (priority < 3 AND source <> 'src4') AS consumed,
  deferred_count + CASE WHEN priority < 3 AND source = 'src4' THEN 1 ELSE 0 END AS deferred_count,
  CASE WHEN priority < 3 AND source = 'src4' THEN 'budget now' ELSE defer_reason END AS defer_reason FROM staging
""", "staging")
def _(f):
    s = f.staging
    deferred = s.where("source = 'src4'").select("url", F.lit("budget now").alias("reason"))
    return DD.mark_consumed(s, s.where("priority < 3").select("id"), deferred, NOW).select(
        "id", F.col("consumed_at").isNotNull().alias("consumed"), "deferred_count", "defer_reason")


@job("ded24_linked_posts", """
SELECT tweet_id, news_event_id FROM posts LEFT JOIN (SELECT s.x_tweet_id AS t, max(id) AS news_event_id FROM
  (SELECT id, unnest(sources) AS s FROM news_events) WHERE s.x_tweet_id IS NOT NULL GROUP BY 1) ON t = tweet_id
""", "posts news_events")
def _(f):
    return DD.link_posts(f.posts, f.news_events).select("tweet_id", "news_event_id")
