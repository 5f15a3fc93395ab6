"""Jobs over filters and projections (FLT)."""

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import times as T
from ..operators import filters as FL
from .jobs_sources import ISO_TS
from .registry import job
from .views import NOW

GATE = "2024-01-21 00:00:00"
W = r"E' \t\n\r'"
CLEAN_POST = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tweet_body, 'https?://\S+', ' ', 'g'), '@[\w\p{L}]+', ' ', 'g'), '#[\w\p{L}]+', ' ', 'g'), '\s+', ' ', 'g'))"
POST_KEY = rf"substring(regexp_replace(lower({CLEAN_POST}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g'), 1, 120)"
TITLE_KEY = rf"substring(regexp_replace(lower(trim(title, {W})), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g'), 1, 100)"
URL_KEY = r"""(regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\.', '')
  || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+$', ''))"""


@job("flt01_freshness_gate", f"""
SELECT item_id, CASE WHEN ts > TIMESTAMP '2024-01-22' THEN '2024-01-21 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
  AS published_ts FROM (SELECT *, {ISO_TS} AS ts FROM raw_items) WHERE ts >= TIMESTAMP '2024-01-14'
""", "raw_items")
def _(f):
    return FL.freshness_gate(f.raw_items, GATE).select("item_id", T.wall_text(F.col("published_ts")).alias("published_ts"))


@job("flt01_freshness_drops", f"""
SELECT source, count(*) AS dropped FROM (SELECT *, {ISO_TS} AS ts FROM raw_items)
WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-14' GROUP BY source
""", "raw_items")
def _(f):
    return FL.freshness_drops(f.raw_items, GATE)


@job("flt02_excluded_market_titles", r"""
SELECT doc_id, title FROM (SELECT doc_id, CASE WHEN source = 'src1' THEN '沪指 ' || lang WHEN source = 'src2' THEN 'The A股 day'
   WHEN source = 'src4' THEN 'xA股' WHEN source = 'src5' THEN 'China stocks slide' ELSE lang || ' title' END AS title FROM documents)
WHERE NOT regexp_matches(title, '(^|[^A-Za-z])A股|沪指|(?i)china stocks?')
""")
def _(f):
    d = f.documents.select("doc_id", F.when(F.col("source") == "src1", F.concat(F.lit("沪指 "), "lang"))
                           .when(F.col("source") == "src2", F.lit("The A股 day")).when(F.col("source") == "src4", F.lit("xA股"))
                           .when(F.col("source") == "src5", F.lit("China stocks slide"))
                           .otherwise(F.concat("lang", F.lit(" title"))).alias("title"))
    return FL.drop_excluded_titles(d)


@job("flt02_excluded_market_events", """
SELECT id FROM news_events WHERE market_scope IS NULL OR market_scope <> 'cn_a_share'
""", "news_events")
def _(f):
    return FL.drop_excluded_events(f.news_events).select("id")


SQUEEZE = lambda c: f"trim(replace(replace(replace(replace({c}, '&nbsp;', ''), ' ', ''), chr(160), ''), chr(10), ''), {W})"


@job("flt03_untrusted_gate", f"""
SELECT item_id FROM (SELECT *, {SQUEEZE('title')} AS t, {SQUEEZE('summary')} AS s FROM raw_items)
WHERE NOT (type = 'web_search' AND NOT (s <> '' AND length(CASE WHEN t = '' THEN s ELSE replace(s, t, '') END) >= 25))
""", "raw_items")
def _(f):
    return FL.drop_untrusted(f.raw_items).select("item_id")


@job("flt04_all_aggregated_events", """
SELECT id, len(list_filter(sources, lambda s: s.type <> 'web_search')) = 0 AS all_aggregated FROM news_events
""", "news_events")
def _(f):
    return f.news_events.select("id", FL.all_aggregated(F.col("sources")).alias("all_aggregated"))


AGE = "date_diff('second', CAST(event_date AS TIMESTAMP), TIMESTAMP '2024-01-21') / 86400.0"


@job("flt05_event_date_kept", f"SELECT id FROM news_events WHERE {AGE} <= 5 AND {AGE} >= -400", "news_events")
def _(f):
    return FL.split_by_event_date(f.news_events, GATE)[0].select("id")


@job("flt05_event_date_dropped", f"SELECT id, round({AGE}, 1) AS age_days FROM news_events WHERE {AGE} > 5 OR {AGE} < -400", "news_events")
def _(f):
    return FL.split_by_event_date(f.news_events, GATE)[1].select("id", F.round("age_days", 1).alias("age_days"))


SEARCH_GATE = f"""SELECT * FROM (SELECT *, {ISO_TS} AS ts, trim(title, {W}) AS t FROM raw_items)
WHERE length(t) >= 6 AND date_diff('second', ts, TIMESTAMP '@now') BETWEEN -3600 AND 48 * 3600 AND (authority <> 2
  OR regexp_matches(t || ' ' || summary, '{D.TOPIC_CRYPTO.replace("'", "''")}')
  OR regexp_matches(t || ' ' || summary, '{D.TOPIC_MARKET.replace("'", "''")}'))"""


@job("flt06_search_dedup", f"""
WITH RECURSIVE o AS (SELECT item_id, {URL_KEY} AS u, {TITLE_KEY} AS k, row_number() OVER (ORDER BY item_id) AS r FROM ({SEARCH_GATE.replace("@now", "2024-01-30 12:00:00")})),
walk AS (  -- the pass in order, with the keys of what it kept
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS item_id, false AS kept, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS ks
  UNION ALL
  SELECT r, item_id, free, CASE WHEN free AND u <> '' THEN list_append(us, u) ELSE us END, CASE WHEN free THEN list_append(ks, k) ELSE ks END
  FROM (SELECT o.*, w.us, w.ks, NOT list_contains(w.us, o.u) AND NOT list_contains(w.ks, o.k) AS free FROM walk w JOIN o ON o.r = w.r + 1))
SELECT item_id FROM walk WHERE kept
""", "raw_items")
def _(f):
    return FL.search_dedup(FL.search_gate(f.raw_items, "2024-01-30 12:00:00"), "item_id").select("item_id")


@job("flt06_search_gate", f"SELECT item_id FROM ({SEARCH_GATE.replace("@now", "2024-01-30 00:00:00")})", "raw_items")
def _(f):
    return FL.search_gate(f.raw_items, "2024-01-30 00:00:00").select("item_id")


@job("flt07_url_and_title_keys", f"SELECT item_id, {URL_KEY} AS url_key, {TITLE_KEY} AS title_key FROM raw_items", "raw_items")
def _(f):
    return f.raw_items.select("item_id", X.url_key(F.col("url")).alias("url_key"), X.title_key(T.strip(F.col("title"))).alias("title_key"))


@job("flt07_page_url_keys", f"SELECT page_id, {URL_KEY} AS url_key FROM pages")
def _(f):
    return f.pages.select("page_id", X.url_key(F.col("url")).alias("url_key"))


@job("flt08_url_hash", "SELECT page_id, sha256(regexp_replace(trim(url), '/+$', '')) AS url_hash FROM pages")
def _(f):
    return f.pages.select("page_id", X.url_hash(F.col("url")).alias("url_hash"))


@job("flt09_clean_titles", rf"""
SELECT item_id, CASE WHEN length(bare) >= 8 THEN bare ELSE trim(regexp_replace(t, '\s+-\s+[^-]{{2,40}}$', ''), {W}) END AS title
FROM (SELECT *, regexp_replace(rtrim(substring(t, 1, length(t) - length(source)), {W}), '\s*-$', '') AS bare
      FROM (SELECT *, trim(title || ' - ' || source, {W}) AS t FROM raw_items))
""", "raw_items")
def _(f):
    return f.raw_items.select("item_id", X.clean_result_title(F.concat("title", F.lit(" - "), "source"), F.col("source")).alias("title"))


@job("flt10_domain_authority", """
SELECT page_id, domain, CASE WHEN domain LIKE 'blog.%' THEN 4 ELSE 2 END AS domain_authority FROM (
  SELECT page_id, regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\\.', '') AS domain FROM pages)
WHERE domain NOT LIKE '%.org'
""")
def _(f):
    hosts = f.pages.select(X.host(F.col("url")).alias("domain")).distinct()
    listed = hosts.where("domain LIKE 'blog.%'").withColumn("authority", F.lit(4))
    blocked = hosts.where("domain LIKE '%.org'")
    return FL.domain_authority(f.pages, listed, blocked).select("page_id", "domain", "domain_authority")


@job("flt11_channel_authority", """
SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN CAST(substring(source, 4) AS INT) + 2 ELSE 2 END AS named_authority
FROM documents
""")
def _(f):
    table = f.nation.where("n_nationkey BETWEEN 1 AND 3").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_nationkey") + 2).alias("authority"))
    return FL.named_authority(f.documents, "source", table, 2).select("doc_id", "named_authority")


@job("flt12_author_authority", """
SELECT tweet_id, CASE WHEN kol_username IN ('user1', 'user2', 'user3') THEN CAST(substring(kol_username, 5) AS INT) + 2
  WHEN followers >= 100000 THEN 3 ELSE 2 END AS author_authority FROM posts
""", "posts")
def _(f):
    known = f.nation.where("n_nationkey BETWEEN 1 AND 3").select(
        F.concat(F.lit("User"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_nationkey") + 2).alias("authority"))
    return FL.author_authority(f.posts, known).select("tweet_id", "author_authority")


ENG = "(like_count + retweet_count + reply_count + quote_count)"
REASON = rf"""CASE WHEN length({CLEAN_POST}) < CASE WHEN regexp_matches({CLEAN_POST}, '[一-鿿]') THEN 18 ELSE 40 END THEN 'short'
  WHEN len(regexp_extract_all(tweet_body, '\$[A-Za-z]{{2,10}}\b')) > 4 OR len(regexp_extract_all(tweet_body, '#[\w\p{{L}}]+')) > 5
    OR len(regexp_extract_all(tweet_body, '@[\w\p{{L}}]+')) > 5 THEN 'tag_spam'
  WHEN regexp_matches(tweet_body, '(?i)\bgiveaway\b|\bdm\s+(me|us)\b|\blink\s+in\s+bio\b') THEN 'spam'
  WHEN {ENG} < CASE category WHEN 'security' THEN 3 WHEN 'listing' THEN 5 WHEN 'regulation' THEN 10 WHEN 'market' THEN 40
    ELSE 10 END THEN 'engagement'
  WHEN followers < 500 THEN 'followers' WHEN bio = 'boost your coin' THEN 'promo' END"""


@job("flt13_post_quality_reasons", f"SELECT COALESCE({REASON}, 'pass') AS reason, count(*) AS posts FROM posts GROUP BY 1", "posts")
def _(f):
    return f.posts.groupBy(F.coalesce(FL.post_reject_reason(), F.lit("pass")).alias("reason")).agg(F.count("*").alias("posts"))


@job("flt14_copied_posts", f"""
SELECT tweet_id, {CLEAN_POST} AS body FROM (SELECT *, row_number() OVER (PARTITION BY {POST_KEY} ORDER BY tweet_id) AS rn FROM posts)
WHERE rn = 1
""", "posts")
def _(f):
    return FL.first_by_post_key(f.posts, "tweet_id").select("tweet_id", X.clean_post(F.col("tweet_body")).alias("body"))


@job("flt15_search_posts", f"""
WITH RECURSIVE o AS (SELECT tweet_id, kol_username AS a, {POST_KEY} AS k, {ENG} AS e, row_number() OVER (ORDER BY tweet_id) AS r FROM posts WHERE {REASON} IS NULL),
walk AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS tweet_id, CAST(NULL AS BIGINT) AS e, false AS kept, CAST([] AS VARCHAR[]) AS authors, CAST([] AS VARCHAR[]) AS ks
  UNION ALL
  SELECT r, tweet_id, e, free, CASE WHEN free THEN list_append(authors, a) ELSE authors END, CASE WHEN free THEN list_append(ks, k) ELSE ks END
  FROM (SELECT o.*, w.authors, w.ks, len(list_filter(w.authors, lambda x: x = o.a)) < 3 AND NOT list_contains(w.ks, o.k) AS free FROM walk w JOIN o ON o.r = w.r + 1))
SELECT tweet_id, CAST(e AS INT) AS engagement FROM walk WHERE kept ORDER BY e DESC, tweet_id LIMIT 150
""", "posts")
def _(f):
    return FL.search_posts(f.posts, "tweet_id").select("tweet_id", "engagement")


@job("flt16_priority", """
SELECT item_id, CASE WHEN desk IN ('Reuters', 'FT-Home') THEN 0
  WHEN desk LIKE 'dxFeed%' THEN CASE WHEN matched_symbols LIKE 'SPX%' THEN 1 ELSE 4 END
  WHEN desk = 'CoinDesk' OR type = 'market_signal' THEN 2 ELSE 3 END AS priority
FROM (SELECT *, CASE authority WHEN 1 THEN 'Reuters' WHEN 2 THEN 'dxFeed-a' WHEN 3 THEN 'CoinDesk' WHEN 4 THEN 'FT-Home'
  ELSE 'other' END AS desk FROM raw_items)
""", "raw_items")
def _(f):
    desk = F.element_at(F.array(*[F.lit(x) for x in ("Reuters", "dxFeed-a", "CoinDesk", "FT-Home", "other")]), F.col("authority"))
    return f.raw_items.withColumn("source", desk).select("item_id", FL.staging_priority().alias("priority"))


@job("flt17_feed_by_sector", """
SELECT id, importance_score FROM news_events WHERE list_contains(sectors, 'ASIA') AND date >= DATE '2024-01-23'
ORDER BY importance_score DESC, id LIMIT 20 OFFSET 20
""", "news_events")
def _(f):
    p = FL.feed_predicate("2024-01-28 00:00:00", sector="ASIA")
    return FL.feed_page(f.news_events, p, limit=20, offset=20).select("id", "importance_score")


@job("flt17_feed_by_source_prefix", """
SELECT id FROM news_events WHERE len(list_filter(source_names, lambda s: s LIKE 'X/user1%')) > 0 AND event_tier = 'A'
  AND date >= DATE '2024-01-05' AND date <= DATE '2024-01-25' AND is_rumor = false ORDER BY time_get_data DESC, id LIMIT 50
""", "news_events")
def _(f):
    p = FL.feed_predicate(NOW, source="X/user1*", tier="A", is_rumor=False, date_from="2024-01-05", date_to="2024-01-25")
    return FL.feed_page(f.news_events, p, sort="time", limit=50).select("id")


@job("flt17_feed_total_of_run", """
SELECT count(*) AS total FROM news_events WHERE time_get_data >= TIMESTAMP '2024-01-10 08:00:00'
  AND time_get_data < TIMESTAMP '2024-01-10 20:00:00'
""", "news_events")
def _(f):
    return f.news_events.where(FL.feed_predicate(NOW, run_at="2024-01-10 08:00:00")).agg(F.count("*").alias("total"))


@job("flt18_posts_by_likes", "SELECT tweet_id, like_count FROM posts ORDER BY like_count DESC, tweet_id LIMIT 100", "posts")
def _(f):
    return FL.posts_page(f.posts, sort="likes", limit=100).select("tweet_id", "like_count")


@job("flt18_posts_of_event", """
SELECT tweet_id, like_count FROM posts WHERE tweet_id IN (SELECT s.x_tweet_id FROM (SELECT unnest(sources) AS s FROM news_events
  WHERE id = 15))
""", "posts news_events")
def _(f):
    return FL.posts_of_event(f.news_events, f.posts, 15).select("tweet_id", "like_count")


@job("flt19_json_columns", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def _(f):
    return FL.parse_json_columns(f.events.select("event_id", "props"), {"props": "struct<k:bigint>"}).select(
        "event_id", F.col("props.k").alias("k"))


@job("flt20_local_time", f"""
SELECT item_id, CASE WHEN published_at LIKE '%Z' OR published_at LIKE '%+08:00'
  THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS local_time
FROM (SELECT *, {ISO_TS} AS ts FROM raw_items)
""", "raw_items")
def _(f):
    return f.raw_items.select("item_id", T.wall_text(T.local_wall(F.col("published_at"))).alias("local_time"))
