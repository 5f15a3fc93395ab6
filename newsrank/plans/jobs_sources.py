"""Jobs over landed records and tables (SRC)."""

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..operators import filters as FL
from ..operators.verify import resolve_sources
from ..session import new_folder
from ..sources import records as R
from ..sources import database as DB
from ..sources import export as EX
from ..sources import tables as TB
from .reference_data import demo_institutions
from .registry import job
from .views import NOW

WATCHED = ["SPX", "MSFT", "NVDA"]


def page_entries(f):
    return f.sql("""SELECT page_id AS pos, split_part(split_part(url, '://', 2), '/', 1) AS source,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS link, html AS summary,
        CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2024-01-05T00:00:00Z' END AS published,
        '2024-01-06T00:00:00Z' AS updated, 'en' AS lang, CAST(3 AS INT) AS authority FROM pages""")


@job("src01_feed_items", r"""
SELECT source, trim(title, E' \t\n\r') AS title, link AS url,
  trim(substring(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), 1, 500), E' \t\n\r') AS summary,
  CASE WHEN pos % 3 = 0 THEN '2024-01-06T00:00:00Z' ELSE '2024-01-05T00:00:00Z' END AS published_at
FROM (SELECT page_id AS pos, split_part(split_part(url, '://', 2), '/', 1) AS source, html, url AS link,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY page_id) AS rn
      FROM pages) WHERE rn <= 100 AND trim(title, E' \t\n\r') <> ''
""")
def _(f):
    return R.feed_items(page_entries(f)).select("source", "title", "url", "summary", "published_at")


@job("src02_list_page_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
       unnest(regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label,
       unnest(generate_series(1, len(regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)))) AS i
  FROM pages),
b AS (SELECT *, trim(regexp_replace(label, '<[^>]+>', '', 'g')) AS title FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS rn FROM b
      WHERE length(title) >= 4 AND href LIKE '/%'),
d AS (SELECT page_id, i, href, title, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM c WHERE rn = 1)
SELECT page_id, CAST(pos AS INT) AS pos, href, title FROM d WHERE pos < 25
""")
def _(f):
    return R.page_links(f.pages, "^/", 4)


@job("src03_wire_records", """
SELECT id, 'wire-' || source AS source, trim(title, E' \\t\\n\\r') AS title, published_at,
  array_to_string(list_filter(syms, lambda s: s IN ('SPX', 'MSFT', 'NVDA')), ',') AS matched_symbols
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY item_id) AS rn FROM (
  SELECT *, item_id - item_id % 2 AS id, string_split(matched_symbols, ',') AS syms FROM raw_items
  WHERE trim(title, E' \\t\\n\\r') <> '')) WHERE rn = 1
""", "raw_items")
def _(f):
    rec = f.raw_items.select((F.col("item_id") - F.col("item_id") % 2).alias("id"), F.col("item_id").alias("pos"),
                             "title", F.col("summary").alias("body"), F.col("published_at").alias("time"),
                             F.col("source").alias("provider"), F.split("matched_symbols", ",").alias("symbols"))
    return R.wire_records(rec, WATCHED).select("id", "source", "title", "published_at", "matched_symbols")


@job("src04_news_api_records", r"""
SELECT page_id AS id, trim(title, E' \t\n\r') AS title, url,
  trim(regexp_replace(CASE WHEN page_id % 4 = 0 THEN 'Teaser <b>' || url || '</b> end' ELSE html END, '<[^>]+>', ' ', 'g'),
       E' \t\n\r') AS summary, 'A' || CAST(page_id % 9 AS STRING) || ',B' AS matched_symbols, 'wire' AS type
FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
WHERE trim(title, E' \t\n\r') <> ''
""")
def _(f):
    rec = f.pages.select(
        F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url",
        F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("html")).alias("body"),
        F.concat(F.lit("Teaser <b>"), "url", F.lit("</b> end")).alias("teaser"), F.lit("").alias("published"),
        F.array(F.concat(F.lit("A"), (F.col("page_id") % 9).cast("string")), F.lit("B")).alias("tickers"))
    return R.news_api_records(rec, "Wire").select("id", "title", "url", "summary", "matched_symbols", "type")


@job("src05_backfill_demotion", """
SELECT s.id, CASE WHEN source < 'src2' AND consumed_at IS NULL AND CAST(fetched_at AS DATE) < DATE '2024-01-20'
  AND priority < 4 THEN 4 ELSE priority END AS priority FROM staging AS s
""", "staging")
def _(f):
    s = f.staging.withColumn("url_hash", X.url_hash(F.col("url"))).withColumn("day", F.to_date("fetched_at"))
    back = f.documents.where("source < 'src2'").select(
        X.url_hash(F.concat(F.lit("https://site.example.com/"), F.col("doc_id").cast("string"), F.lit("/")))
        .alias("url_hash"))
    return R.demote_backfill(s, back, F.lit("2024-01-20").cast("date")).select("id", "priority")


@job("src06_calendar_items", """
SELECT id, array_to_string(list_slice(coins, 1, 3), '/') || ': ' || title || ' (' || shown || ')' AS title,
  '[催化剂日历] ' || array_to_string(coins, '/') || ' 事件：' || title || '（时间：' || shown || '）'
  || CASE WHEN description <> '' THEN ' — ' || substring(description, 1, 300) ELSE '' END AS summary
FROM (SELECT p_partkey AS id, trim(p_name) AS title, p_brand AS shown, p_type AS description,
  CASE WHEN p_partkey % 6 = 0 THEN CAST([] AS VARCHAR[])
       ELSE ['C' || CAST(p_partkey % 7 AS STRING), 'D', 'E', 'F'] END AS coins FROM part)
WHERE len(coins) > 0 AND title <> ''
""")
def _(f):
    ev = f.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("shown_date"),
        F.col("p_type").alias("description"),
        F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit(""))).otherwise(
            F.array(F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string")), F.lit("d"), F.lit("e"), F.lit("f")))
        .alias("coins"))
    return R.calendar_items(ev, "2024-02-01").select("id", "title", "summary")


@job("src07_timeline_news_items", """
SELECT tweet_id, 'X/' || kol_username AS source,
  'https://x.com/' || kol_username || '/status/' || CAST(tweet_id AS STRING) AS url,
  substring(replace(trim(regexp_replace(trim(tweet_body, E' \\t\\n\\r'), 'https?://\\S+', '', 'g'), E' \\t\\n\\r'), chr(10), ' '),
            1, 180) AS title,
  substring(trim(tweet_body, E' \\t\\n\\r'), 1, 500) AS summary
FROM posts WHERE length(trim(tweet_body, E' \\t\\n\\r')) >= 30
""", "posts")
def _(f):
    return R.timeline_items(f.posts)[0].select("tweet_id", "source", "url", "title", "summary")


@job("src07_timeline_raw_posts", """
SELECT tweet_id, kol_username, like_count, retweet_count, reply_count, quote_count, impression_count
FROM posts WHERE length(trim(tweet_body, E' \\t\\n\\r')) >= 30
""", "posts")
def _(f):
    return R.timeline_items(f.posts)[1].select("tweet_id", "kol_username", "like_count", "retweet_count", "reply_count",
                                               "quote_count", "impression_count")


@job("src08_merge_post_sources", """
SELECT tweet_id, 'timeline' AS via FROM posts WHERE role = 'user'
UNION ALL
SELECT tweet_id, 'search' AS via FROM posts WHERE tweet_id NOT IN (SELECT tweet_id FROM posts WHERE role = 'user')
""", "posts")
def _(f):
    p = f.posts
    return R.merge_post_sources(p.where("role = 'user'").select("tweet_id", F.lit("timeline").alias("via")),
                                p.select("tweet_id", F.lit("search").alias("via")))


CLEAN = """
SELECT * FROM (SELECT symbol, left(symbol, length(symbol) - 4) AS base, TRY_CAST("lastPrice" AS DOUBLE) AS last,
  TRY_CAST("priceChangePercent" AS DOUBLE) AS change_pct, TRY_CAST("quoteVolume" AS DOUBLE) AS quote_volume,
  TRY_CAST("highPrice" AS DOUBLE) AS high, TRY_CAST("lowPrice" AS DOUBLE) AS low,
  TRY_CAST("openPrice" AS DOUBLE) AS open, count AS trades FROM tickers)
WHERE symbol LIKE '%USDT' AND symbol NOT LIKE '%UPUSDT' AND symbol NOT LIKE '%DOWNUSDT' AND base NOT IN ('USDC')
  AND last IS NOT NULL AND change_pct IS NOT NULL AND quote_volume IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL
  AND open IS NOT NULL AND last > 0 AND quote_volume >= 5000000
"""


@job("src09_clean_tickers", f"SELECT symbol, base, last, change_pct, quote_volume, trades FROM ({CLEAN})", "tickers")
def _(f):
    return R.clean_tickers(f.tickers).select("symbol", "base", "last", "change_pct", "quote_volume", "trades")


@job("src10_closed_candles", """
SELECT symbol, day, high, low, quote_volume, CAST(rn - 1 AS INT) AS age FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM candles) WHERE rn BETWEEN 2 AND 91
""", "candles")
def _(f):
    return R.closed_candles(f.candles)


@job("src11_open_interest", """
SELECT base, COALESCE(max(CASE WHEN kind = 0 THEN oi END), max(CASE WHEN kind = 1 THEN oi END)) AS oi_usd
FROM (SELECT 'C' || CAST(l_suppkey AS STRING) AS base,
        CAST(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_linenumber % 3 END AS INT) AS kind,
        l_extendedprice AS oi FROM lineitem) WHERE kind < 2 GROUP BY base
""")
def _(f):
    kind = F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(F.col("l_linenumber") % 3)
    rows = f.lineitem.select(
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string"),
                 F.when(kind == 0, "-USDT-SWAP").when(kind == 1, "-USD-SWAP").otherwise("-SPOT")).alias("inst_id"),
        F.col("l_extendedprice").cast("string").alias("oi_usd"))
    return R.open_interest_by_base(rows)


@job("src12_funding_apr", """
SELECT COALESCE(a.base, b.base) AS base, round(COALESCE(a.r * 3 * 365 * 100, b.r * 24 * 365 * 100), 6) AS apr
FROM (SELECT s_suppkey AS base, s_acctbal / 10000000 AS r FROM supplier WHERE s_nationkey < 15) AS a
FULL JOIN (SELECT s_suppkey AS base, s_acctbal / 50000000 AS r FROM supplier WHERE s_nationkey > 10) AS b ON a.base = b.base
""")
def _(f):
    s = f.supplier.select(F.col("s_suppkey").alias("base"), "s_nationkey", "s_acctbal")
    a = s.where("s_nationkey < 15").select("base", (F.col("s_acctbal") / 10000000).alias("rate"))
    b = s.where("s_nationkey > 10").select("base", (F.col("s_acctbal") / 50000000).alias("rate"))
    return R.funding_apr(a, b).select("base", F.round("apr", 6).alias("apr"))


def liquidation_rows(f):
    """One record a row: no group is gathered, the sums by base combine before their shuffle."""
    return f.lineitem.select((F.col("l_partkey") % 20).alias("c"), F.array(F.struct(
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000).cast("string").alias("ts"),
        F.col("l_quantity").cast("string").alias("sz"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("string").alias("bk_px"),
        F.when(F.col("l_returnflag") == "A", "long").otherwise("short").alias("pos_side"))).alias("details")).select(
        F.concat(F.lit("C"), F.col("c").cast("string"), F.lit("-USDT-SWAP")).alias("inst_id"), "details")


@job("src14_queue_head", """
SELECT id, priority, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM (
  SELECT * FROM staging WHERE consumed_at IS NULL AND fetched_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY
  AND source NOT IN ('src3') ORDER BY priority, fetched_at DESC, id LIMIT 400)
""", "staging")
def _(f):
    return R.queue_head(f.staging, NOW, disabled=("src3",)).select("id", "priority", T.wall_text(F.col("fetched_at"))
                                                                   .alias("fetched_at"))


def _old_new(f):
    cols = ["id", "title_en", "source_count", "importance_score", "social_interactions", "scoring_version"]
    e = f.news_events
    old = e.where("source_count <= 6").select(*cols)
    new = e.where("source_count >= 4").select(
        "id", F.concat(F.lit("new "), "title_en").alias("title_en"), (F.col("source_count") + 1).alias("source_count"),
        (F.col("importance_score") / 2).alias("importance_score"),
        (F.col("social_interactions") - 100).alias("social_interactions"), F.lit(7).alias("scoring_version"))
    return old, new


@job("src16_event_upsert", """
SELECT id, CASE WHEN source_count <= 6 THEN title_en ELSE 'new ' || title_en END AS title_en,
  CASE WHEN source_count >= 4 THEN source_count + 1 ELSE source_count END AS source_count,
  CASE WHEN source_count >= 4 THEN importance_score / 2 ELSE importance_score END AS importance_score,
  CASE WHEN source_count > 6 THEN social_interactions - 100 ELSE social_interactions END AS social_interactions,
  CASE WHEN source_count >= 4 THEN 7 ELSE scoring_version END AS scoring_version
FROM news_events
""", "news_events")
def _(f):
    return TB.upsert_events(*_old_new(f))


@job("src17_post_upsert", """
SELECT tweet_id, kol_username, CASE WHEN turn = 1 THEN like_count + 5 ELSE like_count END AS like_count,
  CASE WHEN turn = 1 THEN 'again' ELSE 'first' END AS fetched_at FROM posts
""", "posts")
def _(f):
    p = f.posts
    old = p.select("tweet_id", "kol_username", "like_count", F.lit("first").alias("fetched_at"))
    new = p.where("turn = 1").select("tweet_id", F.lit("renamed").alias("kol_username"),
                                     (F.col("like_count") + 5).alias("like_count"), F.lit("again").alias("fetched_at"))
    return TB.upsert_posts(old, new)


@job("src20_column_updates", """
SELECT id, CASE WHEN source_count >= 5 THEN 'CHECKED' ELSE verification_status END AS verification_status,
  CASE WHEN scoring_version = 5 THEN round(sentiment_score / 2, 4) ELSE sentiment_score END AS sentiment_score,
  CASE WHEN event_tier = 'S' THEN 'C1' END AS primary_coin,
  CASE WHEN is_rumor THEN 9 ELSE tradable_count END AS tradable_count FROM news_events
""", "news_events")
def _(f):
    e = f.news_events
    return TB.update_columns(
        e.select("id", "verification_status", "sentiment_score", "tradable_count"),
        e.where("source_count >= 5").select("id", F.lit("CHECKED").alias("verification_status")),
        e.where("scoring_version = 5").select("id", F.round(F.col("sentiment_score") / 2, 4).alias("sentiment_score")),
        e.where("event_tier = 'S'").select("id", F.lit("C1").alias("primary_coin")),
        e.where("is_rumor").select("id", F.lit(9).alias("tradable_count")))


@job("src15_database_upsert", """
SELECT id, CASE WHEN source_count <= 6 THEN title_en ELSE 'new ' || title_en END AS title_en,
  CASE WHEN source_count >= 4 THEN importance_score / 2 ELSE importance_score END AS importance_score, CASE WHEN source_count >= 4 THEN 7 ELSE scoring_version END AS scoring_version
FROM news_events WHERE CASE WHEN source_count >= 4 THEN importance_score / 2 ELSE importance_score END >= 0.25
""", "news_events")
def _(f):
    """Events written to a database, merged there with new ones, and read back in eight key ranges with the filter pushed down."""
    old, new = _old_new(f)
    cols = ["id", "title_en", "source_count", "importance_score", "social_interactions", "scoring_version"]
    db, table = DB.embedded(f.spark, "newsrank_db"), f"EVENTS_{uuid.uuid4().hex[:8]}".upper()
    db.upsert(old.select(cols), table, "id", TB.upsert_events)
    db.upsert(new.select(cols), table, "id", TB.upsert_events)
    return db.read(table, "id", 8).where("importance_score >= 0.25").select("id", "title_en", "importance_score", "scoring_version")


def exported_groups(f):
    """Documents as rows of duplicate groups, whole texts as titles."""
    return f.documents.select(
        F.floor(F.col("doc_id") / 3).alias("group_id"), (F.col("doc_id") % 3).alias("image_index"), F.concat(F.lit("scan "), "doc_id", F.lit(".png")).alias("image_name"),
        "source", F.col("text").alias("title"), (F.col("doc_id") % 8 / 8.0).alias("similarity_to_group"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2 == 0).alias("is_duplicate"))


@job("src18_exported_groups", """
SELECT CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) AS group_id, CAST(doc_id % 3 AS STRING) AS image_index, 'scan ' || CAST(doc_id AS STRING) || '.png' AS image_name,
  source, nullif(text, '') AS title, format('{:.3f}', (doc_id % 8) / 8) AS similarity, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '是' ELSE '否' END AS duplicate
FROM documents
""")
def _(f):
    """A table with tabs, quotes and line ends in its fields, exported under its titles and read back."""
    folder = new_folder(f.spark, "export")
    files = EX.export(EX.group_table(exported_groups(f)), EX.GROUP_COLUMNS, folder, "groups", ["group_id", "image_index"])
    return EX.read_export(f.spark, [f"{folder}/{name}" for name in files], EX.GROUP_COLUMNS)


@job("src19_source_catalog", """
SELECT COALESCE(r.name, s.name) AS name, COALESCE(s.events, 0) AS events FROM
  (SELECT DISTINCT source AS name FROM documents UNION SELECT 'unused source') AS r
  FULL JOIN (SELECT name, count(*) AS events FROM (SELECT unnest(source_names) AS name FROM news_events) GROUP BY name) AS s
  ON r.name = s.name
""", "news_events")
def _(f):
    registry = f.documents.select(F.col("source").alias("name")).union(
        f.documents.select(F.lit("unused source").alias("name"))).distinct().select(
        "name", F.lit("").alias("url"), F.lit("rss").alias("type"))
    inst = demo_institutions(f)
    return R.source_catalog(registry, f.news_events, lambda df: resolve_sources(df, inst)).select("name", "events")


ISO_TS = """CASE WHEN regexp_matches(published_at, '^[0-9]{4}-') THEN
  CAST(substring(published_at, 1, 19) AS TIMESTAMP) - CASE WHEN published_at LIKE '%+08:00' THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END END"""


@job("src21_union_and_gate", f"""
SELECT item_id, CASE WHEN ts > TIMESTAMP '2024-01-22' THEN '2024-01-21 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
  AS published_ts FROM (SELECT *, {ISO_TS} AS ts FROM raw_items WHERE title <> '')
WHERE ts >= TIMESTAMP '2024-01-14' AND NOT regexp_matches(title, '(?i)chinese stocks?|china stocks?|A股')
""", "raw_items")
def _(f):
    frames = [f.raw_items.where(F.col("type") == t) for t in ("rss", "web_search", "x", "scraper", "benzinga")]
    return R.union_sources(frames, "2024-01-21 00:00:00").select(
        "item_id", T.wall_text(F.col("published_ts")).alias("published_ts"))


@job("src22_search_items", r"""
SELECT query, pos, domain, title, authority FROM (
  SELECT item_id % 23 AS query, item_id AS pos,
    regexp_extract(url, '://www\.([^/]*)/', 1) AS domain,
    CASE WHEN length(regexp_replace(bare, '\s*-$', '')) >= 8 THEN regexp_replace(bare, '\s*-$', '')
         ELSE trim(regexp_replace(t, '\s+-\s+[^-]{2,40}$', ''), E' \t\n\r') END AS title,
    CASE WHEN url LIKE '%://www.site1.%' OR url LIKE '%://www.site6.%' THEN 4 ELSE 2 END AS authority,
    row_number() OVER (PARTITION BY item_id % 23 ORDER BY item_id) AS rn
  FROM (SELECT *, rtrim(substring(t, 1, length(t) - length(source)), E' \t\n\r') AS bare
        FROM (SELECT *, trim(title || ' - ' || source, E' \t\n\r') AS t FROM raw_items WHERE url <> '')))
WHERE rn <= 30 AND domain <> 'site3.example.com'
""", "raw_items")
def _(f):
    r = f.raw_items.where("url != ''")
    results = r.select((F.col("item_id") % 23).alias("query"), F.col("item_id").alias("pos"),
                       F.concat("title", F.lit(" - "), "source").alias("title"), F.col("source").alias("publisher"),
                       F.col("url").alias("publisher_url"), F.col("url").alias("link"), "summary",
                       F.col("published_at").alias("published"), "lang")
    listed = f.nation.where("n_nationkey IN (1, 6)").select(
        F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example.com")).alias("domain"),
        F.lit(4).alias("authority"))
    blocked = f.nation.where("n_nationkey = 3").select(
        F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example.com")).alias("domain"))
    return R.search_items(results, listed, blocked).select("query", "pos", "domain", "title", "authority")
