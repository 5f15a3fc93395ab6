"""Jobs over content tags and entities (TAG)."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tags as TG
from .registry import job

EQUITIES = ["C7", "C8"]


@job("tag01_published_sectors", """
WITH t AS (SELECT id, unnest(sector_tags) AS t, generate_subscripts(sector_tags, 1) AS i FROM news_events),
r AS (SELECT id, t.sector AS s, round(t.relevance, 3) AS rel, t.anchor AS a, i FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel DESC, i) AS rn FROM r WHERE rel >= 0.55 AND a <> '')
SELECT e.id, COALESCE(x.sectors, '') AS sectors, d.detail FROM (SELECT id FROM news_events) AS e
LEFT JOIN (SELECT id, string_agg(s, ',' ORDER BY rn) AS sectors FROM p WHERE rn <= 3 GROUP BY id) AS x ON x.id = e.id
JOIN (SELECT id, string_agg(s, ',' ORDER BY rel DESC, i) AS detail FROM r GROUP BY id) AS d ON d.id = e.id
""", "news_events")
def _(f):
    sectors, detail = TG.publish_sectors(F.col("sector_tags"))
    return f.news_events.select("id", F.array_join(sectors, ",").alias("sectors"),
                                F.array_join(F.transform(detail, lambda t: t["sector"]), ",").alias("detail"))


@job("tag02_sentiment", """
SELECT id, round(s, 3) AS sentiment_score, CASE WHEN s >= 0.1 THEN 'bullish' WHEN s <= -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment
FROM (SELECT id, greatest(-1, least(1, COALESCE(sentiment_score * 1.7, 0.0))) AS s FROM news_events)
""", "news_events")
def _(f):
    score, label = TG.sentiment(F.col("sentiment_score") * 1.7)
    return f.news_events.select("id", score.alias("sentiment_score"), label.alias("sentiment"))


@job("tag03_clean_entities", """
SELECT id, array_to_string(list_slice(list_filter([event_subject, source_names[1], event_action, lang, event_tier, market_scope, 'g', 'h'],
  lambda n: n IS NOT NULL AND n <> '' AND n <> source_names[1]), 1, 6), '|') AS entities FROM news_events
""", "news_events")
def _(f):
    names = F.array("event_subject", F.upper(F.col("source_names")[0]), F.concat(F.lit(" "), "event_action"), "lang", "event_tier",
                    "market_scope", F.lit("g"), F.lit("h"))
    ents = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("type")))
    out = TG.clean_entities(ents, F.concat(F.lit("X/"), F.col("source_names")[0]))
    return f.news_events.select("id", F.array_join(F.transform(out, lambda e: e["name"]), "|").alias("entities"))


def _index(f):
    pinned = f.nation.where("n_nationkey IN (1, 2)").select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("symbol"),
        F.when(F.col("n_nationkey") == 1, "coin-201").otherwise("coin-none").alias("coin_id"))
    exchange = f.coin_universe.groupBy("symbol").agg((F.min("price") * 1.2).alias("price")).where("symbol != 'C9'").withColumn(
        "price", F.when(F.col("symbol") == "C11", F.col("price") * 9).otherwise(F.col("price")))
    return TG.coin_index(f.coin_universe, pinned, exchange, "C0")


INDEX = """u AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY market_cap DESC, market_cap_rank) AS rn,
    count(*) OVER (PARTITION BY symbol) AS n FROM coin_universe WHERE market_cap > 0),
x AS (SELECT symbol, min(price) * 1.2 * CASE WHEN symbol = 'C11' THEN 9 ELSE 1 END AS xp FROM coin_universe WHERE symbol <> 'C9' GROUP BY symbol),
btc AS (SELECT max(market_cap) AS bc FROM u WHERE symbol = 'C0'),
c AS (SELECT a.symbol, a.n, b.market_cap AS cap2, CASE WHEN a.symbol = 'C1' THEN p.coin_id WHEN a.symbol = 'C2' THEN NULL ELSE a.coin_id END AS coin_id,
    CASE WHEN a.symbol = 'C1' THEN p.market_cap ELSE a.market_cap END AS cap, CASE WHEN a.symbol = 'C1' THEN p.price ELSE a.price END AS price,
    CASE WHEN a.symbol = 'C1' THEN p.name ELSE a.name END AS name, xp
  FROM u AS a LEFT JOIN u AS b ON b.symbol = a.symbol AND b.rn = 2 LEFT JOIN u AS p ON p.symbol = a.symbol AND p.coin_id = 'coin-201'
  LEFT JOIN x ON x.symbol = a.symbol WHERE a.rn = 1),
idx AS (SELECT symbol, n AS n_candidates, CASE WHEN symbol = 'C2' OR (symbol = 'C1' AND coin_id IS NULL) THEN 'unknown'
    WHEN symbol <> 'C1' AND cap < 5 * cap2 THEN 'ambiguous' WHEN greatest(xp / price, price / xp) > 1.5 THEN 'ambiguous' ELSE 'ok' END AS status,
    cap, name, coin_id, xp FROM c)"""
TIER = "CASE WHEN cap >= 1e11 THEN 'mega' WHEN cap >= 1e10 THEN 'large' WHEN cap >= 1e9 THEN 'mid' WHEN cap >= 1e8 THEN 'small' ELSE 'micro' END"


@job("tag04_coin_index", f"""
WITH {INDEX} SELECT symbol, status, n_candidates, CASE WHEN status = 'ok' THEN round(cap, 2) END AS market_cap_usd,
  CASE WHEN status = 'ok' THEN round(cap / bc, 8) END AS btc_ratio FROM idx, btc
""", "coin_universe")
def _(f):
    return _index(f).select("symbol", "status", "n_candidates", "market_cap_usd", "btc_ratio")


MENTIONS = """m AS (SELECT id, upper(coin) AS symbol, min(i) AS pos FROM (SELECT id, unnest(coins) AS coin, generate_subscripts(coins, 1) AS i FROM news_events)
  GROUP BY 1, 2)"""


@job("tag04_resolved_coins", f"""
WITH {INDEX}, {MENTIONS} SELECT id, m.symbol, CASE WHEN m.symbol IN ('C7', 'C8') THEN 'equity' ELSE COALESCE(status, 'unknown') END AS status,
  CASE WHEN status = 'ok' AND m.symbol NOT IN ('C7', 'C8') THEN round(cap, 2) END AS market_cap_usd FROM m LEFT JOIN idx ON idx.symbol = m.symbol
""", "coin_universe news_events")
def _(f):
    return TG.resolve_coins(f.news_events, _index(f), EQUITIES).select("id", "symbol", "status", "market_cap_usd")


@job("tag05_cap_tier_and_class", f"""
SELECT coin_id, CASE WHEN market_cap IS NULL THEN 'unknown' ELSE {TIER.replace('cap >=', 'market_cap >=')} END AS cap_tier,
  CASE WHEN name LIKE '%tokenized stock' THEN 'tokenized_equity' ELSE 'coin' END AS asset_class FROM coin_universe
""", "coin_universe")
def _(f):
    return f.coin_universe.select("coin_id", TG.cap_tier(F.col("market_cap")).alias("cap_tier"),
                                  TG.asset_class(F.col("symbol"), F.col("name"), F.col("coin_id")).alias("asset_class"))


@job("tag06_labels", """
SELECT coin_id, CASE WHEN market_cap IS NULL THEN '—' WHEN market_cap >= 1e12 THEN format('${:.2f}T', market_cap / 1e12)
  WHEN market_cap >= 1e9 THEN format('${:.2f}B', market_cap / 1e9) WHEN market_cap >= 1e6 THEN format('${:.2f}M', market_cap / 1e6)
  WHEN market_cap >= 1e3 THEN format('${:.2f}K', market_cap / 1e3) ELSE format('${:.0f}', market_cap) END AS cap_label,
  CASE WHEN r IS NULL THEN '—' WHEN r >= 1 THEN format('BTC 市值的 {:.2f} 倍', r) WHEN r >= 0.0001 THEN format('BTC 市值的 {:.2f}%（{:.4f} 倍）', r * 100, r)
  ELSE format('BTC 市值的 {:.4f}%（{:.6f} 倍）', r * 100, r) END AS ratio_label
FROM (SELECT *, market_cap / 4.1e10 AS r FROM coin_universe)
""", "coin_universe")
def _(f):
    return f.coin_universe.select("coin_id", TG.cap_label(F.col("market_cap")).alias("cap_label"),
                                  TG.btc_ratio_label(F.col("market_cap") / 4.1e10).alias("ratio_label"))


@job("tag07_primary_coins", f"""
WITH {INDEX}, {MENTIONS}, r AS (SELECT id, m.symbol, pos, CASE WHEN status = 'ok' AND m.symbol NOT IN ('C7', 'C8') THEN round(cap, 2) END AS v, cap
  FROM m LEFT JOIN idx ON idx.symbol = m.symbol)
SELECT id, count(*) AS coins, arg_max(symbol, v - pos * 1e-6) AS primary_coin, max(v) AS primary_coin_market_cap,
  arg_max({TIER}, v - pos * 1e-6) AS coin_cap_tier FROM r GROUP BY id
""", "coin_universe news_events")
def _(f):
    return TG.primary_coins(TG.resolve_coins(f.news_events, _index(f), EQUITIES)).select(
        "id", "coins", "primary_coin", "primary_coin_market_cap", "coin_cap_tier")


@job("tag07_coin_status_counts", f"""
WITH {INDEX}, {MENTIONS} SELECT status, count(*) AS mentions, count(DISTINCT id) AS events FROM (SELECT id,
  CASE WHEN m.symbol IN ('C7', 'C8') THEN 'equity' ELSE COALESCE(status, 'unknown') END AS status FROM m LEFT JOIN idx ON idx.symbol = m.symbol)
GROUP BY status
""", "coin_universe news_events")
def _(f):
    return TG.coin_status_counts(TG.resolve_coins(f.news_events, _index(f), EQUITIES))


def _listed(f):
    """A dictionary of listed symbols: the nations as companies, four of them under well-known symbols."""
    return f.sql("""SELECT CASE n_nationkey WHEN 0 THEN 'SPX' WHEN 1 THEN 'MSFT' WHEN 2 THEN 'NVDA' WHEN 3 THEN 'BTC' ELSE 'N' || CAST(n_nationkey AS STRING) END AS symbol,
        n_name AS name, CASE n_nationkey WHEN 0 THEN 'index' WHEN 3 THEN 'crypto' ELSE 'us_stock' END AS market FROM nation""")


@job("tag08_symbol_entities", """
SELECT item_id AS id, s AS symbol, s <> 'SPX' AS tradable FROM (SELECT item_id, unnest(CASE WHEN matched_symbols LIKE 'SPX%'
  THEN ['SPX', 'MSFT', 'BTC'] WHEN matched_symbols LIKE 'NVDA%' THEN ['NVDA'] ELSE CAST([] AS VARCHAR[]) END) AS s FROM raw_items)
""", "raw_items")
def _(f):
    e = f.raw_items.withColumnRenamed("item_id", "id")
    return TG.symbol_entities(e, _listed(f)).select("id", "entity.symbol", "entity.tradable")


NAMES = """
SELECT CAST(n_nationkey AS INT) AS turn, CASE n_nationkey WHEN 0 THEN '比特币' WHEN 1 THEN '市场' WHEN 2 THEN '项目方' WHEN 3 THEN '关税提高到1' WHEN 4 THEN 'gains' ELSE lower(n_name) END AS name,
  CASE n_nationkey WHEN 0 THEN 'COIN' WHEN 4 THEN 'COIN' ELSE 'N' || CAST(n_nationkey AS STRING) END AS symbol, CASE WHEN n_nationkey < 4 THEN 'zh' ELSE 'en' END AS script FROM nation
UNION ALL SELECT DISTINCT CAST(100 + p_partkey % 20 AS INT), 'coin c' || CAST(p_partkey % 20 AS STRING), 'P' || CAST(p_partkey % 20 AS STRING), 'en' FROM part"""


def _names(f):
    """A name dictionary of nations and parts."""
    return f.sql(f"SELECT *, 'us_stock' AS market, name AS shown FROM ({NAMES})")


@job("tag09_title_entities", f"""
SELECT id, symbol, min(turn) AS turn FROM news_events JOIN ({NAMES}) AS n
  ON contains(CASE WHEN script = 'zh' THEN title_zh ELSE lower(title_zh || ' ' || title_en) END, name) GROUP BY id, symbol
""", "news_events")
def _(f):
    return TG.title_entities(f.news_events, _names(f)).select("id", "entity.symbol", "turn")


@job("tag10_coin_entities", f"""
WITH {INDEX}, {MENTIONS} SELECT id, m.symbol, xp IS NOT NULL AS tradable FROM m JOIN idx ON idx.symbol = m.symbol
WHERE status = 'ok' AND m.symbol NOT IN ('C7', 'C8')
""", "coin_universe news_events")
def _(f):
    return TG.coin_entities(TG.resolve_coins(f.news_events, _index(f), EQUITIES)).select("id", "entity.symbol", "entity.tradable")


@job("tag11_tradable_entities", f"""
WITH {INDEX}, {MENTIONS}, co AS (SELECT id, m.symbol, xp IS NOT NULL AS tradable, 'crypto' AS market, market_cap_rank AS rank, 0 AS part, pos AS turn FROM m JOIN idx ON idx.symbol = m.symbol
  LEFT JOIN coin_universe AS cu ON cu.coin_id = idx.coin_id WHERE status = 'ok' AND m.symbol NOT IN ('C7', 'C8')),
sy AS (SELECT item_id AS id, s.symbol, s.symbol <> 'SPX' AS tradable, s.market, NULL AS rank, 1 AS part, s.turn FROM (SELECT item_id,
  unnest(CASE WHEN matched_symbols LIKE 'SPX%' THEN [{{'symbol': 'SPX', 'market': 'index', 'turn': 0}}, {{'symbol': 'MSFT', 'market': 'us_stock', 'turn': 1}}, {{'symbol': 'BTC', 'market': 'crypto', 'turn': 2}}]
              WHEN matched_symbols LIKE 'NVDA%' THEN [{{'symbol': 'NVDA', 'market': 'us_stock', 'turn': 0}}] ELSE [] END) AS s FROM raw_items)),
ti AS (SELECT id, symbol, true AS tradable, 'us_stock' AS market, NULL AS rank, 2 AS part, min(turn) AS turn FROM news_events JOIN ({NAMES}) AS n
  ON contains(CASE WHEN script = 'zh' THEN title_zh ELSE lower(title_zh || ' ' || title_en) END, name) GROUP BY id, symbol),
pool AS (SELECT *, row_number() OVER (PARTITION BY id, symbol ORDER BY part, turn) AS r FROM (SELECT * FROM co UNION ALL SELECT * FROM sy UNION ALL SELECT * FROM ti)),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT tradable, CASE market WHEN 'crypto' THEN 0 WHEN 'us_stock' THEN 1 ELSE 2 END,
  CASE WHEN rank IS NULL OR rank = 0 THEN 9999 ELSE rank END, part, turn) AS k FROM pool WHERE r = 1)
SELECT id, string_agg(symbol, ',' ORDER BY k) AS entities, CAST(count(*) FILTER (tradable) AS INT) AS tradable_count FROM top WHERE k <= 6 GROUP BY id
""", "coin_universe news_events raw_items")
def _(f):
    coins = TG.coin_entities(TG.resolve_coins(f.news_events, _index(f), EQUITIES))
    symbols = TG.symbol_entities(f.raw_items.withColumnRenamed("item_id", "id"), _listed(f))
    return TG.tradable_entities(coins, symbols, TG.title_entities(f.news_events, _names(f))).select(
        "id", F.array_join(F.transform("tradable_entities", lambda e: e["symbol"]), ",").alias("entities"), "tradable_count")


@job("tag11_tradable_counts", f"""
WITH {INDEX}, {MENTIONS}, ce AS (SELECT id, m.symbol, xp IS NOT NULL AS t FROM m JOIN idx ON idx.symbol = m.symbol
  WHERE status = 'ok' AND m.symbol NOT IN ('C7', 'C8'))
SELECT id, count(*) FILTER (t) AS tradable_count FROM ce GROUP BY id
""", "coin_universe news_events")
def _(f):
    coins = TG.coin_entities(TG.resolve_coins(f.news_events, _index(f), EQUITIES))
    none = coins.where("false")
    return TG.tradable_entities(coins, none, none).select("id", F.col("tradable_count").cast("long").alias("tradable_count"))


@job("tag12_social_interactions", """
SELECT e.id, CAST(COALESCE(sum(like_count + retweet_count + reply_count + quote_count), 0) AS BIGINT) AS social_interactions FROM news_events AS e
LEFT JOIN (SELECT id, unnest(sources) AS s FROM news_events) AS x ON x.id = e.id LEFT JOIN posts ON tweet_id = s.x_tweet_id GROUP BY e.id
""", "news_events posts")
def _(f):
    return TG.social_interactions(f.news_events, f.posts)


@job("tag13_attached_posts", """
SELECT e.id, COALESCE(string_agg(DISTINCT CAST(tweet_id AS STRING), ','), '') AS posts FROM news_events AS e
LEFT JOIN (SELECT id, unnest(sources) AS s FROM news_events) AS x ON x.id = e.id LEFT JOIN posts ON tweet_id = s.x_tweet_id GROUP BY e.id
""", "news_events posts")
def _(f):
    return TG.attach_posts(f.news_events, f.posts).select("id", F.array_join(F.transform(
        "x_posts", lambda p: p["tweet_id"].cast("string")), ",").alias("posts"))
