"""News-shaped views over the benchmark tables, written once for Spark SQL and for the SQL checker.

The same text, with a few dialect words swapped, feeds the jobs and their reference queries.
Every view covers its whole table.
"""

from __future__ import annotations

NOW = "2024-02-01 00:00:00"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


class SparkWords:
    name = "spark"

    @staticmethod
    def ts(text):
        return f"TIMESTAMP_NTZ'{text}'"

    @staticmethod
    def add_hours(ts, n):
        return f"timestampadd(HOUR, {n}, {ts})"

    @staticmethod
    def add_seconds(ts, n):
        return f"timestampadd(SECOND, {n}, {ts})"

    @staticmethod
    def iso(ts):
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")"

    @staticmethod
    def day_text(ts):
        return f"date_format({ts}, 'yyyy-MM-dd')"

    @staticmethod
    def wall(ts):
        return f"CAST({ts} AS TIMESTAMP_NTZ)"

    @staticmethod
    def arr(*xs):
        return f"array({', '.join(xs)})"

    @staticmethod
    def struct(**kv):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in kv.items()) + ")"

    @staticmethod
    def hour(ts):
        return f"hour({ts})"

    @staticmethod
    def json_int(col, key):
        return f"CAST(get_json_object({col}, '$.{key}') AS BIGINT)"

    empty_text_array = "CAST(array() AS ARRAY<STRING>)"


class DuckWords(SparkWords):
    name = "duck"

    @staticmethod
    def ts(text):
        return f"TIMESTAMP '{text}'"

    @staticmethod
    def add_hours(ts, n):
        return f"({ts} + to_hours(CAST({n} AS BIGINT)))"

    @staticmethod
    def add_seconds(ts, n):
        return f"({ts} + to_seconds(CAST({n} AS BIGINT)))"

    @staticmethod
    def iso(ts):
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

    @staticmethod
    def day_text(ts):
        return f"strftime({ts}, '%Y-%m-%d')"

    @staticmethod
    def wall(ts):
        return f"CAST({ts} AS TIMESTAMP)"

    @staticmethod
    def arr(*xs):
        return f"[{', '.join(xs)}]"

    @staticmethod
    def struct(**kv):
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in kv.items()) + ")"

    @staticmethod
    def json_int(col, key):
        return f"CAST(json_extract_string({col}, '$.{key}') AS BIGINT)"

    empty_text_array = "CAST([] AS VARCHAR[])"


def _pick(expr: str, values: list[str | None]) -> str:
    """CASE over 0..n-1; None gives NULL."""
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def _quoted(values):
    return [None if v is None else f"'{v}'" for v in values]


def raw_items(w) -> str:
    """Documents as fetched news items, with blank, bad, stale and future publish times."""
    base = w.ts("2024-01-01 00:00:00")
    return f"""
SELECT doc_id AS item_id,
       CASE WHEN k % 5 = 2 THEN 'X/user' || CAST(doc_id % 40 AS STRING) ELSE source END AS source,
       CASE WHEN doc_id % 61 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
       CASE WHEN doc_id % 47 = 0 THEN '' ELSE
         'https://www.site' || CAST(k AS STRING) || '.example.com/a/'
         || CAST(CASE WHEN doc_id % 9 = 0 THEN doc_id - doc_id % 18 ELSE doc_id END AS STRING)
         || CASE WHEN doc_id % 4 = 0 THEN '/' ELSE '' END END AS url,
       text AS summary,
       CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 43 = 0 THEN 'soon'
            WHEN doc_id % 41 = 0 THEN '2024-02-09T00:00:00Z'
            WHEN doc_id % 6 = 0 THEN {w.iso(w.add_hours(base, 'doc_id % 720'))}
            WHEN doc_id % 6 = 1 THEN {w.iso(w.add_hours(base, 'doc_id % 720'))} || '+08:00'
            ELSE {w.iso(w.add_hours(base, 'doc_id % 720'))} || 'Z' END AS published_at,
       lang,
       CAST(1 + k % 5 AS INT) AS authority,
       {_pick('k % 5', _quoted(['rss', 'web_search', 'x', 'scraper', 'benzinga']))} AS type,
       CASE WHEN k % 5 = 2 THEN CAST(doc_id AS STRING) END AS tweet_id,
       CASE WHEN doc_id % 3 = 0 THEN 'SPX,MSFT, X:BTCUSD' WHEN doc_id % 7 = 0 THEN 'NVDA,ZZZZ' ELSE '' END
         AS matched_symbols
FROM (SELECT *, CAST(substring(source, 4, 10) AS INT) AS k FROM documents) AS d
"""


def staging(w) -> str:
    """The staged queue: priority, fetch time, consumed and deferred marks."""
    base = w.ts("2024-01-01 00:00:00")
    return f"""
SELECT doc_id AS id, source, split_part(text, chr(10), 1) AS title,
       'https://site.example.com/' || CAST(doc_id AS STRING) AS url,
       CAST(doc_id % 5 AS INT) AS priority,
       {w.add_hours(base, 'doc_id % 743')} AS fetched_at,
       CASE WHEN doc_id % 3 = 0 THEN {w.add_hours(base, '(doc_id % 743) + 1')} END AS consumed_at,
       CAST(CASE WHEN doc_id % 11 = 0 THEN doc_id % 4 ELSE 0 END AS INT) AS deferred_count,
       CASE WHEN doc_id % 11 = 0 THEN {_pick('doc_id % 3', _quoted(['budget', 'quota', 'switch']))} END
         AS defer_reason,
       CAST(n_chars AS BIGINT) AS n_chars
FROM documents
"""


def posts(w) -> str:
    """Conversation turns as posts with authors and counters."""
    base = w.ts("2024-01-01 00:00:00")
    pid = "(conv_id * 100 + turn)"
    return f"""
SELECT {pid} AS tweet_id, 'user' || CAST((conv_id * 7 + turn) % 40 AS STRING) AS kol_username,
       text AS tweet_body, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role,
       CAST(({pid} * 13) % 997 AS INT) AS like_count, CAST(({pid} * 7) % 101 AS INT) AS retweet_count,
       CAST(({pid} * 5) % 53 AS INT) AS reply_count, CAST({pid} % 17 AS INT) AS quote_count,
       CAST(({pid} * 31) % 9973 AS INT) AS impression_count,
       CAST(({pid} * 911) % 250000 AS INT) AS followers,
       CASE WHEN conv_id % 19 = 0 THEN 'boost your coin' ELSE 'reporter' END AS bio,
       {_pick('conv_id % 5', _quoted(['security', 'listing', 'regulation', 'market', 'other']))} AS category,
       {w.add_hours(base, f'{pid} % 720')} AS published_at
FROM conversations
"""


_TITLE_ZH = """
CASE d.doc_id % 8
  WHEN 0 THEN '比特币跌' || CAST(d.doc_id % 40 AS STRING) || '%'
  WHEN 1 THEN '份额升至' || CAST(d.doc_id % 90 AS STRING) || '.4%'
  WHEN 2 THEN 'Coin C' || CAST(d.doc_id % 20 AS STRING) || ' gains ' || CAST(d.doc_id % 12 AS STRING) || '.5% today'
  WHEN 3 THEN split_part(d.text, chr(10), 1)
  WHEN 4 THEN '关税提高到' || CAST(d.doc_id % 30 AS STRING) || '%后市场整体明显上涨' || CAST(d.doc_id % 9 AS STRING) || '%'
  WHEN 5 THEN '2025年升值约' || CAST(d.doc_id % 70 AS STRING) || '%'
  WHEN 6 THEN '项目方否认被盗传闻 ' || CAST(d.doc_id % 50 AS STRING)
  ELSE '突发 市场暴跌 ' || CAST(d.doc_id % 50 AS STRING) END
"""


def news_events(w) -> str:
    """Documents with their labels and vectors as scored, tagged events."""
    base = w.ts("2024-01-01 00:00:00")
    hours = w.add_hours(base, "d.doc_id % 720")
    fetched = w.add_hours(base, "d.doc_id % 720 + 1 + d.doc_id % 5")
    s1 = w.struct(name="d.source", url="'https://news.site' || CAST(k AS STRING) || '.example.com/' || CAST(d.doc_id AS STRING)",
                  type=_pick("k % 5", _quoted(["rss", "web_search", "rss", "scraper", "calendar"])),
                  authority="CAST(1 + k % 5 AS INT)", x_tweet_id="CAST(NULL AS BIGINT)")
    tweet = "CAST((d.doc_id % 250) * 100 + d.doc_id % 3 AS BIGINT)"
    s2 = w.struct(name="'X/user' || CAST(d.doc_id % 40 AS STRING)", url="'https://x.example.com/s/' || CAST(d.doc_id AS STRING)",
                  type="'x'", authority="CAST(3 AS INT)", x_tweet_id=tweet)
    s3 = w.struct(name="'src' || CAST((k + 1) % 20 AS STRING)", url="'https://wire.example.net/' || CAST(d.doc_id AS STRING)",
                  type="'rss'", authority="CAST(5 AS INT)",
                  x_tweet_id=f"CASE WHEN d.doc_id % 5 = 0 THEN {tweet} END")
    coin = lambda e: f"'C' || CAST({e} AS STRING)"
    sector = lambda e: _pick(e, _quoted(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]))
    tag = lambda name, rel, anchor: w.struct(sector=name, relevance=rel, anchor=anchor)
    return f"""
SELECT d.doc_id AS id, d.doc_id AS ord,
       split_part(d.text, chr(10), 1) AS title_en, {_TITLE_ZH} AS title_zh,
       d.text AS description_short_en, d.text AS description_short_zh,
       CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE {hours} END AS time_event,
       {fetched} AS time_get_data,
       CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE CAST({hours} AS DATE) END AS date,
       {w.day_text(w.add_hours(base, 'd.doc_id % 720 - (d.doc_id % 13) * 24'))} AS event_date,
       {_pick('d.doc_id % 6', _quoted(['S', 'A', 'B', 'C', 'D', 'X']))} AS event_tier,
       {_pick('d.doc_id % 9', _quoted(['us_stock', 'crypto', 'macro_policy', 'social_signal', 'general', 'hk_stock',
                                       'jp_stock', 'cn_a_share', None]))} AS market_scope,
       {_pick('d.doc_id % 7', _quoted(['cross_market', 'market_index', 'sector', 'multi_asset', 'single_asset',
                                       None, 'other']))} AS breadth_level,
       CASE WHEN d.doc_id % 31 = 0 THEN NULL ELSE CAST(d.doc_id % 100 AS DOUBLE) / 100 END AS score_market_impact,
       CAST(d.doc_id % 17 AS DOUBLE) / 16 AS score_authority,
       CASE WHEN d.doc_id % 27 = 0 THEN NULL ELSE CAST(d.doc_id % 13 AS DOUBLE) / 12 END AS score_quality,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(d.doc_id % 11 AS DOUBLE) / 10 END AS score_punch,
       CAST(d.doc_id % 19 AS DOUBLE) / 18 AS score_timeliness,
       CAST(d.doc_id % 23 AS DOUBLE) / 22 AS score_hotness,
       CAST((d.doc_id * 7919) % 10007 AS DOUBLE) / 10006 AS importance_score,
       CAST(CASE WHEN d.doc_id % 14 = 0 THEN 5 ELSE 6 END AS INT) AS scoring_version,
       CAST(CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE (d.doc_id * 37) % 2000 END AS INT) AS social_interactions,
       CAST(1 + d.doc_id % 9 AS INT) AS source_count,
       CAST(1 + d.doc_id % 3 AS INT) AS merged_sources_count,
       CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST(d.doc_id % 21 - 10 AS DOUBLE) / 10 END AS sentiment_score,
       COALESCE(l.toxic, 0) = 1 AS is_rumor, CAST(l.quality AS DOUBLE) AS credibility_score,
       {_pick('d.doc_id % 5', _quoted(['VERIFIED', 'PROBABLE', 'UNVERIFIED', 'DISPUTED', None]))}
         AS verification_status,
       CAST(d.doc_id % 8 - 1 AS INT) AS tradable_raw,
       CAST(CASE WHEN d.doc_id % 8 < 1 THEN 0 ELSE d.doc_id % 8 - 1 END AS INT) AS tradable_count,
       CASE d.doc_id % 4 WHEN 0 THEN {w.arr(coin('d.doc_id % 25'))}
         WHEN 1 THEN {w.arr(coin('d.doc_id % 25'), coin('(d.doc_id + 3) % 25'))}
         WHEN 2 THEN {w.arr(coin('d.doc_id % 25'), coin('d.doc_id % 25'), coin('(d.doc_id * 3) % 25'))}
         ELSE {w.empty_text_array} END AS coins,
       {w.arr(sector('d.doc_id % 5'), sector('(d.doc_id + 2) % 5'))} AS sectors,
       {w.arr(tag(sector('d.doc_id % 5'), 'CAST(d.doc_id % 101 AS DOUBLE) / 100',
                  "CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE 'anchor' END"),
              tag(sector('(d.doc_id + 1) % 5'), 'CAST((d.doc_id * 3) % 103 AS DOUBLE) / 102', "'a'"),
              tag(sector('(d.doc_id + 2) % 5'), 'CAST((d.doc_id * 7) % 107 AS DOUBLE) / 106', "'b'"),
              tag(sector('(d.doc_id + 3) % 5'), 'CAST((d.doc_id * 11) % 109 AS DOUBLE) / 108', "'c'"))} AS sector_tags,
       CASE WHEN d.doc_id % 12 < 3 THEN {w.arr(s1)} WHEN d.doc_id % 12 < 7 THEN {w.arr(s1, s2)}
            ELSE {w.arr(s1, s2, s3)} END AS sources,
       CASE WHEN d.doc_id % 12 < 3 THEN {w.arr('d.source')}
            ELSE {w.arr('d.source', "'X/user' || CAST(d.doc_id % 40 AS STRING)")} END AS source_names,
       'subject ' || CAST(d.doc_id % 60 AS STRING) AS event_subject,
       {_pick('d.doc_id % 11', _quoted(['net_inflow', 'net_outflow', 'listed', 'delisted', 'approved', 'rejected',
                                        'banned', 'launched', 'shutdown', 'price_surge', '']))} AS event_action,
       CASE WHEN d.doc_id % 10 = 0 THEN 'fp' || CAST((d.doc_id * 7919) % 400 AS STRING)
            ELSE 'fp_' || CAST(d.doc_id AS STRING) END AS event_fingerprint,
       CAST(1 + k % 5 AS INT) AS authority,
       d.lang AS lang, e.embedding AS embedding
FROM (SELECT *, CAST(substring(source, 4, 10) AS INT) AS k FROM documents) AS d
LEFT JOIN labels AS l ON l.doc_id = d.doc_id
LEFT JOIN embeddings AS e ON e.vec_id = d.doc_id
"""


def coin_universe(w) -> str:
    """Parts as coins: about two hundred symbols, several coins on each."""
    return f"""
SELECT 'coin-' || CAST(p_partkey AS STRING) AS coin_id, 'C' || CAST(p_partkey % 200 AS STRING) AS symbol,
       CASE WHEN p_partkey % 33 = 0 THEN p_name || ' tokenized stock' ELSE p_name END AS name,
       CASE WHEN p_partkey % 90 = 0 THEN NULL
            ELSE p_retailprice * (CASE p_partkey % 7 WHEN 0 THEN 100000 WHEN 1 THEN 1000000 WHEN 2 THEN 10000000
                                  WHEN 3 THEN 100000000 ELSE 1000 END) * (1 + p_size) END AS market_cap,
       CAST(p_partkey + 1 AS INT) AS market_cap_rank, p_retailprice AS price
FROM part
"""


def tickers(w) -> str:
    """Suppliers and their account balance as 24-hour market rows."""
    return """
SELECT CASE s_suppkey WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'BNB' WHEN 3 THEN 'SOL' WHEN 4 THEN 'XRP'
         WHEN 5 THEN 'USDC' WHEN 6 THEN 'AUP' ELSE 'C' || CAST(s_suppkey AS STRING) END
       || CASE WHEN s_suppkey % 13 = 12 THEN 'BTC' ELSE 'USDT' END AS symbol,
       CASE WHEN s_suppkey % 37 = 36 THEN 'n/a' ELSE CAST(s_acctbal AS STRING) END AS "lastPrice",
       CAST(CAST((s_suppkey * 17) % 121 - 60 AS DOUBLE) / 2 AS STRING) AS "priceChangePercent",
       CAST((s_suppkey * 7919000) % 97000000 AS STRING) AS "quoteVolume",
       CAST(s_acctbal * 1.1 AS STRING) AS "highPrice", CAST(s_acctbal * 0.9 AS STRING) AS "lowPrice",
       CAST(s_acctbal * (1 + CAST(s_suppkey % 9 - 4 AS DOUBLE) / 20) AS STRING) AS "openPrice",
       CAST(s_suppkey * 11 AS BIGINT) AS count
FROM supplier
"""


def candles(w) -> str:
    """Order lines as daily candles: one row for each symbol and ship day."""
    return f"""
SELECT symbol, day, max(price) AS high, min(price) AS low, round(sum(amount), 2) AS quote_volume
FROM (SELECT 'C' || CAST(l_partkey % 20 AS STRING) AS symbol, CAST(l_shipdate AS DATE) AS day,
             l_extendedprice / l_quantity / 20 AS price, l_extendedprice AS amount
      FROM lineitem) AS t
GROUP BY symbol, day
"""


def behaviour_log(w) -> str:
    """The event log with a coin on every row: views, exposures and orders."""
    return f"""
SELECT user_id, event_type, {w.wall('ts')} AS ts, value, CAST({w.wall('ts')} AS DATE) AS day,
       {w.hour('ts')} AS hr, 'C' || CAST({w.json_int('props', 'k')} % 8 AS STRING) AS coin
FROM events
"""


def holdings(w) -> str:
    """Customers as holders of up to two coins."""
    return """
SELECT c_custkey AS user_id, 'C' || CAST(c_custkey % 8 AS STRING) AS coin, c_acctbal AS usd FROM customer
UNION ALL
SELECT c_custkey AS user_id, 'C' || CAST((c_custkey + 1 + c_nationkey % 7) % 8 AS STRING) AS coin, c_acctbal / 2 AS usd
FROM customer
"""


def shocks(w) -> str:
    """Daily range of each coin in the event log, as percent of the coin's mean range, with its shock level."""
    return """
SELECT coin, day, rng, CASE WHEN rng > 135 THEN 2 WHEN rng > 115 THEN 1 ELSE 0 END AS shock
FROM (SELECT coin, day, 100 * r / avg(r) OVER (PARTITION BY coin) AS rng
      FROM (SELECT coin, day, CAST(max(value) - min(value) AS DOUBLE) AS r FROM behaviour_log GROUP BY coin, day) AS t) AS u
"""


def institutions(w) -> str:
    """A small institution table: names, host names and account handles with their tier."""
    tier = _pick("n_nationkey % 4", _quoted(["official", "top_media", "established", "secondary"]))
    weaker = _pick("n_nationkey % 3", _quoted(["top_media", "established", "secondary"]))
    return f"""
SELECT 'name' AS kind, 'src' || CAST(n_nationkey AS STRING) AS key, 'i' || CAST(n_nationkey % 6 AS STRING) AS inst,
       {tier} AS tier FROM nation WHERE n_nationkey < 10
UNION ALL SELECT 'domain', 'site' || CAST(n_nationkey AS STRING) || '.example.com', 'd' || CAST(n_nationkey % 4 AS STRING),
       {tier} FROM nation WHERE n_nationkey BETWEEN 10 AND 17
UNION ALL SELECT 'handle', 'user' || CAST(n_nationkey AS STRING), 'h' || CAST(n_nationkey AS STRING),
       {weaker} FROM nation
UNION ALL SELECT 'name_tier', 'src4', '', 'secondary' FROM nation WHERE n_nationkey = 4
"""


VIEWS = {
    "institutions": institutions,
    "raw_items": raw_items, "staging": staging, "posts": posts, "news_events": news_events,
    "coin_universe": coin_universe, "tickers": tickers, "candles": candles, "behaviour_log": behaviour_log,
    "holdings": holdings, "shocks": shocks,
}
_NEEDS = {"shocks": ["behaviour_log"]}


class Feed:
    """Views over one data folder, as DataFrames."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str):
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}", name)

    def sql(self, query: str, *views: str):
        """Run Spark SQL over the named views; base tables are bound to the folder's files."""
        text = f"{with_views(SparkWords, *views)} {query}"
        bound = {t: self.table(t) for t in TABLES if _mentions(text, t)}
        for t in bound:
            text = _bind(text, t)
        return self.spark.sql(text.replace('"lastPrice"', "lastPrice").replace('"priceChangePercent"', "priceChangePercent")
                              .replace('"quoteVolume"', "quoteVolume").replace('"highPrice"', "highPrice")
                              .replace('"lowPrice"', "lowPrice").replace('"openPrice"', "openPrice"), **bound)


def _pattern(table):
    import re
    return re.compile(rf"\b(FROM|JOIN)\s+{table}\b")


def _mentions(text, table):
    return bool(_pattern(table).search(text))


def _bind(text, table):
    return _pattern(table).sub(lambda m: f"{m.group(1)} {{{table}}}", text)


def with_views(words, *views: str) -> str:
    """A WITH clause that defines ``views`` and what they need."""
    order: list[str] = []
    for v in views:
        for need in _NEEDS.get(v, []) + [v]:
            if need not in order:
                order.append(need)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v](words)})" for v in order)


def duck(query: str, *views: str) -> str:
    """Checker SQL: ``query`` may open with its own WITH list after the views."""
    head = with_views(DuckWords, *views)
    body = query.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if head and body.startswith(opening):
            return f"{opening}{head[5:]},\n{body[len(opening):]}"
    return f"{head}\n{body}"
