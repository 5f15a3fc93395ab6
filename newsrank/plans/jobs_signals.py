"""Jobs over market signals (SIG, SRC13, STR3-5 in batch form)."""

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import signals as SG
from ..sources import records as R
from .jobs_sources import CLEAN, liquidation_rows
from .registry import job

TIERED = f"""tk AS ({CLEAN}), t AS (SELECT *, CASE WHEN base IN ('BTC', 'ETH') THEN 'T1' WHEN quote_volume >= 30000000 THEN 'T2'
  WHEN quote_volume >= 10000000 THEN 'T3' ELSE 'T4' END AS tier FROM tk),
lim AS (SELECT *, CASE tier WHEN 'T1' THEN 5.0 WHEN 'T2' THEN 8.0 WHEN 'T3' THEN 15.0 ELSE 25.0 END AS lim FROM t)"""
AT = "2024-02-01 00:00:00"
MAJORS = ["BTC", "ETH", "BNB", "SOL", "XRP", *[f"C{i}" for i in range(7, 20)]]
MAJ = "('" + "', '".join(MAJORS) + "')"


def _tickers(f):
    return R.clean_tickers(f.tickers)


@job("sig01_tiers", f"WITH {TIERED} SELECT symbol, tier, CASE tier WHEN 'T3' THEN 4 WHEN 'T4' THEN 3 ELSE 5 END AS authority FROM t", "tickers")
def _(f):
    return SG.with_tier(_tickers(f)).select("symbol", "tier", SG.authority_of(F.col("tier")).alias("authority"))


@job("sig02_price_moves", f"""
WITH {TIERED} SELECT symbol, tier, abs(change_pct) AS magnitude, round(abs(change_pct) / lim, 6) AS salience,
  (SELECT count(*) FROM t AS o WHERE abs(o.change_pct) > abs(lim.change_pct)) + 1 AS market_rank FROM lim WHERE abs(change_pct) >= lim
""", "tickers")
def _(f):
    return SG.price_moves(_tickers(f)).select("symbol", "tier", "magnitude", F.round("salience", 6).alias("salience"), "market_rank")


def _last_prices(f):
    return f.supplier.select(
        F.concat(F.lit("C"), F.col("s_suppkey").cast("string"), F.lit("USDT")).alias("symbol"), (F.col("s_acctbal") * 0.8).alias("price"),
        F.timestamp_add("HOUR", -(F.col("s_suppkey") % 40), T.wall(AT)).alias("updated_at"))


@job("sig03_level_breaks", f"""
WITH {TIERED}, p AS (SELECT 'C' || CAST(s_suppkey AS STRING) || 'USDT' AS ps, s_acctbal * 0.8 AS price FROM supplier WHERE s_suppkey % 40 <= 24),
b AS (SELECT t.*, COALESCE(price, open) AS bl FROM t LEFT JOIN p ON ps = symbol WHERE base IN {MAJ}),
s AS (SELECT *, pow(10, floor(log10(last))) / 2 AS st FROM b WHERE bl > 0),
l AS (SELECT *, unnest(generate_series(CAST(floor(least(bl, last) / st) AS BIGINT) + 1, least(CAST(floor(greatest(bl, last) / st) AS BIGINT),
  CAST(floor(least(bl, last) / st) AS BIGINT) + 12))) * st AS level FROM s)
SELECT symbol, round(level, 6) AS level, CASE WHEN last > level THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN tier = 'T1' THEN 3.0::DOUBLE ELSE 2.0 END AS salience FROM l WHERE abs(last - level) / level * 100 >= 0.25
""", "tickers")
def _(f):
    return SG.level_breaks(_tickers(f), _last_prices(f), AT, MAJORS).select("symbol", F.round("level", 6).alias("level"), "direction", "salience")


def _closed(f):
    c = R.closed_candles(f.candles)
    return c.withColumn("symbol", F.concat("symbol", F.lit("USDT")))


CLOSED = """cl AS (SELECT symbol || 'USDT' AS cs, high AS h, low AS l, quote_volume AS q, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) - 1 AS age
  FROM candles), cd AS (SELECT * FROM cl WHERE age BETWEEN 1 AND 90)"""


@job("sig04_period_extremes", f"""
WITH {TIERED}, {CLOSED}, w AS (SELECT cs, win, max(h) AS top, min(l) AS bottom, count(*) AS n FROM cd, (SELECT unnest([30, 90]) AS win) WHERE age <= win GROUP BY 1, 2)
SELECT symbol, CAST(win AS INT) AS "window", CASE WHEN high > top THEN 'high' ELSE 'low' END AS direction,
  round(1.5 + win / 90.0 + CASE WHEN tier = 'T1' THEN 1 ELSE 0 END, 6) AS salience FROM t JOIN w ON cs = symbol
WHERE base IN {MAJ} AND n >= win * 0.8 AND (high > top OR low < bottom)
""", "tickers candles")
def _(f):
    return SG.period_extremes(_tickers(f), _closed(f), majors=MAJORS).select("symbol", "window", "direction", F.round("salience", 6).alias("salience"))


@job("sig05_volume_spikes", f"""
WITH {TIERED}, {CLOSED}, m AS (SELECT cs, list(q ORDER BY q)[4] AS med FROM cd WHERE age <= 7 GROUP BY cs HAVING count(*) >= 7)
SELECT symbol, round(quote_volume / med, 4) AS ratio, round(least(3.0, quote_volume / med / 3), 4) AS salience FROM t JOIN m ON cs = symbol
WHERE med > 0 AND quote_volume >= 10000000 AND quote_volume / med >= 3
""", "tickers candles")
def _(f):
    return SG.volume_spikes(_tickers(f), _closed(f)).select("symbol", F.round("ratio", 4).alias("ratio"), F.round("salience", 4).alias("salience"))


def _funding(f):
    base = F.concat(F.lit("C"), F.col("s_suppkey").cast("string"))
    fund = f.supplier.select(base.alias("base"), ((F.col("s_acctbal") - 4000) / 50).alias("apr"))
    oi = f.supplier.where("s_nationkey < 20").select(base.alias("base"), (F.col("s_acctbal") * 4000).alias("oi_usd"))
    return fund, oi


@job("sig06_funding_extremes", f"""
WITH {TIERED}, x AS (SELECT 'C' || CAST(s_suppkey AS STRING) AS b, (s_acctbal - 4000) / 50 AS apr, CASE WHEN s_nationkey < 20 THEN s_acctbal * 4000 END AS oi FROM supplier)
SELECT b AS base, COALESCE(tier, 'T3') AS tier, CASE WHEN apr >= 50 THEN 'pos' ELSE 'neg' END AS direction, round(abs(apr), 6) AS magnitude
FROM x LEFT JOIN t ON symbol = b || 'USDT' WHERE (apr >= 50 OR apr <= -30) AND NOT COALESCE(oi <> 0 AND oi < 10000000, false)
""", "tickers")
def _(f):
    return SG.funding_extremes(*_funding(f), _tickers(f)).select("base", "tier", "direction", F.round("magnitude", 6).alias("magnitude"))


def _interest(f):
    ts = F.col("ts").cast("timestamp_ntz")
    return f.events.groupBy(F.concat(F.lit("C"), (F.col("user_id") % 60).cast("string")).alias("base"), F.date_trunc("HOUR", ts).alias("at")).agg(
        F.round(F.sum("value") * 1e6, 2).alias("oi_usd"))


@job("sig07_interest_jumps", f"""
WITH {TIERED}, h AS (SELECT 'C' || CAST(user_id % 60 AS STRING) AS b, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hr_at, round(sum(value) * 1e6, 2) AS oi FROM events GROUP BY 1, 2),
g AS (SELECT *, lag(oi) OVER w AS po, date_diff('second', lag(hr_at) OVER w, hr_at) / 3600.0 AS hrs FROM h WHERE oi > 0 WINDOW w AS (PARTITION BY b ORDER BY hr_at))
SELECT b AS base, strftime(hr_at, '%Y-%m-%d %H') AS "at", COALESCE(tier, 'T3') AS tier, CASE WHEN oi > po THEN 'up' ELSE 'down' END AS direction,
  round(abs((oi - po) / po * 100), 4) AS magnitude FROM g LEFT JOIN t ON symbol = b || 'USDT'
WHERE oi >= 20000000 AND hrs BETWEEN 1.5 AND 12 AND abs((oi - po) / po * 100) >= 30
""", "tickers")
def _(f):
    return SG.interest_jumps(_interest(f), _tickers(f)).select("base", F.date_format("at", "yyyy-MM-dd HH").alias("at"), "tier", "direction",
                                                               F.round("magnitude", 4).alias("magnitude"))


def _liquidations(f):
    contracts = f.part.where("p_partkey < 20").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string"), F.lit("-USDT-SWAP")).alias("inst_id"),
        (F.col("p_retailprice") / 100).alias("ct_val"))
    now_ms = F.lit(915148800000.0)
    return R.liquidations_last_hour(liquidation_rows(f), contracts, now_ms, hours=24 * 300.0)


LIQ = """lq AS (SELECT 'C' || CAST(l_partkey % 20 AS STRING) AS base, sum(u) FILTER (l_returnflag = 'A') AS l, sum(u) FILTER (l_returnflag <> 'A') AS s,
  sum(u) AS total, count(*) AS n FROM (SELECT *, l_extendedprice * p_retailprice / 100 AS u FROM lineitem JOIN part ON p_partkey = l_partkey % 20)
  WHERE epoch(l_shipdate) * 1000 >= 915148800000 - 24 * 300 * 3600 * 1000.0 GROUP BY 1)"""


@job("src13_liquidations", f"""
WITH {LIQ} SELECT base, round(l, 0) AS long_usd, round(s, 0) AS short_usd, round(total, 0) AS total_usd, n FROM lq
""")
def _(f):
    return _liquidations(f).select("base", *[F.round(c, 0).alias(c) for c in ("long_usd", "short_usd", "total_usd")], "n")


@job("sig08_liquidation_alerts", f"""
WITH {TIERED}, {LIQ} SELECT lq.base, COALESCE(tier, 'T3') AS tier, CASE WHEN l >= s THEN 'long' ELSE 'short' END AS direction,
  round(greatest(l, s) / total * 100, 4) AS dominant_pct FROM lq LEFT JOIN t ON symbol = lq.base || 'USDT' WHERE total >= 1000000
""", "tickers")
def _(f):
    return SG.liquidation_alerts(_liquidations(f), _tickers(f)).select("base", "tier", "direction", F.round("dominant_pct", 4).alias("dominant_pct"))


def _last_jumps(f, tickers):
    """Jumps of the last record of each base: a run compares the interest it reads with the record before it."""
    interest = _interest(f)
    last = interest.where("oi_usd > 0").groupBy("base").agg(F.max("at").alias("at"))
    return SG.interest_jumps(interest, tickers).join(last, ["base", "at"])


def _signals(f):
    t = _tickers(f)
    parts = [SG.price_moves(t), SG.level_breaks(t, _last_prices(f), AT, MAJORS), SG.period_extremes(t, _closed(f), majors=MAJORS),
             SG.volume_spikes(t, _closed(f)), SG.funding_extremes(*_funding(f), t), _last_jumps(f, t), SG.liquidation_alerts(_liquidations(f), t)]
    out = parts[0].select(*SG.SIGNAL)
    for p in parts[1:]:
        out = out.unionByName(p.select(*SG.SIGNAL))
    return out


@job("sig09_capped_moves", f"""
WITH {TIERED}, s AS (SELECT 'price_move:' || symbol || ':' || CASE WHEN change_pct > 0 THEN 'up' ELSE 'down' END AS key, symbol,
  3 * CASE tier WHEN 'T1' THEN 3.0 WHEN 'T2' THEN 2.0 WHEN 'T3' THEN 1.2 ELSE 1.0 END * (1 + abs(change_pct) / lim) AS w FROM lim WHERE abs(change_pct) >= lim)
SELECT key, round(w, 6) AS weight FROM s ORDER BY w DESC, key LIMIT 25
""", "tickers")
def _(f):
    return SG.cap_signals(SG.price_moves(_tickers(f))).select("key", F.round("weight", 6).alias("weight"))


@job("sig09_signal_run")
def _(f):
    return SG.cap_signals(_signals(f)).select("key", "kind", "symbol", "tier", F.round("weight", 4).alias("weight"))


YUAN = """CASE WHEN last >= 10000 THEN replace(format('{:.2f} 万美元', last / 10000), '.00 万', ' 万') WHEN last >= 100 THEN format('{:,.2f} 美元', last)
  WHEN last >= 1 THEN format('{:.3f} 美元', last) ELSE format('{:.5f} 美元', last) END"""


@job("sig10_signal_items", "WITH " + TIERED + " SELECT base || ' 24 小时' || CASE WHEN change_pct > 0 THEN '上涨' ELSE '下跌' END || ' ' || "
     "format('{:.1f}', abs(change_pct)) || '%，现报 ' || " + YUAN + " || '，24 小时成交额 ' || CASE WHEN quote_volume >= 1e8 THEN "
     "format('{:.2f} 亿美元', quote_volume / 1e8) ELSE format('{:.0f} 万美元', quote_volume / 1e4) END AS title, "
     "'https://x.example.com/' || base || '#move-' || CASE WHEN change_pct > 0 THEN 'up' ELSE 'down' END || '-20240201T00' AS url "
     "FROM lim WHERE abs(change_pct) >= lim", "tickers")
def _(f):
    t = _tickers(f)
    return SG.move_items(SG.price_moves(t), t, AT, "https://x.example.com/").select("title", "url")


@job("sig11_candle_universe", f"""
WITH {TIERED} SELECT symbol FROM lim WHERE base IN {MAJ} UNION SELECT symbol FROM (SELECT symbol FROM lim ORDER BY quote_volume DESC, symbol LIMIT 20)
UNION SELECT symbol FROM lim WHERE abs(change_pct) >= lim
""", "tickers")
def _(f):
    return SG.candle_universe(_tickers(f), 20, MAJORS)


#: Hours since a key's last signal: under a day for most, around thirty days for every fourth.
STATE_AGE = "(s_suppkey % 24 + CASE WHEN s_suppkey % 4 = 0 THEN 24 * (27 + s_suppkey % 7) ELSE 0 END)"


def _state(f):
    return f.supplier.select(
        F.concat(F.lit("price_move:C"), F.col("s_suppkey").cast("string"), F.lit("USDT:up")).alias("key"),
        (F.col("s_acctbal") / 100).alias("magnitude"), F.timestamp_add("HOUR", -F.expr(STATE_AGE), T.wall(AT)).alias("at"))


@job("str03_cooldown", f"""
WITH {TIERED}, st AS (SELECT 'price_move:C' || CAST(s_suppkey AS STRING) || 'USDT:up' AS k, abs(s_acctbal / 100) AS m, {STATE_AGE} AS h FROM supplier)
SELECT key FROM (SELECT 'price_move:' || symbol || ':' || CASE WHEN change_pct > 0 THEN 'up' ELSE 'down' END AS key, abs(change_pct) AS mag
  FROM lim WHERE abs(change_pct) >= lim) LEFT JOIN st ON k = key WHERE k IS NULL OR h >= 12 OR mag >= m + 8
""", "tickers")
def _(f):
    return SG.allowed(SG.price_moves(_tickers(f)), _state(f), AT).select("key")


@job("str04_state_after_run", f"""
WITH {TIERED}, st AS (SELECT 'price_move:C' || CAST(s_suppkey AS STRING) || 'USDT:up' AS k, s_acctbal / 100 AS m, {STATE_AGE} AS h FROM supplier),
kept AS (SELECT 'price_move:' || symbol || ':' || CASE WHEN change_pct > 0 THEN 'up' ELSE 'down' END AS key, abs(change_pct) AS mag
  FROM lim WHERE abs(change_pct) >= lim)
SELECT key, round(mag, 4) AS magnitude FROM kept UNION ALL SELECT k, round(m, 4) FROM st WHERE k NOT IN (SELECT key FROM kept) AND h <= 720
""", "tickers")
def _(f):
    kept = SG.price_moves(_tickers(f))
    return SG.next_state(_state(f), kept, AT).select("key", F.round("magnitude", 4).alias("magnitude"))
