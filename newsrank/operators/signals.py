"""Market signals from snapshots of prices, candles, funding, interest and liquidations.

Signals share one layout: key, kind, symbol, base, tier, direction, magnitude, salience.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import times as T

SIGNAL = ["key", "kind", "symbol", "base", "tier", "direction", "magnitude", "salience"]


def tier_of(base: Column, volume: Column) -> Column:
    return (F.when(base.isin(*D.TIER1_BASES), "T1").when(volume >= D.TIER2_VOLUME, "T2")
            .when(volume >= D.TIER3_VOLUME, "T3").otherwise("T4"))


def authority_of(tier: Column) -> Column:
    return X.lookup(D.SIGNAL_AUTHORITY, tier, 3)


def with_tier(tickers: DataFrame) -> DataFrame:
    return tickers.withColumn("tier", tier_of(F.col("base"), F.col("quote_volume")))


def _threshold(tier: Column) -> Column:
    return X.lookup(D.MOVE_THRESHOLDS, tier, 25.0)


def size_ranks(tickers: DataFrame) -> DataFrame:
    """(size, market_rank): how many rows of the market moved more, plus one.

    Counted by distinct size in whole-percent buckets, so no task sorts the market. Sizes under the
    lowest threshold belong to no signal and are left out.
    """
    sizes = tickers.where(F.col("size") >= min(D.MOVE_THRESHOLDS.values())).groupBy("size").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("bucket", F.floor("size"))
    above = sizes.groupBy("bucket").agg(F.sum("k").alias("k")).withColumn("over", F.coalesce(F.sum("k").over(
        Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "over")
    inside = F.coalesce(F.sum("k").over(Window.partitionBy("bucket").orderBy(F.col("size").desc()).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(above, "bucket").select(
        "size", (F.col("over") + F.col("inside") + 1).alias("market_rank"))


def price_moves(tickers: DataFrame) -> DataFrame:
    """24-hour moves beyond the threshold of their tier, with the rank by size in the market."""
    t = with_tier(tickers).withColumn("limit", _threshold(F.col("tier"))).withColumn("size", F.abs("change_pct"))
    ranked = t.join(size_ranks(t), "size")
    up = F.when(F.col("change_pct") > 0, "up").otherwise("down")
    return ranked.where(F.col("size") >= F.col("limit")).select(
        F.concat(F.lit("price_move:"), "symbol", F.lit(":"), up).alias("key"), F.lit("price_move").alias("kind"), "symbol", "base",
        "tier", up.alias("direction"), F.col("size").alias("magnitude"), (F.col("size") / F.col("limit")).alias("salience"),
        "market_rank")


def level_breaks(tickers: DataFrame, last_prices: DataFrame, now, majors: list[str] = D.MAJOR_BASES) -> DataFrame:
    """Round levels a major coin has crossed since its last seen price (at most 24 hours old, else the open)."""
    seen = last_prices.where(T.hours_between(T.wall(now), F.col("updated_at")) <= 24).select(
        F.col("symbol").alias("_s"), F.col("price").alias("prev"))
    t = with_tier(tickers).where(F.col("base").isin(*majors)).join(seen, F.col("symbol") == F.col("_s"), "left")
    t = t.withColumn("baseline", F.coalesce("prev", "open")).where("baseline > 0")
    low, high = F.least("baseline", "last"), F.greatest("baseline", "last")
    step = F.pow(F.lit(10.0), F.floor(F.log10("last"))) / 2
    first = F.floor(low / step) + 1
    n = F.least(F.floor(high / step) - first + 1, F.lit(12))
    t = t.withColumn("step", step).withColumn("first", first).withColumn("n", n.cast("int")).where("n > 0")
    t = t.withColumn("level", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                                                    lambda i: F.round((F.col("first") + i) * F.col("step"), 10))))
    t = t.where(F.abs(F.col("last") - F.col("level")) / F.col("level") * 100 >= 0.25)
    up = F.when(F.col("last") > F.col("level"), "up").otherwise("down")
    return t.select(F.concat(F.lit("level_break:"), "symbol", F.lit(":"), F.round("level", 6).cast("string"), F.lit(":"), up)
                    .alias("key"), F.lit("level_break").alias("kind"), "symbol", "base", "tier", up.alias("direction"),
                    F.abs("change_pct").alias("magnitude"), F.when(F.col("tier") == "T1", 3.0).otherwise(2.0).alias("salience"),
                    "level", "baseline")


def period_extremes(tickers: DataFrame, closed: DataFrame, windows=(30, 90), majors: list[str] = D.MAJOR_BASES) -> DataFrame:
    """New highs or lows against the closed days of 30 and 90 day windows.

    Only the last days of each symbol are needed, so the window is a filter on ``age`` and one
    grouped maximum, not a running frame over the history.
    """
    sizes = F.explode(F.array(*[F.lit(w) for w in windows]))
    days = closed.withColumn("window", sizes).where("age <= window").groupBy(F.col("symbol").alias("_s"), "window").agg(
        F.max("high").alias("top"), F.min("low").alias("bottom"), F.count("*").alias("days"))
    total = closed.groupBy(F.col("symbol").alias("_t")).agg(F.count("*").alias("closed_days"))
    j = with_tier(tickers).where(F.col("base").isin(*majors)).join(days, F.col("symbol") == F.col("_s")).join(
        total, F.col("symbol") == F.col("_t")).where("closed_days + 1 >= 10 AND days >= window * 0.8D")
    side = F.when(F.col("high") > F.col("top"), "high").when(F.col("low") < F.col("bottom"), "low")
    j = j.withColumn("direction", side).where("direction IS NOT NULL")
    return j.select(F.concat_ws(":", F.lit("period_extreme"), "symbol", F.col("window").cast("string"), "direction").alias("key"),
                    F.lit("period_extreme").alias("kind"), "symbol", "base", "tier", "direction",
                    F.abs("change_pct").alias("magnitude"),
                    (F.lit(1.5) + F.col("window") / 90.0 + F.when(F.col("tier") == "T1", 1.0).otherwise(0.0)).alias("salience"),
                    "window", F.when(side == "high", F.col("top")).otherwise(F.col("bottom")).alias("reference"))


def volume_spikes(tickers: DataFrame, closed: DataFrame, ratio: float = 3.0, min_volume: float = 10_000_000) -> DataFrame:
    """24-hour volume against the median of the last seven closed days (the upper middle one)."""
    week = closed.where("age <= 7").groupBy(F.col("symbol").alias("_s")).agg(
        F.element_at(F.array_sort(F.collect_list("quote_volume")), 4).alias("median"), F.count("*").alias("days"))
    j = with_tier(tickers).join(week, F.col("symbol") == F.col("_s")).where(
        (F.col("days") >= 7) & (F.col("median") > 0) & (F.col("quote_volume") >= min_volume))
    j = j.withColumn("ratio", F.col("quote_volume") / F.col("median")).where(F.col("ratio") >= ratio)
    return j.select(F.concat(F.lit("volume_spike:"), "symbol").alias("key"), F.lit("volume_spike").alias("kind"), "symbol", "base",
                    "tier", F.lit("up").alias("direction"), (F.col("ratio") * 100).alias("magnitude"),
                    F.least(F.lit(3.0), F.col("ratio") / ratio).alias("salience"), "ratio", "median")


def _spot_tier(rows: DataFrame, tickers: DataFrame, default: Column) -> DataFrame:
    spot = with_tier(tickers).select(F.col("symbol").alias("_s"), F.col("tier").alias("_t"))
    named = rows.withColumn("symbol", F.concat("base", F.lit(D.QUOTE_ASSET)))
    return named.join(spot, F.col("symbol") == F.col("_s"), "left").withColumn("tier", F.coalesce("_t", default)).drop("_s", "_t")


def funding_extremes(funding: DataFrame, interest: DataFrame, tickers: DataFrame) -> DataFrame:
    """Yearly funding of at least 50 or at most -30 percent; a known open interest must reach ten million."""
    j = funding.join(interest.select(F.col("base").alias("_b"), "oi_usd"), F.col("base") == F.col("_b"), "left")
    j = j.where(~F.coalesce((F.col("oi_usd") != 0) & (F.col("oi_usd") < 10_000_000), F.lit(False)))
    side = F.when(F.col("apr") >= 50, "pos").when(F.col("apr") <= -30, "neg")
    j = _spot_tier(j.withColumn("direction", side).where("direction IS NOT NULL"), tickers, F.lit("T3"))
    limit = F.when(F.col("direction") == "pos", 50.0).otherwise(30.0)
    return j.select(F.concat_ws(":", F.lit("funding_extreme"), "base", "direction").alias("key"), F.lit("funding_extreme").alias("kind"),
                    "symbol", "base", "tier", "direction", F.abs("apr").alias("magnitude"),
                    F.least(F.lit(3.0), F.abs("apr") / limit).alias("salience"))


def interest_jumps(history: DataFrame, tickers: DataFrame, min_usd: float = 20_000_000, pct: float = 30.0) -> DataFrame:
    """Jumps of open interest between records 1.5 to 12 hours apart.

    ``history`` has base, at, oi_usd: each record is compared with the one before it.
    """
    w = Window.partitionBy("base").orderBy("at")
    h = history.where("oi_usd > 0").withColumn("prev", F.lag("oi_usd").over(w)).withColumn("prev_at", F.lag("at").over(w))
    gap = T.hours_between(F.col("at"), F.col("prev_at"))
    h = h.withColumn("hours", gap).withColumn("change", (F.col("oi_usd") - F.col("prev")) / F.col("prev") * 100)
    h = h.where((F.col("oi_usd") >= min_usd) & F.col("hours").between(1.5, 12.0) & (F.abs("change") >= pct))
    h = _spot_tier(h.withColumn("direction", F.when(F.col("change") > 0, "up").otherwise("down")), tickers, F.lit("T3"))
    return h.select(F.concat_ws(":", F.lit("oi_jump"), "base", "direction").alias("key"), F.lit("oi_jump").alias("kind"), "symbol",
                    "base", "tier", "direction", F.abs("change").alias("magnitude"),
                    F.least(F.lit(3.0), F.abs("change") / pct).alias("salience"), "at")


def liquidation_alerts(liquidations: DataFrame, tickers: DataFrame) -> DataFrame:
    """Liquidations of three million on a first-tier coin, one million elsewhere; the larger side names it."""
    alone = F.when(F.col("base").isin(*D.TIER1_BASES), "T1").otherwise("T3")
    j = _spot_tier(liquidations, tickers, alone)
    limit = F.when(F.col("tier") == "T1", 3_000_000.0).otherwise(1_000_000.0)
    side = F.when(F.col("long_usd") >= F.col("short_usd"), "long").otherwise("short")
    return j.where((F.col("total_usd") >= limit) & (F.col("n") > 0)).select(
        F.concat_ws(":", F.lit("liquidation"), "base", side).alias("key"), F.lit("liquidation").alias("kind"), "symbol", "base", "tier",
        side.alias("direction"), F.col("total_usd").alias("magnitude"),
        F.least(F.lit(3.0), F.col("total_usd") / limit).alias("salience"),
        (F.greatest("long_usd", "short_usd") / F.col("total_usd") * 100).alias("dominant_pct"))


def cap_signals(signals: DataFrame, per_symbol: int = 2, per_run: int = 25) -> DataFrame:
    """The signals of one run by weight: at most two a symbol, at most 25 in all."""
    weight = (X.lookup(D.KIND_PRIORITY, F.col("kind"), 1) * X.lookup(D.SIGNAL_TIER_WEIGHT, F.col("tier"), 1.0)
              * (F.lit(1.0) + F.col("salience")))
    s = signals.select(*SIGNAL).withColumn("weight", weight)
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("weight").desc(), "key"))
    return s.withColumn("place", place).where(F.col("place") <= per_symbol).drop("place").orderBy(
        F.col("weight").desc(), "key").limit(per_run)


def allowed(signals: DataFrame, state: DataFrame, now) -> DataFrame:
    """Signals out of cooldown, or grown enough since they last went out.

    ``state`` has key, magnitude, at (see ``streaming.cooldown`` for the running form).
    """
    j = signals.join(state.select(F.col("key").alias("_k"), F.abs("magnitude").alias("_m"), F.col("at").alias("_at")),
                     F.col("key") == F.col("_k"), "left")
    hours = T.hours_between(T.wall(now), F.col("_at"))
    cool = X.lookup(D.COOLDOWN_HOURS, F.col("kind"), 12.0)
    grown = F.when(F.col("kind") == "liquidation", (F.col("_m") <= 0) | (F.abs("magnitude") >= F.col("_m") * 1.5)).otherwise(
        F.abs("magnitude") >= F.col("_m") + 8.0)
    ok = F.col("_k").isNull() | F.col("_at").isNull() | (hours >= cool) | grown
    return j.where(F.coalesce(ok, F.lit(True))).drop("_k", "_m", "_at")


def next_state(state: DataFrame, kept: DataFrame, now, ttl_days: int = 30) -> DataFrame:
    """Cooldown state after a run: kept signals refreshed, rows unused for thirty days gone."""
    fresh = kept.groupBy("key").agg(F.max(F.round("magnitude", 4)).alias("magnitude")).withColumn("at", T.wall(now))
    old = state.join(fresh.select("key"), "key", "left_anti").where(
        F.col("at") >= F.timestamp_add("DAY", F.lit(-ttl_days), T.wall(now)))
    return old.select("key", "magnitude", "at").unionByName(fresh)


def _yuan(text: Column) -> Column:
    return F.concat(text, F.lit(" 美元"))


def price_text(px: Column) -> Column:
    big = F.replace(F.concat(X.fixed(px / 10000, 2), F.lit(" 万")), F.lit(".00 万"), F.lit(" 万"))
    tiny = F.regexp_replace(X.fixed(px, 8), "0+$", "")
    return (F.when(px >= 10000, F.concat(big, F.lit("美元"))).when(px >= 100, _yuan(X.fixed(px, 2, True)))
            .when(px >= 1, _yuan(X.fixed(px, 3))).when(px >= 0.01, _yuan(X.fixed(px, 5))).otherwise(_yuan(tiny)))


def level_text(px: Column) -> Column:
    v = px / 10000
    big = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(X.fixed(v, 1))
    mid = F.when(px == F.floor(px), X.fixed(px, 0, True)).otherwise(X.fixed(px, 2, True))
    small = F.regexp_replace(X.fixed(px, 6), r"\.?0+$", "")
    return F.when(px >= 10000, F.concat(big, F.lit(" 万美元"))).when(px >= 1, _yuan(mid)).otherwise(_yuan(small))


def usd_text(v: Column) -> Column:
    return (F.when(v >= 1e8, F.concat(X.fixed(v / 1e8, 2), F.lit(" 亿美元")))
            .when(v >= 1e4, F.concat(X.fixed(v / 1e4, 0), F.lit(" 万美元"))).otherwise(_yuan(X.fixed(v, 0, True))))


def move_items(moves: DataFrame, tickers: DataFrame, now, page: str) -> DataFrame:
    """Price-move signals as news items; the address carries the hour, so later rounds are new items."""
    t = tickers.select(F.col("symbol").alias("_s"), "last", "quote_volume", "change_pct")
    j = moves.join(t, F.col("symbol") == F.col("_s"))
    verb = F.when(F.col("direction") == "up", "上涨").otherwise("下跌")
    title = F.concat(F.col("base"), F.lit(" 24 小时"), verb, F.lit(" "), X.fixed(F.col("magnitude"), 1), F.lit("%，现报 "),
                     price_text(F.col("last")), F.lit("，24 小时成交额 "), usd_text(F.col("quote_volume")))
    stamp = F.date_format(T.wall(now), "yyyyMMdd'T'HH")
    return j.select(F.lit("MarketSignal").alias("source"), title.alias("title"),
                    F.concat(F.lit(page), "base", F.lit("#move-"), "direction", F.lit("-"), stamp).alias("url"),
                    authority_of(F.col("tier")).alias("authority"), F.lit("market_signal").alias("type"),
                    F.col("kind").alias("signal_type"), F.col("key").alias("signal_key"))


def candle_universe(tickers: DataFrame, top: int = 80, majors: list[str] = D.MAJOR_BASES) -> DataFrame:
    """Symbols whose candles are needed: majors, the most traded ones, and the movers."""
    t = with_tier(tickers)
    parts = [t.where(F.col("base").isin(*majors)), t.orderBy(F.col("quote_volume").desc(), "symbol").limit(top),
             t.where(F.abs("change_pct") >= _threshold(F.col("tier")))]
    out = parts[0].select("symbol")
    for p in parts[1:]:
        out = out.unionByName(p.select("symbol"))
    return out.distinct()
