"""Content tags and entity resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import times as T

ENTITY = "struct<symbol:string,name:string,market:string,venue:string,tradable:boolean,source:string,market_cap_rank:int>"


def publish_sectors(tags: Column, threshold: float = 0.55, top: int = 3) -> tuple[Column, Column]:
    """(published sectors, detail by falling relevance) of an array of (sector, relevance, anchor)."""
    clean = F.transform(F.filter(tags, lambda t: T.strip(F.coalesce(t["sector"], F.lit(""))) != ""),
                        lambda t, i: F.struct((-F.round(F.coalesce(t["relevance"], F.lit(0.0)), 3)).alias("minus"), i.alias("i"),
                                              T.strip(t["sector"]).alias("sector"),
                                              T.strip(F.coalesce(t["anchor"], F.lit(""))).alias("anchor")))
    ranked = F.array_sort(clean)
    detail = F.transform(ranked, lambda t: F.struct(t["sector"].alias("sector"), (-t["minus"]).alias("relevance"),
                                                    t["anchor"].alias("anchor")))
    good = F.filter(ranked, lambda t: (-t["minus"] >= threshold) & (t["anchor"] != ""))
    return F.array_distinct(F.transform(F.slice(good, 1, top), lambda t: t["sector"])), detail


def sentiment(score: Column) -> tuple[Column, Column]:
    """(score in [-1, 1] with 3 digits, label by the score alone)."""
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))
    label = F.when(held >= 0.1, "bullish").when(held <= -0.1, "bearish").otherwise("neutral")
    return F.round(held, 3), label


def clean_entities(entities: Column, outlet: Column) -> Column:
    """Named entities without blanks and without the outlet itself; 128 characters, first six."""
    own = X.outlet_key(outlet)
    named = F.transform(entities, lambda e: F.struct(T.strip(F.coalesce(e["name"], F.lit(""))).alias("name"),
                                                     F.coalesce(e["type"], F.lit("organization")).alias("type")))
    kept = F.filter(named, lambda e: (e["name"] != "") & ((own == "") | (X.outlet_key(e["name"]) != own)))
    return F.slice(F.transform(kept, lambda e: F.struct(F.substring(e["name"], 1, 128).alias("name"), e["type"].alias("type"))),
                   1, 6)


# --- coins -----------------------------------------------------------------------------------------

def normalize_symbol(raw: Column) -> Column:
    s = T.strip(F.regexp_replace(F.upper(T.strip(F.coalesce(raw, F.lit("")))), r"^\$+", ""))
    return F.coalesce(F.try_element_at(X.map_literal(D.SYMBOL_ALIASES), s), s)


def cap_tier(cap: Column) -> Column:
    out = F.when(cap.isNull() | (cap <= 0), "unknown")
    for floor, name in D.CAP_TIERS:
        out = out.when(cap >= floor, name)
    return out.otherwise("micro")


def asset_class(symbol: Column, name: Column, coin_id: Column) -> Column:
    tokenized = F.coalesce(name, F.lit("")).rlike(D.TOKENIZED_EQUITY) | F.coalesce(coin_id, F.lit("")).rlike(D.TOKENIZED_EQUITY)
    return (F.when(tokenized, "tokenized_equity").when(symbol.isin(*D.COMMODITY_SYMBOLS), "tokenized_commodity")
            .when(symbol.isin(*D.STABLE_SYMBOLS), "stablecoin").otherwise("coin"))


def cap_label(cap: Column) -> Column:
    out = F.when(cap.isNull() | (cap <= 0), "—")
    for unit, div in (("T", 1e12), ("B", 1e9), ("M", 1e6), ("K", 1e3)):
        out = out.when(cap >= div, F.concat(F.lit("$"), X.fixed(cap / div, 2), F.lit(unit)))
    return out.otherwise(F.concat(F.lit("$"), X.fixed(cap, 0)))


def btc_ratio_label(ratio: Column) -> Column:
    pct = lambda a, b: F.concat(F.lit("BTC 市值的 "), X.fixed(ratio * 100, a), F.lit("%（"), X.fixed(ratio, b), F.lit(" 倍）"))
    return (F.when(ratio.isNull(), "—").when(ratio >= 1, F.concat(F.lit("BTC 市值的 "), X.fixed(ratio, 2), F.lit(" 倍")))
            .when(ratio >= 0.0001, pct(2, 4)).otherwise(pct(4, 6)))


def coin_index(universe: DataFrame, pinned: DataFrame, exchange: DataFrame, btc_symbol: str = "BTC") -> DataFrame:
    """What each symbol stands for: one row for each symbol of the universe.

    ``pinned`` (symbol, coin_id) names the coin a well-known symbol must be; ``exchange`` has (symbol,
    price). All the choices are made here, once for each symbol, so the events only need one join.
    """
    sized = universe.where("market_cap > 0").join(
        pinned.select(F.col("symbol").alias("_p"), F.col("coin_id").alias("pin")), F.col("symbol") == F.col("_p"), "left")
    cols = ["coin_id", "name", "market_cap", "market_cap_rank", "price"]
    best = F.struct("market_cap", -F.col("market_cap_rank"))
    top = sized.groupBy("symbol").agg(
        F.count("*").alias("n_candidates"), F.first("pin", ignorenulls=True).alias("pin"),
        F.max_by(F.struct(*cols), best).alias("largest"),
        F.max_by(F.struct(*cols), F.when(F.col("coin_id") == F.col("pin"), F.lit(1))).alias("exact"),
        F.max("market_cap").alias("cap1"))
    second = sized.join(top.select(F.col("symbol").alias("_s"), F.col("largest.coin_id").alias("_id")),
                        (F.col("symbol") == F.col("_s"))).where("coin_id != _id").groupBy("_s").agg(
        F.max("market_cap").alias("cap2"))
    btc = sized.where(F.col("symbol") == btc_symbol).agg(F.max("market_cap").alias("btc_cap"))
    j = top.join(second, F.col("symbol") == F.col("_s"), "left").drop("_s").join(
        exchange.select(F.col("symbol").alias("_x"), F.col("price").alias("exchange_price")), F.col("symbol") == F.col("_x"),
        "left").crossJoin(F.broadcast(btc))
    chosen = F.when(F.col("pin").isNotNull(), F.col("exact")).otherwise(F.col("largest"))
    j = j.withColumn("c", chosen)
    ratio = F.greatest(F.try_divide("exchange_price", F.col("c.price")), F.try_divide(F.col("c.price"), F.col("exchange_price")))
    missing_pin = F.col("pin").isNotNull() & F.col("exact").isNull()
    crowded = F.col("pin").isNull() & F.coalesce(F.col("cap1") < D.DOMINANCE_RATIO * F.col("cap2"), F.lit(False))
    mismatch = F.coalesce(ratio > D.PRICE_MISMATCH_RATIO, F.lit(False))
    status = F.when(missing_pin, "unknown").when(crowded | mismatch, "ambiguous").otherwise("ok")
    flag = (F.when(missing_pin, "PINNED_ID_MISSING").when(crowded, F.lit(None)).when(mismatch, "PRICE_MISMATCH")
            .when(F.col("pin").isNull() & (F.col("n_candidates") > 1), "AMBIGUOUS_RESOLVED_BY_DOMINANCE"))
    ok = status == "ok"
    return j.select(
        "symbol", status.alias("status"), flag.alias("flag"), "n_candidates",
        F.when(ok | mismatch & ~crowded & ~missing_pin, F.col("c.coin_id")).alias("coin_id"), F.when(ok, F.col("c.name")).alias("name"),
        F.when(ok, asset_class(F.col("symbol"), F.col("c.name"), F.col("c.coin_id"))).otherwise("unknown").alias("asset_class"),
        F.when(ok, F.round("c.market_cap", 2)).alias("market_cap_usd"), F.when(ok, F.col("c.market_cap_rank")).alias("market_cap_rank"),
        F.when(ok, F.round(F.try_divide(F.col("c.market_cap"), F.col("btc_cap")), 8)).alias("btc_ratio"),
        F.when(ok, cap_tier(F.col("c.market_cap"))).alias("cap_tier"),
        (ok & (F.col("_x").isNotNull() | F.col("symbol").isin("USDT"))).alias("on_exchange"))


def resolve_coins(events: DataFrame, index: DataFrame, equities: list[str] = ()) -> DataFrame:
    """One row for each distinct coin of an event, in first-seen order, with what it resolves to."""
    coins = events.select("id", F.posexplode(F.transform(F.filter("coins", lambda c: c.isNotNull() & (T.strip(c) != "")),
                                                         normalize_symbol)).alias("pos", "symbol")).where("symbol != ''")
    first = coins.groupBy("id", "symbol").agg(F.min("pos").alias("pos"))
    j = first.join(index.withColumnRenamed("symbol", "_s"), F.col("symbol") == F.col("_s"), "left").drop("_s")
    equity = F.col("symbol").isin(*equities) if equities else F.lit(False)
    out = j.withColumn("status", F.when(equity, "equity").otherwise(F.coalesce("status", F.lit("unknown"))))
    for c in ("coin_id", "name", "market_cap_usd", "market_cap_rank", "btc_ratio", "cap_tier"):
        out = out.withColumn(c, F.when(~equity, F.col(c)))
    return out.withColumn("asset_class", F.when(equity, "equity").otherwise(F.coalesce("asset_class", F.lit("unknown"))))


def primary_coins(resolved: DataFrame) -> DataFrame:
    """The coin of largest value of each event, with its ratio and tier."""
    ok = (F.col("status") == "ok") & F.col("market_cap_usd").isNotNull()
    pick = F.when(ok, F.struct(F.col("market_cap_usd"), -F.col("pos")))
    return resolved.groupBy("id").agg(
        F.max_by(F.struct("symbol", "market_cap_usd", "btc_ratio", "cap_tier"), pick).alias("p"), F.count("*").alias("coins")
    ).select("id", "coins", F.col("p.symbol").alias("primary_coin"), F.col("p.market_cap_usd").alias("primary_coin_market_cap"),
             F.col("p.btc_ratio").alias("primary_coin_btc_ratio"), F.col("p.cap_tier").alias("coin_cap_tier"))


def coin_status_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("mentions"), F.countDistinct("id").alias("events"))


# --- tradable entities ---------------------------------------------------------------------------------

def symbol_entities(events: DataFrame, listed: DataFrame) -> DataFrame:
    """Entities of editorial symbols: (id, turn, entity).

    ``listed`` is the dictionary of known symbols: symbol, name, market (crypto, us_stock, index_etf,
    index), kept by the caller.
    """
    raw = F.transform(F.split(F.upper(F.coalesce("matched_symbols", F.lit(""))), ","), T.strip)
    one = events.select("id", F.posexplode(raw).alias("turn", "s"))
    pair = r"^X:([A-Z]{2,10})USDT?$"
    crypto = F.col("s").rlike(pair)
    ticker = F.col("s").rlike("^[A-Z]{1,5}$") & ~F.col("s").isin(*D.NOT_TICKERS)
    one = one.where(crypto | ticker).select("id", "turn", F.when(crypto, F.regexp_extract("s", pair, 1)).otherwise(F.col("s"))
                                            .alias("sym"), crypto.alias("is_crypto"))
    j = one.join(listed.select(F.col("symbol").alias("_s"), "name", "market"),
                 (F.col("sym") == F.col("_s")) & ((F.col("market") == "crypto") == F.col("is_crypto")))
    return j.select("id", "turn", F.struct(
        F.col("sym").alias("symbol"), "name", "market",
        F.when(F.col("market") == "crypto", "spot").when(F.col("market") == "index", "-").otherwise("US").alias("venue"),
        (F.col("market") != "index").alias("tradable"), F.lit("editorial_ticker").alias("source"),
        F.lit(None).cast("int").alias("market_cap_rank")).cast(ENTITY).alias("entity"))


_SLOTS = 1 << 18


def _slots(text: str, size: int) -> np.ndarray:
    """A slot of 18 bits for each run of ``size`` characters, by its place in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    mixed = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        mixed = (mixed ^ codes[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
    return mixed >> np.uint64(46)


def _grams(known: dict[tuple[str, int], np.ndarray]):
    """The distinct runs, script and characters, of a Chinese and a whole title whose slot is ``known``; others begin no name."""
    def cut(zh: pd.Series, en: pd.Series) -> pd.Series:
        out = []
        for texts in zip(zh, en):
            by = dict(zip(("zh", "en"), texts))
            out.append(list({s + by[s][i:i + w] for (s, w), slots in known.items() for i in np.nonzero(slots[_slots(by[s], w)])[0].tolist()}))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(cut, "array<string>", F.PandasUDFType.SCALAR)


def _slot(grams: Column) -> Column:
    """The slot of a run that is a whole text."""
    return F.pandas_udf(lambda texts: pd.Series([int(_slots(t, len(t))[0]) for t in texts], dtype="int64"), "long",
                        F.PandasUDFType.SCALAR)(grams)


def title_entities(events: DataFrame, names: DataFrame) -> DataFrame:
    """Companies named in titles: (id, turn, entity).

    ``names`` is a name dictionary of any size: turn, name, symbol, market, script ("zh" looks in the Chinese title, "en" in
    both in lower case), shown. Its index is the first characters of each name, up to four; titles are cut into runs of the
    lengths that occur there and both meet by a hash join. What meets is then looked for as a whole. A bitmap of a fixed
    2^18 slots for each script and length tells the tasks which runs may begin a name, so that others are not shuffled.
    """
    zh = F.coalesce("title_zh", F.lit(""))
    both = F.lower(F.concat(zh, F.lit(" "), F.coalesce("title_en", F.lit(""))))
    width = F.least(F.length("name"), F.lit(4))
    index = names.where("name != ''").withColumn("width", width).withColumn("gram", F.substring("name", 1, 4))
    known: dict[tuple[str, int], np.ndarray] = {}
    for r in index.select("script", "width", _slot("gram").alias("slot")).distinct().collect():       # at most eight times the slots
        known.setdefault((r["script"], r["width"]), np.zeros(_SLOTS, dtype=bool))[r["slot"]] = True
    texts = events.select("id", zh.alias("zh"), both.alias("en"))
    if not known:
        return events.select("id", F.lit(0).alias("turn"), F.lit(None).cast(ENTITY).alias("entity")).where("false")
    cut = texts.select("id", F.explode(_grams(known)("zh", "en")).alias("run"))
    book = F.struct("turn", "name", "symbol", "market", "script", "shown").alias("b")
    met = cut.join(index.select(F.concat("script", "gram").alias("run"), book), "run").select("id", "b")
    found = met.join(texts, "id").where(F.contains(F.when(F.col("b.script") == "zh", F.col("zh")).otherwise(F.col("en")), F.col("b.name")))
    first = found.groupBy("id", F.col("b.symbol").alias("_s")).agg(F.min_by("b", F.struct("b.turn", "b.name")).alias("b"))
    return first.select("id", F.col("b.turn").alias("turn"), F.struct(
        F.col("b.symbol").alias("symbol"), F.col("b.shown").alias("name"), F.col("b.market").alias("market"),
        F.lit("US").alias("venue"), F.lit(True).alias("tradable"), F.lit("title_match").alias("source"),
        F.lit(None).cast("int").alias("market_cap_rank")).cast(ENTITY).alias("entity"))


def coin_entities(resolved: DataFrame) -> DataFrame:
    """Entities of resolved coins: (id, turn, entity); tradable when the exchange lists them."""
    return resolved.where("status = 'ok'").select("id", F.col("pos").alias("turn"), F.struct(
        "symbol", F.coalesce("name", "symbol").alias("name"), F.lit("crypto").alias("market"),
        F.when(F.col("on_exchange"), "spot").otherwise("other").alias("venue"), F.col("on_exchange").alias("tradable"),
        F.lit("coin_metrics").alias("source"), F.col("market_cap_rank").cast("int").alias("market_cap_rank")).cast(ENTITY)
        .alias("entity"))


def tradable_entities(coins: DataFrame, symbols: DataFrame, titles: DataFrame, keep: int = 6) -> DataFrame:
    """(id, tradable_entities, tradable_count): one entity a symbol, coins first; tradable ones lead."""
    pool = coins.withColumn("part", F.lit(0)).unionByName(symbols.withColumn("part", F.lit(1))).unionByName(
        titles.withColumn("part", F.lit(2)))
    one = pool.groupBy("id", F.col("entity.symbol").alias("_s")).agg(
        F.min_by(F.struct("part", "turn", "entity"), F.struct("part", "turn")).alias("r"))
    market = F.when(F.col("r.entity.market") == "crypto", 0).when(F.col("r.entity.market") == "us_stock", 1).otherwise(2)
    rank = F.coalesce(F.when(F.col("r.entity.market_cap_rank") != 0, F.col("r.entity.market_cap_rank")), F.lit(9999))
    key = F.struct((~F.col("r.entity.tradable")).alias("k1"), market.alias("k2"), rank.alias("k3"),
                   F.col("r.part").alias("k4"), F.col("r.turn").alias("k5"), F.col("r.entity").alias("entity"))
    out = one.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(key)), 1, keep).alias("a"))
    ents = F.transform("a", lambda x: x["entity"])
    return out.select("id", ents.alias("tradable_entities"),
                      F.size(F.filter(ents, lambda e: e["tradable"])).alias("tradable_count"))


# --- posts ------------------------------------------------------------------------------------------------

def social_interactions(events: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, social_interactions): likes, reposts, replies and quotes over an event's post sources."""
    ids = events.select("id", F.explode("sources.x_tweet_id").alias("_t")).where("_t IS NOT NULL")
    m = posts.select(F.col("tweet_id").alias("_p"), (F.col("like_count") + F.col("retweet_count") + F.col("reply_count")
                                                     + F.col("quote_count")).alias("n"))
    sums = ids.join(m, F.col("_t") == F.col("_p")).groupBy("id").agg(F.sum("n").alias("n"))
    return events.select("id").join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("social_interactions"))


def attach_posts(events: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, x_posts): the distinct posts of an event in source order."""
    ids = events.select("id", F.posexplode("sources.x_tweet_id").alias("pos", "_t")).where("_t IS NOT NULL")
    ids = ids.groupBy("id", "_t").agg(F.min("pos").alias("pos"))
    cols = ["tweet_id", "kol_username", "like_count", "retweet_count", "reply_count", "quote_count", "impression_count"]
    met = ids.join(posts.select(*cols), F.col("_t") == F.col("tweet_id")).groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*cols).alias("post")))), lambda x: x["post"])
        .alias("x_posts"))
    return events.select("id").join(met, "id", "left").withColumn("x_posts", F.coalesce("x_posts", F.array().cast(
        met.schema["x_posts"].dataType)))
