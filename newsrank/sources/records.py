"""Landed records of every kind, brought to the one item layout.

Nothing here fetches: each function starts from a table or file set that a collector has landed.
Item columns: source, title, url, summary, published_at (ISO text), lang, authority, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import times as T
from ..operators.filters import drop_excluded_titles, freshness_gate

ITEM = ["source", "title", "url", "summary", "published_at", "lang", "authority", "type"]
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def plain_text(html: Column) -> Column:
    out = X.strip_tags(html)
    for mark, char in _ENTITIES:
        out = F.replace(out, F.lit(mark), F.lit(char))
    return out


def first_of(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key; the limit runs before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def feed_items(entries: DataFrame, per_source: int = 100) -> DataFrame:
    """Feed entries (source, pos, title, link, summary, published, updated, lang, authority) to items."""
    front = first_of(entries, ["source"], "pos", per_source)
    return front.select(
        "source", T.strip(F.coalesce("title", F.lit(""))).alias("title"), F.col("link").alias("url"),
        T.strip(F.substring(plain_text(F.coalesce("summary", F.lit(""))), 1, 500)).alias("summary"),
        F.coalesce("published", "updated", F.lit("")).alias("published_at"), "lang", "authority",
        F.lit("rss").alias("type")).where("title != ''")


def page_links(pages: DataFrame, href_pattern: str, min_chars: int, per_page: int = 25,
               cut_time: bool = True) -> DataFrame:
    """Article links of list pages (page_id, html): first link of each address, in page order.

    Works on the arrays of one page at a time, so it needs no shuffle.
    """
    anchor = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"),
                         F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))
    named = F.transform(found, lambda a: F.struct(
        a["href"].alias("href"), T.strip(plain_text(a["label"])).alias("title")))
    long_enough = F.filter(named, lambda a: a["href"].rlike(href_pattern) & (F.length(a["title"]) >= min_chars))
    first = F.filter(long_enough, lambda a, i: F.array_position(
        F.transform(long_enough, lambda b: b["href"]), a["href"]) == i + 1)
    if cut_time:
        first = F.filter(F.transform(first, lambda a: F.struct(
            a["href"].alias("href"),
            T.strip(F.regexp_replace(a["title"], r"\d{2}-\d{2}\s*\d{2}:\d{2}.*$", "")).alias("title"))),
            lambda a: F.length(a["title"]) >= min_chars)
    return pages.select("page_id", F.posexplode(F.slice(first, 1, per_page)).alias("pos", "a")).select(
        "page_id", "pos", "a.href", "a.title")


def wire_records(records: DataFrame, watched: list[str], authority: int = 5) -> DataFrame:
    """Symbol-tagged wire records (id, pos, title, body, time, provider, symbols), one for each id."""
    titled = records.withColumn("title", T.strip(F.coalesce("title", F.lit("")))).where("title != ''")
    hits = F.filter("symbols", lambda s: s.isin(*watched))
    return first_of(titled, ["id"], "pos", 1).select(
        "id", F.concat(F.lit("wire-"), "provider").alias("source"), "title",
        T.strip(F.coalesce("body", F.lit(""))).alias("summary"), F.col("time").alias("published_at"),
        F.concat_ws(",", F.slice(hits, 1, 12)).alias("matched_symbols"), F.lit("en").alias("lang"),
        F.lit(authority).alias("authority"), F.lit("wire").alias("type"))


def news_api_records(records: DataFrame, source: str, authority: int = 4) -> DataFrame:
    """News API rows (id, title, body, teaser, url, published, tickers)."""
    body = T.strip(F.coalesce(F.when(F.col("body") != "", F.col("body")), "teaser", F.lit("")))
    return records.select(
        "id", F.lit(source).alias("source"), T.strip(F.coalesce("title", F.lit(""))).alias("title"), "url",
        T.strip(X.strip_tags(body, " ")).alias("summary"), F.col("published").alias("published_at"),
        F.concat_ws(",", F.slice(F.coalesce("tickers", F.array().cast("array<string>")), 1, 12))
        .alias("matched_symbols"),
        F.lit("en").alias("lang"), F.lit(authority).alias("authority"),
        F.lit(source.lower()).alias("type")).where("title != ''")


def demote_backfill(staged: DataFrame, backfilled: DataFrame, today, floor: int = 4) -> DataFrame:
    """Open staged rows that a historical load brought, dated before ``today``, go to the last priority.

    ``backfilled`` holds url hashes; a repeated hash must not repeat the staged row.
    """
    mine = backfilled.select("url_hash").distinct().withColumn("hit", F.lit(True))
    old = F.col("hit") & F.col("consumed_at").isNull() & (F.col("day") < today) & (F.col("priority") < floor)
    return staged.join(mine, "url_hash", "left").withColumn(
        "priority", F.when(F.coalesce(old, F.lit(False)), F.lit(floor)).otherwise(F.col("priority"))).drop("hit")


def calendar_items(events: DataFrame, now_iso) -> DataFrame:
    """Calendar rows (id, title, shown_date, description, coins) that name at least one coin."""
    coins = F.transform(F.filter("coins", lambda c: c.isNotNull() & (c != "")), F.upper)
    title = T.strip(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("[催化剂日历] "), F.array_join(coins, "/"), F.lit(" 事件："), title,
                    F.lit("（时间："), F.col("shown_date"), F.lit("）"))
    more = F.when(F.coalesce("description", F.lit("")) != "",
                  F.concat(F.lit(" — "), F.substring("description", 1, 300))).otherwise("")
    return events.where((title != "") & (F.size(coins) > 0)).select(
        "id", F.lit("calendar").alias("source"),
        F.concat(F.array_join(F.slice(coins, 1, 3), "/"), F.lit(": "), title, F.lit(" ("), F.col("shown_date"),
                 F.lit(")")).alias("title"),
        F.concat(head, more).alias("summary"), F.lit(now_iso).alias("published_at"), F.lit("en").alias("lang"),
        F.lit(4).alias("authority"), F.lit("calendar").alias("type"))


def timeline_items(posts: DataFrame, min_chars: int = 30) -> tuple[DataFrame, DataFrame]:
    """Author posts to (news items, raw posts); posts under ``min_chars`` characters are dropped."""
    body = T.strip(F.col("tweet_body"))
    kept = posts.withColumn("tweet_body", body).where(F.length("tweet_body") >= min_chars).withColumn(
        "tweet_title", X.post_title(F.col("tweet_body")))
    items = kept.select(
        F.concat(F.lit("X/"), "kol_username").alias("source"), F.col("tweet_title").alias("title"),
        F.concat(F.lit("https://x.com/"), "kol_username", F.lit("/status/"), F.col("tweet_id").cast("string"))
        .alias("url"),
        F.substring("tweet_body", 1, 500).alias("summary"), "published_at", F.lit("x").alias("type"), "tweet_id")
    raw = kept.select("tweet_id", "kol_username", "tweet_title", "tweet_body", "like_count", "retweet_count",
                      "reply_count", "quote_count", "impression_count", "published_at")
    return items, raw


def merge_post_sources(timeline: DataFrame, search: DataFrame) -> DataFrame:
    """Timeline rows and the search rows whose post id the timeline does not hold."""
    return timeline.unionByName(search.join(timeline.select("tweet_id"), "tweet_id", "left_anti"),
                                allowMissingColumns=True)


def search_items(results: DataFrame, domain_authority: DataFrame, blocked: DataFrame, per_query: int = 30) -> DataFrame:
    """Search results (query, pos, title, publisher, publisher_url, link, summary, published, lang) to items."""
    d = F.when(X.domain(F.col("publisher_url")) != "", X.domain(F.col("publisher_url"))).otherwise(
        F.replace(F.lower("publisher"), F.lit(" "), F.lit("")))
    front = first_of(results, ["query"], "pos", per_query).withColumn("domain", d)
    titled = front.where(T.strip(F.col("title")) != "").join(blocked.select("domain"), "domain", "left_anti")
    ranked = titled.join(domain_authority.select("domain", F.col("authority").alias("listed")), "domain", "left")
    clean = X.clean_result_title(F.col("title"), F.col("publisher"))
    body = T.strip(X.strip_tags(F.coalesce("summary", F.lit(""))))
    return ranked.select(
        "query", "pos", F.when(F.col("publisher") == "", F.lit("search")).otherwise(F.col("publisher")).alias("source"),
        clean.alias("title"), F.col("link").alias("url"),
        F.substring(F.when(body == "", clean).otherwise(body), 1, 500).alias("summary"),
        F.col("published").alias("published_at"), "lang", F.coalesce("listed", F.lit(2)).alias("authority"),
        F.lit("web_search").alias("type"), "domain")


def union_sources(frames: list[DataFrame], now, only_sources: list[str] | None = None) -> DataFrame:
    """All source frames as one, with blank titles, the excluded market and stale rows removed."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    if only_sources:
        out = out.where(F.col("source").isin(*only_sources))
    return freshness_gate(drop_excluded_titles(out.where("title != ''")), now)


# --- market tables ---------------------------------------------------------------------------

def clean_tickers(raw: DataFrame, min_volume: float = D.MIN_QUOTE_VOLUME) -> DataFrame:
    """24-hour rows of plain spot pairs with good numbers and enough volume."""
    base = F.expr(f"left(symbol, length(symbol) - {len(D.QUOTE_ASSET)})")
    fields = {"last": "lastPrice", "change_pct": "priceChangePercent", "quote_volume": "quoteVolume",
              "high": "highPrice", "low": "lowPrice", "open": "openPrice"}
    rows = raw.select("symbol", base.alias("base"), *[F.col(v).try_cast("double").alias(k) for k, v in fields.items()],
                      F.coalesce(F.col("count").cast("long"), F.lit(0)).alias("trades"))
    for suffix in D.LEVERAGED_SUFFIXES:
        rows = rows.where(~F.col("symbol").endswith(suffix))
    return rows.where(F.col("symbol").endswith(D.QUOTE_ASSET) & (F.col("base") != "")
                      & ~F.col("base").isin(*D.STABLE_BASES)).na.drop(subset=list(fields)).where(
        (F.col("last") > 0) & (F.col("quote_volume") >= min_volume))


def closed_candles(candles: DataFrame, keep: int = 91) -> DataFrame:
    """The latest ``keep`` days of each symbol without the newest, unfinished one; ``age`` 1 is the last closed day."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc()))
    return candles.withColumn("back", back).where(f"back <= {keep}").where("back >= 2").withColumn(
        "age", F.col("back") - 1).drop("back")


def open_interest_by_base(rows: DataFrame) -> DataFrame:
    """One figure a base: the USDT contract where there is one, else the largest coin-margined one."""
    usdt = F.col("inst_id").endswith("-USDT-SWAP")
    coin = F.col("inst_id").endswith("-USD-SWAP")
    amount = F.col("oi_usd").try_cast("double")
    return rows.withColumn("base", F.regexp_extract("inst_id", "^(.*)-USDT?-SWAP$", 1)).where(
        (usdt | coin) & amount.isNotNull()).groupBy("base").agg(
        F.coalesce(F.max(F.when(usdt, amount)), F.max(F.when(coin, amount))).alias("oi_usd"))


def funding_apr(eight_hourly: DataFrame, hourly: DataFrame) -> DataFrame:
    """Yearly funding percent by base; the hourly venue fills bases the first venue lacks."""
    a = eight_hourly.select("base", (F.col("rate") * 3 * 365 * 100).alias("first"))
    b = hourly.select("base", (F.col("rate") * 24 * 365 * 100).alias("second"))
    return a.join(b, "base", "full").select("base", F.coalesce("first", "second").alias("apr"))


def liquidations_last_hour(rows: DataFrame, contracts: DataFrame, now_ms: Column, hours: float = 1.0) -> DataFrame:
    """Long and other liquidations by base inside the window, from nested detail arrays."""
    d = rows.select("inst_id", F.explode("details").alias("d")).join(contracts, "inst_id")
    notional = F.col("d.sz").try_cast("double") * F.col("ct_val") * F.col("d.bk_px").try_cast("double")
    d = d.select(F.regexp_extract("inst_id", "^(.*)-USDT-SWAP$", 1).alias("base"), F.col("d.pos_side").alias("side"),
                 F.col("d.ts").try_cast("double").alias("ts"), notional.alias("usd"))
    return d.where((F.col("ts") >= now_ms - F.lit(hours * 3600 * 1000)) & F.col("usd").isNotNull()).groupBy("base").agg(
        F.sum(F.when(F.col("side") == "long", F.col("usd")).otherwise(0.0)).alias("long_usd"),
        F.sum(F.when(F.col("side") == "long", 0.0).otherwise(F.col("usd"))).alias("short_usd"),
        F.sum("usd").alias("total_usd"), F.count("*").alias("n"))


# --- queue, catalogue ---------------------------------------------------------------------------

def queue_head(staged: DataFrame, now, limit: int = 400, max_age_days: int = 30,
               disabled: tuple[str, ...] = D.DISABLED_SOURCES) -> DataFrame:
    """The open rows to take next: best priority, then newest, then id."""
    fresh = F.col("fetched_at") >= F.timestamp_add("DAY", F.lit(-max_age_days), T.wall(now))
    return staged.where(F.col("consumed_at").isNull() & fresh & ~F.col("source").isin(*disabled)).orderBy(
        "priority", F.col("fetched_at").desc(), "id").limit(limit)


def source_catalog(registry: DataFrame, events: DataFrame, institutions_of) -> DataFrame:
    """Registered and seen sources with institution, tier, weight and event count.

    ``institutions_of`` resolves a frame with a ``source`` struct (see ``operators.verify``).
    """
    seen = events.select(F.explode("source_names").alias("name")).groupBy("name").agg(F.count("*").alias("events"))
    names = registry.join(seen, "name", "full").withColumn("events", F.coalesce("events", F.lit(0)))
    shaped = names.withColumn("source", F.struct("name", F.coalesce("url", F.lit("")).alias("url"),
                                                 F.coalesce("type", F.lit("rss")).alias("type")))
    return institutions_of(shaped).select("name", "inst", "tier", "weight", "events")
