"""Filters, gates and projections on items, posts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import times as T
from .graph import ordered_caps


def publish_time(text: Column, now: Column) -> Column:
    """Gate and repair of one publish time: null means the item is to be dropped."""
    when = T.iso_wall(text)
    age_days = T.days_between(now, when)
    return (F.when(age_days > D.MAX_AGE_DAYS, F.lit(None).cast("timestamp_ntz"))
            .when(age_days < -D.MAX_FUTURE_HOURS / 24, now).otherwise(when))


def freshness_gate(items: DataFrame, now) -> DataFrame:
    """Drop items without a believable publish time; the time becomes a UTC clock column."""
    return items.withColumn("published_ts", publish_time(F.col("published_at"), T.wall(now))).where(
        "published_ts IS NOT NULL")


def freshness_drops(items: DataFrame, now) -> DataFrame:
    """How many items of each source the gate drops."""
    return items.where(publish_time(F.col("published_at"), T.wall(now)).isNull()).groupBy("source").agg(
        F.count("*").alias("dropped"))


def drop_excluded_titles(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce("title", F.lit("")).rlike(D.EXCLUDED_MARKET))


def drop_excluded_events(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce("title_zh", F.lit("")).rlike(D.EXCLUDED_MARKET)
                        & ~F.col("market_scope").eqNullSafe("cn_a_share"))


def is_aggregator(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("")).isin(*D.AGGREGATOR_TYPES)


def untrusted(title: Column, summary: Column, kind: Column) -> Column:
    """An aggregator's item without a body of its own: its publish time can not be checked."""
    return is_aggregator(kind) & ~X.has_body(title, summary)


def drop_untrusted(items: DataFrame) -> DataFrame:
    return items.where(~untrusted(F.col("title"), F.col("summary"), F.col("type")))


def all_aggregated(sources: Column) -> Column:
    return F.coalesce((F.size(sources) > 0) & F.forall(sources, lambda s: is_aggregator(s["type"])), F.lit(False))


def event_date_age(now) -> Column:
    day = F.substring(T.strip(F.coalesce("event_date", F.lit(""))), 1, 10)
    good = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
    return T.days_between(T.wall(now), good.cast("timestamp_ntz"))


def split_by_event_date(events: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows dated too far back or ahead are dropped, unreadable dates are kept."""
    aged = events.withColumn("age_days", event_date_age(now))
    bad = F.coalesce((F.col("age_days") > D.EVENT_MAX_AGE_DAYS)
                     | (F.col("age_days") < -D.EVENT_MAX_FUTURE_DAYS), F.lit(False))
    return aged.where(~bad), aged.where(bad)


def search_gate(items: DataFrame, now) -> DataFrame:
    """First three rules on search results: title length, topic of unknown hosts, age of at most 48 hours."""
    title = T.strip(F.coalesce("title", F.lit("")))
    blob = F.concat_ws(" ", title, F.coalesce("summary", F.lit("")))
    on_topic = (F.col("authority") != 2) | blob.rlike(D.TOPIC_CRYPTO) | blob.rlike(D.TOPIC_MARKET)
    age = T.hours_between(T.wall(now), T.iso_wall(F.col("published_at")))
    return items.where((F.length(title) >= 6) & on_topic & (age >= -1) & (age <= D.SEARCH_MAX_AGE_HOURS))


def search_dedup(items: DataFrame, order: str) -> DataFrame:
    """One ordered pass: an item goes when a kept item has its url key or its title key."""
    key = X.url_key(F.col("url"))
    keyed = items.withColumn("url_key", F.when(key != "", key)).withColumn(
        "title_key", X.title_key(T.strip(F.col("title"))))
    kept = ordered_caps(keyed, order, {"url_key": 1, "title_key": 1})
    return keyed.join(kept, order, "left_semi")


def domain_authority(items: DataFrame, listed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Authority by exact host, 2 for others; blocked hosts are removed."""
    keyed = items.withColumn("domain", X.host(F.col("url"))).join(blocked.select("domain"), "domain", "left_anti")
    return keyed.join(listed.select("domain", F.col("authority").alias("listed")), "domain", "left").withColumn(
        "domain_authority", F.coalesce("listed", F.lit(2))).drop("listed")


def named_authority(rows: DataFrame, name: str, table: DataFrame, default: int) -> DataFrame:
    """Authority of a channel or an account from a table of (name, authority)."""
    t = table.select(F.col("name").alias("_n"), F.col("authority").alias("_a"))
    return rows.join(t, F.col(name) == F.col("_n"), "left").withColumn(
        "named_authority", F.coalesce("_a", F.lit(default))).drop("_n", "_a")


def author_authority(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Known accounts by table, others 3 from a hundred thousand followers up, else 2."""
    t = known.select(F.lower("name").alias("_n"), F.col("authority").alias("_a"))
    return posts.join(t, F.lower("kol_username") == F.col("_n"), "left").withColumn(
        "author_authority", F.coalesce(F.when(F.col("_a") != 0, F.col("_a")),
                                       F.when(F.col("followers") >= 100_000, 3).otherwise(2))).drop("_n", "_a")


def engagement() -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in ("retweet_count", "reply_count", "quote_count")),
               F.coalesce("like_count", F.lit(0)))


def post_reject_reason() -> Column:
    """The first quality rule a post fails, null when it passes all."""
    text = F.coalesce("tweet_body", F.lit(""))
    body = X.clean_post(text)
    short = F.length(body) < F.when(body.rlike(D.CJK), 18).otherwise(40)
    tags = ((F.regexp_count(text, F.lit(r"\$[A-Za-z]{2,10}\b")) > 4)
            | (F.regexp_count(text, F.lit(r"(?U)#\w+")) > 5) | (F.regexp_count(text, F.lit(r"(?U)@\w+")) > 5))
    need = X.lookup(D.MIN_ENGAGEMENT, F.coalesce("category", F.lit("")), D.MIN_ENGAGEMENT_DEFAULT)
    return (F.when(short, "short").when(tags, "tag_spam").when(text.rlike(D.POST_SPAM), "spam")
            .when(engagement() < need, "engagement").when(F.coalesce("followers", F.lit(0)) < 500, "followers")
            .when(F.coalesce("bio", F.lit("")).rlike(D.PROMO_BIO), "promo"))


def search_posts(posts: DataFrame, order: str, per_author: int = 3, run_cap: int = 150) -> DataFrame:
    """Posts that pass, one for each copied text, at most three an author, then the most engaged ones."""
    good = posts.where(post_reject_reason().isNull()).withColumn("text_key", X.post_key(F.col("tweet_body")))
    kept = ordered_caps(good, order, {"kol_username": per_author, "text_key": 1})
    return good.join(kept, order, "left_semi").withColumn("engagement", engagement()).orderBy(
        F.col("engagement").desc(), order).limit(run_cap)


def first_by_post_key(posts: DataFrame, order: str) -> DataFrame:
    """The first post of each copied text."""
    keyed = posts.withColumn("text_key", X.post_key(F.col("tweet_body")))
    place = F.row_number().over(Window.partitionBy("text_key").orderBy(order))
    return keyed.withColumn("_p", place).where("_p <= 1").drop("_p")


def staging_priority(macro: list[str] = D.PRIORITY_MACRO, crypto: list[str] = D.PRIORITY_CRYPTO) -> Column:
    """Queue priority of an item: macro desks, index symbols, crypto desks, others, single names.

    A deployment adds the announcement channels it trusts to ``crypto``.
    """
    source = T.strip(F.coalesce("source", F.lit("")))
    symbols = F.transform(F.split(F.coalesce("matched_symbols", F.lit("")), ","), T.strip)
    index = F.arrays_overlap(symbols, F.array(*[F.lit(s) for s in D.INDEX_SYMBOLS]))
    return (F.when(source.isin(*macro), 0)
            .when(source.startswith("dxFeed"), F.when(index, 1).otherwise(4))
            .when(source.isin(*crypto) | (F.col("type") == "market_signal"), 2).otherwise(3))


def feed_predicate(now, sector=None, source=None, news_type=None, scope=None, tier=None, is_rumor=None,
                   date_from=None, date_to=None, run_at=None, max_age_days: int = 5) -> Column:
    """The predicate of a feed request; the age limit is off once a date or a run is asked for."""
    p = F.lit(True)
    if sector:
        p &= F.array_contains("sectors", sector)
    if source:
        p &= (F.exists("source_names", lambda s: s.startswith(source[:-1])) if source.endswith("*")
              else F.array_contains("source_names", source))
    for name, value in (("news_type", news_type), ("market_scope", scope), ("event_tier", tier), ("is_rumor", is_rumor)):
        if value is not None:
            p &= F.col(name) == value
    if max_age_days > 0 and not (date_from or date_to or run_at):
        p &= F.col("date") >= F.date_sub(T.wall(now).cast("date"), max_age_days)
    if date_from:
        p &= F.col("date") >= F.lit(date_from).cast("date")
    if date_to:
        p &= F.col("date") <= F.lit(date_to).cast("date")
    if run_at:
        p &= (F.col("time_get_data") >= T.wall(run_at)) & (
            F.col("time_get_data") < F.timestamp_add("HOUR", F.lit(12), T.wall(run_at)))
    return p


def feed_page(events: DataFrame, predicate: Column, sort: str = "importance", limit: int = 20,
              offset: int = 0) -> DataFrame:
    order = "importance_score" if sort == "importance" else "time_get_data"
    return events.where(predicate).orderBy(F.col(order).desc_nulls_last(), "id").offset(offset).limit(min(limit, 100))


def posts_page(posts: DataFrame, author: str | None = None, sort: str = "date", limit: int = 20) -> DataFrame:
    by = {"likes": "like_count", "impressions": "impression_count"}.get(sort, "published_at")
    rows = posts if author is None else posts.where(F.col("kol_username") == author)
    return rows.orderBy(F.col(by).desc(), "tweet_id").limit(min(limit, 100))


def posts_of_event(events: DataFrame, posts: DataFrame, event_id) -> DataFrame:
    ids = events.where(F.col("id") == event_id).select(F.explode("sources.x_tweet_id").alias("tweet_id"))
    return posts.join(ids.distinct(), "tweet_id", "left_semi").orderBy(F.col("like_count").desc(), "tweet_id")


def parse_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """JSON text columns to typed ones; text that does not parse stays beside as ``<name>_raw``."""
    for name, schema in schemas.items():
        parsed = F.from_json(name, schema)
        df = df.withColumn(f"{name}_raw", F.when(F.col(name).isNotNull() & parsed.isNull(), F.col(name))).withColumn(
            name, F.coalesce(parsed, F.array().cast(schema)) if schema.lower().startswith("array") else parsed)
    return df
