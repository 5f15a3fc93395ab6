"""Source verification: who reports, how many of them count, does the time line hold, who denies it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import times as T
from ..session import cut_lineage
from .similarity import Match, Tile, tile_join, vector_rows

_TIERS = list(D.SOURCE_TIER_WEIGHT)


def _tier_weight(tier: Column) -> Column:
    return X.lookup(D.SOURCE_TIER_WEIGHT, tier, D.SOURCE_TIER_WEIGHT["secondary"])


def _dictionary(inst: DataFrame, kind: str, prefix: str) -> DataFrame:
    return inst.where(F.col("kind") == kind).select(
        F.lower("key").alias(f"{prefix}_key"), F.col("inst").alias(f"{prefix}_inst"), F.col("tier").alias(f"{prefix}_tier"))


def _domain_owner(domains: DataFrame, inst: DataFrame) -> DataFrame:
    """Owner of each distinct domain: the longest listed parent that keeps at least two labels."""
    parts = F.split("domain", r"\.")
    whole = F.struct(F.lit(0).alias("cut"), F.col("domain").alias("parent"))
    parents = F.when(F.size(parts) > 2, F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 2)),
        lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("parent"))))
    tried = domains.select("domain", F.explode(F.concat(F.array(whole), F.coalesce(
        parents, F.array().cast("array<struct<cut:int,parent:string>>")))).alias("p"))
    known = tried.join(_dictionary(inst, "domain", "d"), F.col("p.parent") == F.col("d_key"))
    return known.groupBy("domain").agg(F.min_by(F.struct("d_inst", "d_tier"), F.col("p.cut")).alias("o")).select(
        F.col("domain").alias("o_domain"), "o.d_inst", "o.d_tier")


def resolve_sources(df: DataFrame, inst: DataFrame, ugc_url: str | None = None, ugc_inst: str = "ugc") -> DataFrame:
    """Add (inst, tier, weight) of the ``source`` struct (name, url, type).

    ``inst`` is the institution table: kind (name, domain, handle, name_tier), key, inst, tier.
    """
    name = F.lower(T.strip(F.coalesce(F.col("source.name"), F.lit(""))))
    handle = F.when(name.startswith("x/"), T.strip(F.split(F.expr("substring(_name, 3)"), "/")[0]))
    url = F.coalesce(F.col("source.url"), F.lit(""))
    rows = df.withColumn("_name", name).withColumn("_handle", handle).withColumn("_domain", X.domain(url))
    owners = _domain_owner(rows.select(F.col("_domain").alias("domain")).where("domain != ''").distinct(), inst)
    tiers = inst.where("kind = 'name_tier'").select(F.lower("key").alias("t_key"), F.col("tier").alias("t_tier"))
    j = (rows.join(_dictionary(inst, "name", "n"), F.col("_name") == F.col("n_key"), "left")
         .join(_dictionary(inst, "handle", "h"), F.col("_handle") == F.col("h_key"), "left")
         .join(owners, F.col("_domain") == F.col("o_domain"), "left")
         .join(tiers, F.col("_name") == F.col("t_key"), "left"))
    is_ugc = url.rlike(ugc_url) if ugc_url else F.lit(False)
    by_name, by_handle = F.col("n_inst").isNotNull(), F.col("_handle").isNotNull()
    searched = F.coalesce(F.col("source.type"), F.lit("rss")).isin("web_search", "search")
    who = (F.when(is_ugc, F.lit(ugc_inst)).when(by_name, F.col("n_inst"))
           .when(by_handle, F.coalesce("h_inst", F.concat(F.lit("x:"), F.when(F.col("_handle") == "", "unknown")
                                                          .otherwise(F.col("_handle")))))
           .when(F.col("d_inst").isNotNull(), F.col("d_inst"))
           .when(F.col("_domain") != "", F.concat(F.lit("web:"), "_domain"))
           .otherwise(F.concat(F.lit("name:"), F.when(F.col("_name") == "", "unknown").otherwise(F.col("_name")))))
    tier = (F.when(is_ugc, F.lit("secondary")).when(by_name, F.coalesce("t_tier", "n_tier"))
            .when(by_handle & F.col("h_inst").isNotNull(), F.coalesce("t_tier", "h_tier"))
            .when(by_handle, F.lit("anonymous")).when(F.col("d_inst").isNotNull(), F.coalesce("t_tier", "d_tier"))
            .when(searched, F.lit("unknown")).otherwise(F.lit("secondary")))
    out = j.select(*df.columns, who.alias("inst"), tier.alias("tier"))
    return out.withColumn("weight", _tier_weight(F.col("tier")))


def event_sources(events: DataFrame) -> Column:
    """Sources of an event with the names only listed by name added as plain feeds."""
    names = F.filter(F.transform(F.coalesce("source_names", F.array().cast("array<string>")), T.strip),
                     lambda n: n.isNotNull() & (n != ""))
    known = F.transform("sources", lambda s: T.strip(F.coalesce(s["name"], F.lit(""))))
    short = F.transform("sources", lambda s: F.struct(
        s["name"].alias("name"), s["url"].alias("url"), s["type"].alias("type"), s["x_tweet_id"].alias("x_tweet_id")))
    blank = F.lit(None).cast(events.schema["sources"].dataType.elementType["x_tweet_id"].dataType)
    extra = F.transform(F.array_except(names, known), lambda n: F.struct(
        n.alias("name"), F.lit("").alias("url"), F.lit("rss").alias("type"), blank.alias("x_tweet_id")))
    return F.concat(short, extra)


def source_rows(events: DataFrame, inst: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """One resolved row for each (id, pos) source, with the copy-paste key of its post."""
    rows = events.select("id", F.posexplode(event_sources(events)).alias("pos", "source"))
    rows = resolve_sources(rows, inst)
    if posts is None:
        return rows.withColumn("text_key", F.lit(None).cast("string"))
    keys = posts.select(F.col("tweet_id").alias("_t"), X.post_key(F.col("tweet_body")).alias("text_key"))
    return rows.join(keys, F.col("source.x_tweet_id") == F.col("_t"), "left").drop("_t").withColumn(
        "text_key", F.when(F.col("text_key") != "", F.col("text_key")))


def fold_reposts(rows: DataFrame) -> DataFrame:
    """Mark sources that repeat a post text for which another institution of the event weighs most."""
    best = rows.where("text_key IS NOT NULL").groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_k")).agg(
        F.max_by("inst", F.struct(F.col("weight"), -F.col("pos"))).alias("_best"))
    out = rows.join(best, (F.col("id") == F.col("_id")) & (F.col("text_key") == F.col("_k")), "left")
    return out.withColumn("folded", F.coalesce(F.col("inst") != F.col("_best"), F.lit(False))).drop("_id", "_k", "_best")


def evidence(rows: DataFrame, reposters: list[str] = ()) -> DataFrame:
    """Evidence profile of each event from its marked source rows."""
    folded = rows.groupBy("id").agg(F.count_if("folded").alias("n_folded"))
    kept = rows.where(~F.col("folded"))
    by_inst = kept.groupBy("id", "inst").agg(
        F.max("weight").alias("w"), F.min("pos").alias("pos"),
        F.max_by("tier", F.struct(F.col("weight"), -F.col("pos"))).alias("tier"))
    worth = F.col("w") * (F.when(F.col("inst").isin(*reposters), D.REPOST_DISCOUNT).otherwise(1.0) if reposters
                          else F.lit(1.0))
    best = F.struct(F.col("w"), -F.col("pos"))
    prof = by_inst.withColumn("worth", worth).groupBy("id").agg(
        F.max_by(F.struct("inst", "tier", "worth"), best).alias("b"), F.max("w").alias("best_weight"),
        F.sum("worth").alias("all_worth"), F.count("*").alias("n_institutions"),
        F.count_if(F.col("w") >= D.CREDIBLE_FLOOR).alias("n_credible"),
        F.bool_or(F.col("tier") == "official").alias("has_official"))
    support = F.round(F.col("all_worth") - F.col("b.worth"), 12)
    return folded.join(prof, "id", "left").select(
        "id", F.coalesce("b.inst", F.lit("")).alias("best_inst"), F.coalesce("b.tier", F.lit("")).alias("best_tier"),
        F.coalesce("best_weight", F.lit(0.0)).alias("best_weight"),
        F.coalesce(F.least(F.lit(1.0), support / D.CORROBORATION_SATURATION), F.lit(0.0)).alias("corroboration"),
        F.coalesce("n_institutions", F.lit(0)).alias("n_institutions"),
        F.coalesce("n_credible", F.lit(0)).alias("n_credible"),
        F.coalesce("has_official", F.lit(False)).alias("has_official"), "n_folded")


def time_consistency(events: DataFrame, now, published: str = "time_event") -> DataFrame:
    """Add time_score and time_flags."""
    at = T.wall(now)
    p = F.col(published)
    age_hours = T.hours_between(at, p)
    calendar = F.coalesce(F.exists("sources", lambda s: s["type"] == "calendar"), F.lit(False))
    texts = F.concat_ws(" ", "title_zh", "title_en", "description_short_zh")
    day = F.substring(F.coalesce("event_date", F.lit("")), 1, 10)
    event_day = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date")).cast("timestamp_ntz")
    # columns of their own: flags and score then read the texts once, and the pattern only where one of its words is
    events = events.withColumn("_low", F.lower(texts))
    worded = reduce(lambda x, y: x | y, [F.contains("_low", F.lit(word)) for word in D.BREAKING_WORDS])
    events = events.withColumn("_recycled", (age_hours > 48) & worded & texts.rlike(D.BREAKING))
    rules = [("TIME_FUTURE_PUBLISH", age_hours < -6, 0.0), ("TIME_STALE", age_hours > 30 * 24, 0.4),
             ("TIME_RECYCLED_BREAKING", F.col("_recycled"), 0.3),
             ("TIME_DATE_MISMATCH", F.abs(T.days_between(event_day, p)) > 7, 0.5)]
    flags = F.array_compact(F.array(*[F.when(cond, F.lit(flag)) for flag, cond, _ in rules]))
    score = F.least(F.lit(1.0), *[F.when(cond, F.lit(cap)).otherwise(1.0) for _, cond, cap in rules])
    return events.withColumn("time_score", F.when(calendar, 1.0).when(p.isNull(), 0.6).otherwise(score)).withColumn(
        "time_flags", F.when(calendar, F.array().cast("array<string>"))
        .when(p.isNull(), F.array(F.lit("TIME_UNPARSEABLE"))).otherwise(flags)).drop("_recycled", "_low")


def is_denial() -> Column:
    return F.concat_ws(" ", F.coalesce("title_zh", F.lit("")), F.coalesce("title_en", F.lit(""))).rlike(D.DENIAL)


def _deniers(a: Tile, b: Tile, m: Match) -> pd.DataFrame:
    """For each claim in the left tile: how many deniers, and the first two by order."""
    order = np.lexsort((b.ord[m.right], m.left))
    claim, start, n = np.unique(m.left[order], return_index=True, return_counts=True)
    first = [m.right[order[s:s + min(k, 2)]] for s, k in zip(start, n)]
    return pd.DataFrame({"id": a.id[claim], "n": n, "others": [b.id[f].tolist() for f in first], "ords": [b.ord[f].tolist() for f in first]})


def denial_disputes(events: DataFrame, reference: DataFrame | None, weights: DataFrame,
                    threshold: float = D.COSINE_CONTRADICTION, window_hours: float = 96.0, **kw) -> DataFrame:
    """Claims a credible denial stands against: (id, n, first two deniers by order).

    Only new rows are marked; deniers come from the new and the reference rows.
    """
    hours = T.hours_between(F.col("time_event"), T.wall("1970-01-01 00:00:00"))

    def flagged(df):
        """Rows with a vector, their titles read once."""
        rows = vector_rows(df, "id", "embedding", hours, "ord", extra=["title_zh", "title_en"])
        return cut_lineage(rows.withColumn("_d", is_denial()).drop("title_zh", "title_en"))

    new = flagged(events)
    pool = new if reference is None else new.unionByName(flagged(reference))
    deniers = pool.where("_d").join(weights.where(F.col("best_weight") >= D.CREDIBLE_FLOOR).select("id"), "id", "left_semi")
    rows = [new.where("NOT _d").drop("_d"), deniers.drop("_d")]
    id_type = rows[0].schema["id"].dataType.simpleString()
    found = tile_join(*rows, _deniers, f"id {id_type}, n long, others array<{id_type}>, ords array<long>", threshold,
                      window_hours=window_hours, missing_time="pass", **kw)
    both = F.arrays_zip("ords", "others")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list(both))), 1, 2)
                                   .alias("f")).select("id", "n", F.transform("f", lambda x: x["others"]).alias("others"))


def opposite_disputes(events: DataFrame, reference: DataFrame | None = None, max_days: int = 2) -> DataFrame:
    """New rows whose subject also has the opposite action at most two days apart: (id, n).

    The pairs are never listed. Rows are first counted by subject, action and day; a row then adds
    up the counts of the opposite actions on the days around its own, and on unknown days.
    """
    pool = events if reference is None else events.unionByName(reference)

    def keyed(df):
        day = F.substring(F.coalesce("event_date", F.lit("")), 1, 10)
        return df.select("id", F.lower(T.strip(F.coalesce("event_subject", F.lit("")))).alias("subject"),
                         F.lower(T.strip(F.coalesce("event_action", F.lit("")))).alias("action"),
                         F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date")).alias("day")).where("subject != ''")

    both_ways = [(a, b) for a, b in D.OPPOSITE_ACTIONS] + [(b, a) for a, b in D.OPPOSITE_ACTIONS]
    against: dict[str, list[str]] = {}
    for a, b in both_ways:
        against.setdefault(a, []).append(b)
    opposite = F.create_map(*[x for a, bs in against.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    counts = keyed(pool).groupBy(F.col("subject").alias("s"), F.col("action").alias("x"), F.col("day").alias("d")).agg(
        F.count("*").alias("k"))
    mine = keyed(events).select("subject", "action", "day").distinct()
    asked = mine.where(F.col("action").isin(*against)).select("subject", "action", "day", F.explode(
        F.try_element_at(opposite, F.col("action"))).alias("want"))
    near = F.col("day").isNull() | F.col("d").isNull() | (F.abs(F.datediff("day", "d")) <= max_days)
    met = asked.join(counts, (F.col("subject") == F.col("s")) & (F.col("want") == F.col("x")) & near)
    summed = met.groupBy("subject", "action", "day").agg(F.sum("k").alias("n")).select(
        F.col("subject").alias("s"), F.col("action").alias("x"), F.col("day").alias("d"), "n")
    rows = keyed(events)
    return rows.join(summed, (F.col("subject") == F.col("s")) & (F.col("action") == F.col("x"))
                     & F.col("day").eqNullSafe(F.col("d"))).select("id", "n")


def verdicts(events: DataFrame, profile: DataFrame, disputes: DataFrame | None = None) -> DataFrame:
    """Verification score, status and flags of every event.

    ``events`` carries time_score, time_flags, credibility_score, is_rumor; ``disputes`` has (id, n).
    """
    e = events.join(profile, "id", "left")
    e = e.join(disputes.select("id", F.col("n").alias("_n")), "id", "left") if disputes is not None else e.withColumn(
        "_n", F.lit(0))
    disputed = F.coalesce("_n", F.lit(0)) > 0
    rumor = F.coalesce("is_rumor", F.lit(False))
    prior = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("credibility_score", F.lit(0.5))))
    raw = F.lit(0.9) * (F.lit(0.55) * F.col("best_weight") + F.lit(0.30) * F.col("corroboration")
                        + F.lit(0.15) * F.col("time_score")) + F.lit(0.1) * prior
    raw = raw * F.when(rumor, 0.9).otherwise(1.0)
    score = F.when(disputed, F.least(raw, F.lit(0.35))).otherwise(raw)
    lone = (F.col("n_institutions") <= 1) & (F.col("best_weight") < D.CREDIBLE_FLOOR)
    first = (F.when(disputed, "DISPUTED").when(F.col("has_official") & (F.size("time_flags") == 0), "VERIFIED")
             .when((F.col("n_credible") >= 2) & (score >= 0.70), "VERIFIED").when(score >= 0.50, "PROBABLE")
             .otherwise("UNVERIFIED"))
    second = F.when(lone, F.when(disputed, "DISPUTED").otherwise("UNVERIFIED")).otherwise(first)
    status = F.when(rumor & (second == "VERIFIED") & ~F.col("has_official") & (F.col("n_credible") < 3),
                    "PROBABLE").otherwise(second)
    flags = F.concat("time_flags", F.array_compact(F.array(
        F.when(F.col("n_folded") > 0, F.lit("REPOST_FOLDED")), F.when(rumor, F.lit("LLM_RUMOR")),
        F.when(disputed, F.lit("CONTRADICTED")), F.when(lone, F.lit("SINGLE_LOW_TRUST_SOURCE")))))
    return e.withColumn("verification_raw", X.clamp(score)).withColumn(
        "verification_score", F.round("verification_raw", 4)).withColumn(
        "verification_status", status).withColumn("verification_flags", flags).withColumn(
        "disputed", disputed).drop("_n")


_TIER_LABEL = {"official": "官方一手", "top_media": "头部媒体", "established": "主流加密媒体", "secondary": "聚合/转载站",
               "unknown": "陌生站点", "anonymous": "陌生个人账号"}
_FLAG_LABEL = {"TIME_FUTURE_PUBLISH": "发布时间在未来", "TIME_STALE": "发布时间超过 30 天",
               "TIME_RECYCLED_BREAKING": "自称快讯但内容陈旧", "TIME_DATE_MISMATCH": "事件日期与发布日期不符",
               "TIME_UNPARSEABLE": "发布时间无法解析"}


def reason_text(dispute_note: Column | None = None) -> Column:
    """Readable reason of a verdict; ``dispute_note`` is the text on contradicting reports."""
    n, label = F.col("n_institutions"), X.lookup(_TIER_LABEL, F.col("best_tier"), "未知")
    who = (F.when(n == 0, F.lit("无可识别信源"))
           .when(n == 1, F.concat(F.lit("单一信源（"), "best_inst", F.lit("，"), label, F.lit("）")))
           .otherwise(F.concat(n.cast("string"), F.lit(" 家独立机构报道（其中 "), F.col("n_credible").cast("string"),
                               F.lit(" 家达可信门槛），最高档 "), label)))
    parts = [who, F.when(F.col("n_folded") > 0, F.concat(F.lit("另有 "), F.col("n_folded").cast("string"),
                                                         F.lit(" 条判定为转发同一原文，未计入独立信源")))]
    if dispute_note is not None:
        parts.append(dispute_note)
    flags = F.transform("time_flags", lambda f: X.lookup(_FLAG_LABEL, f, ""))
    parts += [F.when(F.size("time_flags") > 0, F.array_join(flags, "；")),
              F.when(F.coalesce("is_rumor", F.lit(False)), F.lit("LLM 标记为传闻")),
              F.when((F.col("verification_status") == "UNVERIFIED") & (n <= 1), F.lit("孤证未获交叉验证"))]
    return F.concat_ws("；", *parts)


def status_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("verification_status").agg(
        F.count("*").alias("events"), F.count_if("disputed").alias("disputed"),
        F.sum("n_institutions").alias("institutions"), F.sum(F.col("n_institutions") - F.col("source_count")).alias(
            "diff_to_source_count"))


def flag_counts(verified: DataFrame) -> DataFrame:
    return verified.select(F.explode("verification_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("events"))
