"""De-duplication, clustering and merging."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scores as S
from ..functions import text as X
from ..functions import times as T
from ..session import cut_lineage
from .graph import authority_pass, cluster_of, key_links, mutual_best
from .similarity import link_degree, nearest, similar_links, similar_pairs, cross_pairs, tile_join, vector_rows
from .title_join import packed_titles, sparse_pairs


def event_hours(ts: Column) -> Column:
    return T.hours_between(ts, T.wall("1970-01-01 00:00:00"))


# --- staging and first passes -------------------------------------------------------------------

def stage_upsert(staged: DataFrame, fetched: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(queue after the round, new and repeat counts).

    ``fetched`` has url_hash, priority, matched_symbols and item columns in fetch order ``ord``. A
    repeat only refreshes the fetch time, lifts the priority and fills symbols.
    """
    payload = [c for c in fetched.columns if c not in ("url_hash", "priority", "matched_symbols", "ord")]
    batch = fetched.where("url_hash IS NOT NULL").groupBy("url_hash").agg(
        F.min_by(F.struct(*payload), "ord").alias("item"), F.min("priority").alias("priority"),
        F.max_by("matched_symbols", F.when(F.coalesce("matched_symbols", F.lit("")) != "", F.col("ord"))).alias("symbols"),
        F.count("*").alias("seen")).withColumn("symbols", F.when(F.col("symbols") != "", F.col("symbols")))
    met = staged.withColumnRenamed("url_hash", "_h").withColumnRenamed("priority", "_p").join(
        batch, F.col("_h") == F.col("url_hash"), "full")
    is_new, hit = F.col("_h").isNull(), F.col("url_hash").isNotNull()
    out = [F.coalesce("_h", "url_hash").alias("url_hash"), F.least("_p", "priority").alias("priority"),
           F.coalesce("symbols", "matched_symbols").alias("matched_symbols"),
           F.when(hit, T.wall(now)).otherwise(F.col("fetched_at")).alias("fetched_at")]
    kept = {"url_hash", "priority", "matched_symbols", "fetched_at"}
    for c in staged.columns:
        if c not in kept:
            out.append((F.when(is_new, F.col(f"item.{c}")).otherwise(F.col(c)) if c in payload else F.col(c)).alias(c))
    counts = batch.join(staged.select(F.col("url_hash").alias("_h")), F.col("url_hash") == F.col("_h"), "left").agg(
        F.count_if(F.col("_h").isNull()).alias("new"),
        F.sum(F.col("seen") - F.when(F.col("_h").isNull(), 1).otherwise(0)).alias("duplicate"))
    return met.select(*out), counts


def first_by_url(items: DataFrame, order: str) -> DataFrame:
    """The first item of each url; items without one all stay."""
    keyed = items.withColumn("_k", X.bare_url(F.col("url")))
    place = F.row_number().over(Window.partitionBy("_k").orderBy(order))
    first = keyed.where("_k != ''").withColumn("_p", place).where("_p <= 1").drop("_p")
    return first.unionByName(keyed.where("_k = ''")).drop("_k")


def title_text(title: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+", " "))


def title_vectors(items: DataFrame, order: str, title: str, **kw) -> DataFrame:
    """Sparse TF-IDF of each distinct title with letters, packed: (g, n_rows, packed).

    ``g`` is the first order of the title; document counts take every row into account.
    """
    titles = cut_lineage(items.select(F.col(order).alias("o"), title_text(title).alias("t")).groupBy("t").agg(
        F.min("o").alias("g"), F.count("*").alias("copies")))
    n_rows = titles.agg(F.sum("copies").alias("n_rows"))
    return packed_titles(titles.crossJoin(F.broadcast(n_rows)), **kw)


def title_pairs(vectors: DataFrame, threshold: float = D.TITLE_COSINE, **kw) -> DataFrame:
    """Pairs of titles with cosine above the threshold."""
    return sparse_pairs(vectors, threshold, **kw)


def prefilter_titles(items: DataFrame, order: str, title: str = "title", authority: str = "authority",
                     threshold: float = D.TITLE_COSINE) -> DataFrame:
    """Items left after the ordered near-duplicate pass on titles."""
    vectors = cut_lineage(title_vectors(items, order, title))
    pairs = title_pairs(vectors, threshold)
    rows = items.select(F.col(order).alias("o"), title_text(title).alias("t"), F.coalesce(authority, F.lit(0)).alias("auth"))
    groups = rows.groupBy("t").agg(F.min("o").alias("g"))
    # a title without letters has an all-zero vector and is a duplicate of nothing, itself included
    empty = rows.where("t = ''").select("o")
    kept = authority_pass(rows.where("t != ''").join(groups, "t").select("o", "g", "auth"), pairs)
    return items.join(kept.unionByName(empty).withColumnRenamed("o", order), order, "left_semi")


def prefilter_vectors(items: DataFrame, order: str, vec: str = "embedding", authority: str = "authority",
                      threshold: float = D.COSINE_SAME_EVENT, **kw) -> DataFrame:
    """Items left after the same ordered pass on vectors; items without one pass through."""
    rows = vector_rows(items, order, vec, extra=[authority])
    copies = rows.groupBy("vec").agg(F.min("ord").alias("g"))
    nodes = copies.join(rows.select("id", "ord", "hours", "grp", F.col("vec").alias("_v")), F.col("g") == F.col("ord"))
    pairs = similar_pairs(nodes.select("id", "ord", "vec", "hours", "grp"), threshold, strict=True, **kw)
    members = rows.join(copies, "vec").select(F.col("ord").alias("o"), "g", F.coalesce(authority, F.lit(0)).alias("auth"))
    kept = authority_pass(members, pairs.select("a", "b"))
    no_vector = items.select(F.col(order).alias("o")).join(rows.select(F.col("ord").alias("o")), "o", "left_anti")
    return items.join(kept.unionByName(no_vector).withColumnRenamed("o", order), order, "left_semi")


# --- vectors -----------------------------------------------------------------------------------

def unit_vector(vec: Column, kind: str = "double") -> Column:
    """The vector at length one, or as it is when it is all zero. The length is worked out once, in the finish step."""
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x, lambda a: F.transform(
        vec, lambda x: F.when(a > 1e-18, x / F.sqrt(a)).otherwise(x).cast(kind)))


def fill_vectors(items: DataFrame, cached: DataFrame, computed: DataFrame, size: int = 256) -> DataFrame:
    """Cached vector when it has the right size, else the computed one made unit length, else zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    j = (items.join(cached.select(F.col("url_hash").alias("_c"), F.col("embedding").alias("_cv")),
                    F.col("url_hash") == F.col("_c"), "left")
         .join(computed.select(F.col("url_hash").alias("_m"), F.col("embedding").alias("_mv")),
               F.col("url_hash") == F.col("_m"), "left"))
    unit = unit_vector(F.col("_mv"), "float")
    return j.withColumn("embedding", F.when(F.size("_cv") == size, F.col("_cv")).when(F.size("_mv") == size, unit)
                        .otherwise(zeros)).withColumn(
        "vector_from", F.when(F.size("_cv") == size, "cache").when(F.size("_mv") == size, "computed")
        .otherwise("none")).drop("_c", "_cv", "_m", "_mv")


def with_fingerprints(items: DataFrame) -> DataFrame:
    """Event fingerprint; a row without subject or action gets the hash of its title and day."""
    published = F.substring(F.coalesce("published_at", F.lit("")), 1, 10)
    day = F.coalesce(F.when(F.col("event_date") != "", F.col("event_date")), published)
    key = X.event_fingerprint(F.col("event_subject"), F.col("event_action"), day)
    return items.withColumn("fingerprint_missing", key.isNull()).withColumn(
        "event_fingerprint", F.coalesce(key, X.fallback_id(F.col("title_en"), published)))


# --- clustering inside a round --------------------------------------------------------------------

def cluster_items(items: DataFrame, id: str = "id", title: str = "title_en", fingerprint: str = "event_fingerprint",
                  vec: str = "embedding", published: str = "time_event", threshold: float = D.COSINE_SAME_EVENT,
                  window_hours: float = D.WINDOW_HOURS, **kw) -> DataFrame:
    """(id, cluster): same title key, same fingerprint, or similar vectors near in time, closed over chains."""
    edges = key_links(items, id, X.normalize_title(F.col(title))).unionByName(
        key_links(items, id, F.col(fingerprint)))
    rows = vector_rows(items, id, vec, event_hours(F.col(published)))
    edges = edges.unionByName(similar_links(rows, threshold, window_hours, "pass", **kw))
    return cluster_of(items.select(F.col(id).alias("id")), edges)


def merge_clusters(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """One event for each cluster.

    ``items`` has id, ord, authority, description_short_en, source, url, type, published_at, tweet_id,
    matched_symbols, source text columns, event_fingerprint, embedding.
    """
    m = items.join(clusters, "id")
    best = F.struct(F.coalesce("authority", F.lit(0)), F.length(F.coalesce("description_short_en", F.lit(""))), -F.col("ord"))
    carried = [c for c in items.columns if c not in ("id", "embedding")]
    head = m.groupBy("cluster").agg(F.max_by(F.struct("id", *carried), best).alias("p"), F.count("*").alias(
        "merged_sources_count"))
    url = F.coalesce("url", F.lit(""))
    per_url = m.groupBy("cluster", url.alias("u")).agg(F.min_by(F.struct(
        F.col("ord").alias("pos"), F.coalesce("source", F.lit("")).alias("name"), url.alias("url"),
        F.coalesce("type", F.lit("rss")).alias("type"), F.coalesce("authority", F.lit(3)).alias("authority"),
        F.coalesce("published_at", F.lit("")).alias("published_at"), F.col("tweet_id").alias("x_tweet_id")), "ord").alias("s"))
    sources = per_url.groupBy("cluster").agg(F.array_sort(F.collect_list("s")).alias("sources"))
    symbols = m.select("cluster", "ord", F.posexplode(F.transform(
        F.split(F.coalesce("matched_symbols", F.lit("")), ","), T.strip)).alias("at", "sym")).where("sym != ''")
    symbols = symbols.groupBy("cluster", "sym").agg(F.min(F.struct("ord", "at")).alias("first")).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "sym"))), lambda x: x["sym"]), ",").alias(
            "symbols"))
    centre = centroids(m.select("cluster", "embedding"))
    out = (head.join(sources, "cluster").join(symbols, "cluster", "left").join(centre, "cluster", "left"))
    names = F.transform("sources", lambda s: s["name"])
    event_id = F.coalesce(F.when(F.col("p.event_fingerprint") != "", F.col("p.event_fingerprint")), X.fallback_id(
        F.col("p.title_en"), F.substring(F.coalesce("p.published_at", F.lit("")), 1, 10)))
    replaced = ("matched_symbols", "event_fingerprint", "source", "url", "type", "ord")
    out = out.select(
        "cluster", event_id.alias("event_id"), F.col("p.id").alias("rep_id"),
        *[F.col(f"p.{c}") for c in carried if c not in replaced],
        F.coalesce("symbols", F.lit("")).alias("matched_symbols"), "sources",
        F.size(F.array_distinct(F.transform(names, lambda n: F.split(n, "/")[0]))).alias("source_count"),
        F.array_sort(F.array_distinct(names)).alias("source_names"), "merged_sources_count", "embedding")
    return out.withColumn("is_verified", F.col("source_count") >= 2)


def centroids(rows: DataFrame, key: str = "cluster", vec: str = "embedding") -> DataFrame:
    """Unit mean vector of each key: summed by coordinate, so copies in one key never sit in one task."""
    parts = rows.where(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    arr = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return arr.select(key, unit_vector(F.col("v"), "float").alias(vec))


# --- merge with what is stored ----------------------------------------------------------------------

def match_existing(events: DataFrame, recent: DataFrame, threshold: float = D.COSINE_SAME_EVENT,
                   window_hours: float = D.WINDOW_HOURS, **kw) -> DataFrame:
    """(id, existing_id, via): by fingerprint, else the one nearest stored vector when near enough in time."""
    stored = recent.where(F.coalesce("event_fingerprint", F.lit("")) != "").groupBy(
        F.col("event_fingerprint").alias("fp")).agg(F.max_by("id", "ord").alias("fp_id"))
    near = nearest(vector_rows(events, "id", "embedding"), vector_rows(recent, "id", "embedding", order="ord"),
                   threshold, **kw)
    times = recent.select(F.col("id").alias("_r"), F.col("time_event").alias("_rt"))
    close = near.join(times, F.col("b") == F.col("_r")).join(
        events.select(F.col("id").alias("_e"), F.col("time_event").alias("_et")), F.col("a") == F.col("_e")).where(
        F.abs(T.hours_between(F.col("_et"), F.col("_rt"))) <= window_hours).select(F.col("a").alias("_id"), F.col("b").alias("vec_id"))
    j = events.join(stored, F.col("event_fingerprint") == F.col("fp"), "left").join(
        close, F.col("id") == F.col("_id"), "left")
    return j.select("id", F.coalesce("fp_id", "vec_id").alias("existing_id"),
                    F.when(F.col("fp_id").isNotNull(), "fingerprint").when(F.col("vec_id").isNotNull(), "vector")
                    .alias("via"))


def merge_into_existing(events: DataFrame, recent: DataFrame, matches: DataFrame) -> DataFrame:
    """Events under their stored id, siblings on one stored row folded; texts of the stored row are frozen."""
    m = events.join(matches.where("existing_id IS NOT NULL").select(F.col("id").alias("_i"), "existing_id"),
                    F.col("id") == F.col("_i"), "left").withColumn("key", F.coalesce("existing_id", "id"))
    first = m.groupBy("key").agg(F.min_by(F.struct("title_zh", "title_en", "existing_id"), "ord").alias("f"),
                                 F.sum("merged_sources_count").alias("merged"))
    old = recent.select(F.col("id").alias("_r"), F.col("title_zh").alias("r_zh"), F.col("title_en").alias("r_en"),
                        F.col("source_names").alias("r_names"), F.col("sources").alias("r_sources"),
                        F.col("merged_sources_count").alias("r_merged"), F.col("source_count").alias("r_count"))
    # order of the source lists: first sibling, stored row, then the other siblings
    lists = m.select("key", "ord", F.posexplode("sources").alias("at", "s"), "existing_id")
    place = m.groupBy("key").agg(F.min("ord").alias("first_ord"))
    mine = lists.join(place, "key").select("key", F.when(F.col("ord") == F.col("first_ord"), F.lit(-2)).otherwise(
        F.col("ord")).cast("long").alias("turn"), "at", "s")
    stored = m.select("key", "existing_id").where("existing_id IS NOT NULL").distinct().join(
        old.select("_r", "r_sources"), F.col("existing_id") == F.col("_r")).select(
        "key", F.lit(-1).cast("long").alias("turn"), F.posexplode("r_sources").alias("at", "s"))
    pool = mine.unionByName(stored).withColumn("u", F.when(F.col("s.url") != "", F.col("s.url")).otherwise(
        F.to_json("s")))
    one = pool.groupBy("key", "u").agg(F.min(F.struct("turn", "at")).alias("first"), F.min_by("s", F.struct("turn", "at"))
                                       .alias("s"))
    merged = one.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "u", "s"))),
                                                lambda x: x["s"]).alias("sources"))
    names = m.select("key", F.explode("source_names").alias("n")).unionByName(
        m.select("key", "existing_id").where("existing_id IS NOT NULL").distinct().join(
            old.select("_r", "r_names"), F.col("existing_id") == F.col("_r")).select("key", F.explode("r_names").alias("n")))
    names = names.groupBy("key").agg(F.array_sort(F.collect_set("n")).alias("source_names"))
    j = first.join(merged, "key", "left").join(names, "key", "left").join(old, F.col("f.existing_id") == F.col("_r"), "left")
    distinct = F.size(F.array_distinct(F.transform("source_names", lambda n: F.split(n, "/")[0])))
    hit = F.col("_r").isNotNull()
    return j.select(
        F.col("key").alias("id"), F.when(hit, F.coalesce("r_zh", "f.title_zh")).otherwise(F.col("f.title_zh")).alias("title_zh"),
        F.when(hit, F.coalesce("r_en", "f.title_en")).otherwise(F.col("f.title_en")).alias("title_en"), "sources",
        "source_names", (F.col("merged") + F.coalesce("r_merged", F.lit(0))).alias("merged_sources_count"),
        F.when(hit, F.greatest(distinct, F.col("r_count"))).otherwise(distinct).alias("source_count"), hit.alias("matched"))


# --- historical report and merge ------------------------------------------------------------------------

def duplicate_stars(events: DataFrame, threshold: float = D.COSINE_SAME_EVENT, window_hours: float = D.WINDOW_HOURS,
                    **kw) -> DataFrame:
    """(anchor, member, size): star groups around the first row, larger groups claim rows first.

    ``events`` has id, ord (report order), date, time_event, embedding. Rows of one date and the two
    days after it form the window of that date; anchors come from the date itself.
    """
    clock = F.coalesce("time_event", F.col("date").cast("timestamp_ntz"))
    rows = vector_rows(events.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date"))), "id", "embedding",
                       event_hours(clock), "ord", extra=["_day"]).where("_day IS NOT NULL")
    pairs = similar_pairs(rows.select("id", "ord", "vec", "hours", "grp"), threshold, window_hours=float(window_hours),
                          missing_time="block", **kw)
    info = rows.select("id", "ord", "_day")
    pair = (pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .join(info.select(F.col("id").alias("a"), F.col("ord").alias("a_ord"), F.col("_day").alias("a_day")), "a")
            .join(info.select(F.col("id").alias("b"), F.col("ord").alias("b_ord"), F.col("_day").alias("b_day")), "b")
            .where("b_day - a_day BETWEEN 0 AND 2"))
    pair = cut_lineage(pair)
    anchors = _first_free(pair.where("a_day = b_day").select("a", "a_ord", "b", "b_ord"), info)
    taken = pair.join(anchors, F.col("a") == F.col("anchor"), "left_semi").join(
        anchors.select(F.col("anchor").alias("_other")), F.col("b") == F.col("_other"), "left")
    # an anchor of the same date is nobody's member; other rows go to the first anchor of the date's window
    member = taken.where("_other IS NULL OR a_day < b_day").groupBy("a_day", "b").agg(
        F.min_by("a", "a_ord").alias("anchor"))
    groups = member.select("anchor", F.col("b").alias("member")).unionByName(
        member.select("anchor", F.col("anchor").alias("member")).distinct())
    return _claim_by_size(cut_lineage(groups), info)


def _first_free(pair: DataFrame, info: DataFrame) -> DataFrame:
    """Rows that no earlier anchor touches, walking each date by order: the anchors of the stars."""
    waiting = cut_lineage(info.select(F.col("id").alias("v"), F.col("ord").alias("o")))
    edges = cut_lineage(pair.where("b_ord < a_ord").select("a", "b"))
    anchors = None
    while not waiting.isEmpty():
        blocked = edges.select("a").distinct()
        free = cut_lineage(waiting.join(blocked, F.col("v") == F.col("a"), "left_anti"))
        anchors = free if anchors is None else cut_lineage(anchors.unionByName(free))
        touched = edges.join(free.select(F.col("v").alias("b")), "b", "left_semi").select("a").distinct()
        gone = free.select("v").unionByName(touched.withColumnRenamed("a", "v")).distinct()
        waiting = cut_lineage(waiting.join(gone, "v", "left_anti"))
        edges = cut_lineage(edges.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(
            gone.select(F.col("v").alias("b")), "b", "left_anti"))
    return anchors.select(F.col("v").alias("anchor"))


def _claim_by_size(groups: DataFrame, info: DataFrame) -> DataFrame:
    """Larger groups take their rows first; a group left with one row takes none."""
    sized = groups.groupBy("anchor").agg(F.count("*").alias("size")).join(
        info.select(F.col("id").alias("anchor"), "ord", "_day"), "anchor")
    # rank: size falling, then date and report order, as a sortable struct
    waiting = cut_lineage(groups.join(sized.where("size > 1"), "anchor").select(
        "anchor", "member", F.struct(-F.col("size"), F.col("_day"), F.col("ord")).alias("rank")))
    final = None
    while not waiting.isEmpty():
        front = waiting.groupBy("member").agg(F.min("rank").alias("best"))
        turn = waiting.join(front, "member").groupBy("anchor").agg(
            F.bool_and(F.col("rank") == F.col("best")).alias("ready")).where("ready").select("anchor")
        ready = cut_lineage(waiting.join(turn, "anchor", "left_semi"))
        whole = ready.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        won = ready.join(whole, "anchor", "left_semi").select("anchor", "member")
        final = cut_lineage(won if final is None else final.unionByName(won))
        waiting = cut_lineage(waiting.join(turn, "anchor", "left_anti").join(won.select("member"), "member", "left_anti"))
    if final is None:
        final = groups.limit(0)
    return final.join(final.groupBy("anchor").agg(F.count("*").alias("size")), "anchor")


def merge_history(events: DataFrame, stars: DataFrame, baseline: DataFrame) -> DataFrame:
    """Table after the historical merge: keepers updated and re-scored with all seven factors, others gone."""
    m = events.join(stars.select(F.col("member").alias("_m"), "anchor"), F.col("id") == F.col("_m"))
    worth = F.struct(F.coalesce("score_authority", F.lit(0.0)), F.coalesce("source_count", F.lit(1)),
                     F.octet_length(F.coalesce("description_short_zh", F.lit(""))), F.coalesce("importance_score", F.lit(0.0)),
                     -F.col("ord"))
    g = m.groupBy("anchor").agg(F.max_by("id", worth).alias("keeper"), F.sum("merged_sources_count").alias("merged"),
                                F.max("social_interactions").alias("social"))
    names = m.select("anchor", F.explode("source_names").alias("n")).groupBy("anchor").agg(
        F.array_sort(F.collect_set("n")).alias("names"))
    g = g.join(names, "anchor", "left")
    gone = stars.select("member", "anchor").join(g.select("anchor", "keeper"), "anchor").where(
        "member != keeper").select(F.col("member").alias("id"))
    kept = events.join(gone, "id", "left_anti").join(g.drop("anchor"), F.col("id") == F.col("keeper"), "left").crossJoin(
        F.broadcast(baseline))
    hit = F.col("keeper").isNotNull()
    distinct = F.size(F.array_distinct(F.transform("names", lambda n: F.split(n, "/")[0])))
    count = F.when(hit, F.greatest(distinct, F.col("source_count"))).otherwise(F.col("source_count"))
    hot = S.hotness(F.col("social"), count, F.col("baseline"))
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = S.weighted_total({"M": part("score_market_impact"), "B": S.breadth(F.col("breadth_level")),
                              "T": part("score_timeliness"), "I": part("score_punch"), "H": hot,
                              "A": part("score_authority"), "Q": part("score_quality")})
    return kept.select(
        "id", F.when(hit, F.col("names")).otherwise(F.col("source_names")).alias("source_names"),
        count.alias("source_count"), F.when(hit, F.col("merged")).otherwise(F.col("merged_sources_count")).alias(
            "merged_sources_count"),
        F.when(hit, F.col("social")).otherwise(F.col("social_interactions")).alias("social_interactions"),
        F.when(hit, F.round(hot, 4)).otherwise(F.col("score_hotness")).alias("score_hotness"),
        F.when(hit, F.round(total, 4)).otherwise(F.col("importance_score")).alias("importance_score"))


# --- comparisons of lists ---------------------------------------------------------------------------------

def similarity_groups(rows: DataFrame, threshold: float = D.COSINE_SAME_EVENT, **kw) -> DataFrame:
    """(id, grp_no, size, mean_similarity): groups of similar rows, numbered by their first member.

    The mean is over the other members of the group. It comes from the group's vector sum, so the
    pairs inside a group are not listed: sum of cosines to the others = v . S - 1.
    """
    links = similar_links(rows, threshold, **kw)
    c = cluster_of(rows.select("id"), links)
    unit = rows.join(c, "id").select("id", "cluster", unit_vector(F.col("vec")).alias("u"))
    sums = unit.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"])
                                       .alias("total"))
    size = unit.groupBy("cluster").agg(F.count("*").alias("size"))
    numbered = size.withColumn("grp_no", F.col("cluster"))
    dot = F.aggregate(F.zip_with("u", "total", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return unit.join(sums, "cluster").join(numbered, "cluster").select(
        "id", F.col("cluster").alias("first_member"), "size",
        F.when(F.col("size") == 1, 1.0).otherwise((dot - 1.0) / (F.col("size") - 1)).alias("mean_similarity"))


def list_overlap(a: DataFrame, b: DataFrame, threshold: float = D.COSINE_SAME_EVENT, **kw) -> tuple[DataFrame, DataFrame]:
    """(matched pairs, one row of overlap rates) of two lists matched one to one by falling similarity."""
    matched = mutual_best(cross_pairs(a, b, threshold, **kw))
    n = matched.agg(F.count("*").alias("overlap"))
    sizes = a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b"))).crossJoin(n)
    rates = sizes.select("n_a", "n_b", "overlap", F.round(F.try_divide("overlap", "n_a"), 4).alias("rate_a"),
                         F.round(F.try_divide("overlap", "n_b"), 4).alias("rate_b"),
                         F.round(F.try_divide(F.col("overlap"), F.col("n_a") + F.col("n_b") - F.col("overlap")), 4)
                         .alias("jaccard"))
    return matched, rates


# --- cache ------------------------------------------------------------------------------------------------

def cache_lookup(hashes: DataFrame, cache: DataFrame, schema: str, required: list[str],
                 prompt_hash: str | None = None) -> DataFrame:
    """Newest cached row of each hash (of the prompt, when asked); rows without a required field are misses."""
    rows = cache if prompt_hash is None else cache.where(F.col("prompt_hash") == prompt_hash)
    newest = rows.groupBy(F.col("url_hash").alias("_h")).agg(
        F.max_by(F.struct("enriched", "created_at"), "created_at").alias("r"))
    keys = F.json_object_keys("r.enriched")
    whole = F.coalesce(F.forall(F.array(*[F.lit(k) for k in required]), lambda k: F.array_contains(keys, k)), F.lit(False))
    j = hashes.join(newest, F.col("url_hash") == F.col("_h"), "left")
    return j.withColumn("hit", F.col("_h").isNotNull() & whole).withColumn(
        "item", F.when(F.col("hit"), F.from_json("r.enriched", schema))).drop("_h", "r")


def cache_write_back(cache: DataFrame, entries: DataFrame, used: DataFrame, now) -> DataFrame:
    """Cache after a round: entries replace by hash and reset both times, used hits are marked consumed."""
    fresh = entries.select("url_hash", "prompt_hash", "enriched", T.wall(now).alias("created_at"),
                           F.lit(None).cast("timestamp_ntz").alias("consumed_at"))
    left = cache.join(fresh.select("url_hash"), "url_hash", "left_anti")
    marked = left.join(used.select("url_hash").distinct().withColumn("_u", F.lit(True)), "url_hash", "left")
    marked = marked.withColumn("consumed_at", F.when(F.col("_u"), T.wall(now)).otherwise(F.col("consumed_at"))).drop("_u")
    return marked.select(*fresh.columns).unionByName(fresh)


def pending_work(staged: DataFrame, cache: DataFrame, prompt_hash: str, now, limit: int = 40,
                 max_age_days: int = 30, cache_days: int = 7) -> DataFrame:
    """Open staged rows no live cache row of the prompt covers, in queue order."""
    live = cache.where((F.col("prompt_hash") == prompt_hash)
                       & (F.col("created_at") >= F.timestamp_add("DAY", F.lit(-cache_days), T.wall(now)))).select("url_hash")
    fresh = F.col("fetched_at") >= F.timestamp_add("DAY", F.lit(-max_age_days), T.wall(now))
    return staged.where(F.col("consumed_at").isNull() & fresh).join(live, "url_hash", "left_anti").orderBy(
        "priority", F.col("fetched_at").desc(), "id").limit(limit)


def validate_results(results: DataFrame, required: list[str], size: int = 256) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): 64-character hash and all required keys; a vector of another size becomes null."""
    keys = F.json_object_keys("enriched")
    whole = F.coalesce(F.forall(F.array(*[F.lit(k) for k in required]), lambda k: F.array_contains(keys, k)), F.lit(False))
    good = (F.length(F.coalesce("url_hash", F.lit(""))) == 64) & whole
    checked = results.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")))
    return checked.where(good), results.where(~good)


def mark_consumed(staged: DataFrame, taken: DataFrame, deferred: DataFrame, now) -> DataFrame:
    """Queue after a round: taken rows are consumed but for those whose url was deferred, which count one more."""
    t = taken.select(F.col("id").alias("_t")).distinct()
    d = deferred.groupBy(F.col("url").alias("_d")).agg(F.first("reason").alias("_why"))
    j = staged.join(t, F.col("id") == F.col("_t"), "left").join(d, F.col("url") == F.col("_d"), "left")
    held = F.col("_t").isNotNull() & F.col("_d").isNotNull()
    done = F.col("_t").isNotNull() & F.col("_d").isNull()
    return (j.withColumn("consumed_at", F.when(done, T.wall(now)).otherwise(F.col("consumed_at")))
            .withColumn("deferred_count", F.col("deferred_count") + F.when(held, 1).otherwise(0))
            .withColumn("defer_reason", F.when(held, F.col("_why")).otherwise(F.col("defer_reason")))
            .withColumn("last_deferred_at", F.when(held, T.wall(now))).drop("_t", "_d", "_why"))


def link_posts(posts: DataFrame, events: DataFrame) -> DataFrame:
    """Set the event of each post an event names as a source; the last event wins."""
    links = events.select("id", "ord", F.explode("sources.x_tweet_id").alias("_t")).where("_t IS NOT NULL").groupBy("_t").agg(
        F.max_by("id", "ord").alias("news_event_id"))
    return posts.join(links, F.col("tweet_id") == F.col("_t"), "left").drop("_t")
