"""Graph and ordered-selection loops built from joins and grouped minima.

No loop collects a group: each round is a fixed number of aggregations and joins, and its result
is written to the shared folder before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, settled

HOT_ROWS = 64    # rows of a group near which turns are taken one at a time


def key_links(df: DataFrame, id: str, key) -> DataFrame:
    """Link every row to the first row that has the same non-blank key: one link a row, no pairs."""
    keyed = df.select(F.col(id).alias("a"), key.alias("k")).where(F.col("k").isNotNull() & (F.col("k") != ""))
    first = keyed.groupBy("k").agg(F.min("a").alias("b"))
    return keyed.join(first, "k").where("a != b").select("a", "b")


@settled
def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node on an edge; the root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges are stars: a node that has an edge to a smaller one has no
    other edge. Both steps would leave stars as they are, so no round is run to see them stand still.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a != b").distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.unionByName(low2.select("a", F.col("m").alias("b"))).distinct())
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("below")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("below")))
        if ends.groupBy("node").agg(F.sum("below").alias("up"), F.min("below").alias("low")).where("up > 1 OR up > 0 AND low = 0").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def cluster_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) for every row; rows without an edge are clusters of their own."""
    found = connected_components(edges)
    return ids.select("id").join(found, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("root", "id").alias("cluster"))


@settled
def ordered_caps(rows: DataFrame, order: str, caps: dict[str, int]) -> DataFrame:
    """Orders of the rows an ordered pass keeps.

    The pass walks the rows by ``order`` and keeps a row when, for each key column, fewer than
    ``caps[column]`` kept rows share its key; a dropped row claims nothing. Null keys never block.
    Each round decides every row whose place among the undecided rows of all its keys is within the
    room left; the first undecided row always is, so the loop ends with the exact answer.
    """
    keys = list(caps)
    left = cut_lineage(rows.select(F.col(order).alias("o"), *keys))
    kept: list[DataFrame] = []
    while not left.isEmpty():
        fits = left
        used = {}
        for key, cap in caps.items():
            if kept:
                used[key] = _union(kept).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
            place = F.row_number().over(Window.partitionBy(key).orderBy("o"))
            front = (left.where(F.col(key).isNotNull()).select("o", key).withColumn("place", place)
                     .where(F.col("place") <= cap))
            if kept:
                front = front.join(used[key], key, "left").where(
                    F.col("place") <= F.lit(cap) - F.coalesce("n", F.lit(0)))
            free = left.where(F.col(key).isNull()).select("o").unionByName(front.select("o"))
            fits = fits.join(free, "o", "left_semi")
        won = cut_lineage(fits)
        kept.append(won)
        rest = left.join(won, "o", "left_anti")
        for key, cap in caps.items():
            full = _union(kept).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(
                F.col("n") >= cap).select(key)
            rest = rest.join(full, key, "left_anti")
        left = cut_lineage(rest.select("o", *keys))
    return (_union(kept) if kept else left).select(F.col("o").alias(order))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


@settled
def authority_pass(rows: DataFrame, group_edges: DataFrame) -> DataFrame:
    """Orders of the rows kept by the ordered duplicate pass.

    ``rows`` has (o, g, auth): order, group of equal texts, authority. ``group_edges`` has (a, b):
    groups that are similar; rows of one group are always similar. The pass takes rows by order. A
    row still in play drops its later duplicates one by one until it meets one of higher authority;
    then it drops out itself and stops. In each round a row takes its turn when no undecided row
    near it comes earlier and its stop is certain: no undecided row near the stop comes earlier. A
    dropped row stays as a possible stop of undecided rows before the one that dropped it. Near a
    group of more than ``HOT_ROWS`` rows one turn is taken in a round. Every step works on a few
    figures for each group, never on the rows of a group together.
    """
    both = cut_lineage(group_edges.select("a", "b").unionByName(
        group_edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rows = cut_lineage(rows.select("o", "g", "auth"))
    # a group of one row without a similar group keeps its row: no turn needed
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    busy = cut_lineage(sizes.where("n > 1").select("g").unionByName(both.select(F.col("a").alias("g"))).distinct())
    kept = [rows.join(busy, "g", "left_anti").select("o")]
    waiting = cut_lineage(rows.join(busy, "g", "left_semi").withColumn("d", F.lit(None).cast("long")))
    hot = sizes.select(F.col("g").alias("b"), (F.col("n") > HOT_ROWS).alias("hot"))
    near = cut_lineage(both.unionByName(busy.select(F.col("g").alias("a"), F.col("g").alias("b"))).join(hot, "b").select("a", "b", "hot"))
    held = waiting.count()
    while not waiting.where("d IS NULL").isEmpty():
        # links of groups that wait for nothing are read no more
        if 2 * (now := waiting.count()) <= held:
            held, still = now, waiting.select("g").distinct()
            near = cut_lineage(near.join(still.select(F.col("g").alias("a")), "a", "left_semi").join(still.select(F.col("g").alias("b")), "b", "left_semi"))
        open_rows = waiting.where("d IS NULL")
        first = open_rows.groupBy(F.col("g").alias("b")).agg(F.min("o").alias("o"))
        low = cut_lineage(near.join(first, "b").groupBy(F.col("a").alias("lg")).agg(F.min("o").alias("low")))
        turn = open_rows.join(low, F.col("g") == F.col("lg")).where("o = low").select(
            F.col("o").alias("by"), F.col("g").alias("a"), F.col("auth").alias("mine"))
        levels = waiting.groupBy(F.col("g").alias("b"), "auth", "d").agg(F.min("o").alias("level_o"))
        # the first row of higher authority among the neighbours ends the turn and the row itself
        stops = (F.col("auth") > F.col("mine")) & (F.col("d").isNull() | (F.col("d") > F.col("by")))
        met = turn.join(near, "a").join(low, F.col("b") == F.col("lg")).join(levels, "b", "left")
        ended = met.groupBy("by", "a").agg(
            F.min(F.when(stops, F.struct("level_o", F.col("low").alias("low")))).alias("s"), F.max(F.col("hot") & (F.col("low") < F.col("by"))).alias("held"))
        ended = cut_lineage(ended.where("NOT held AND (s IS NULL OR s.low = by)").select("by", "a", F.col("s.level_o").alias("stop")))
        kept.append(ended.where("stop IS NULL").select(F.col("by").alias("o")))
        reach = ended.join(near, "a").select(F.col("b").alias("g"), "by", F.coalesce("stop", F.lit(2 ** 62)).alias("upto"))
        hit = waiting.join(reach, "g").where("by < o AND o < upto").groupBy("o").agg(F.min("by").alias("by"))
        # a dropped row that no undecided row can meet any more goes
        left = waiting.join(ended.select(F.col("by").alias("o")), "o", "left_anti").join(hit, "o", "left").join(
            low, F.col("g") == F.col("lg"), "left").select("o", "g", "auth", F.least("d", "by").alias("d"), "low")
        waiting = cut_lineage(left.where("d IS NULL OR d > low").drop("low"))
    return _union(kept)


@settled
def mutual_best(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matching: pairs by falling similarity, each side used once.

    A pair that is the best of both its ends is next in greedy order for both, so every round takes
    all such pairs at once. Ties go to the lower ``a`` and then the lower ``b``.
    """
    left = cut_lineage(pairs.select("a", "b", "cosine"))
    taken = None
    while not left.isEmpty():
        rank = F.struct(F.col("cosine"), -F.col("a"), -F.col("b"))
        best_a = left.groupBy("a").agg(F.max_by("b", rank).alias("b"))
        best_b = left.groupBy("b").agg(F.max_by("a", rank).alias("a"))
        won = cut_lineage(left.join(best_a, ["a", "b"], "left_semi").join(best_b, ["a", "b"], "left_semi"))
        taken = won if taken is None else cut_lineage(taken.unionByName(won))
        left = cut_lineage(left.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"))
    return pairs.select("a", "b", "cosine").limit(0) if taken is None else taken
