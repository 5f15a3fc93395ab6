"""Exact vector similarity joins in bounded tiles.

All pairs over a large window are never put in one task. Rows are cut into tiles of a bounded
size: first by group and time bucket, then by the nearest of a few pivot vectors, then by a hash
salt, so a bucket that holds a third of all rows becomes many tiles. Two tiles meet only when
their times can be within the window and, by the triangle inequality on angles, some pair of
their vectors can reach the threshold. One task multiplies one pair of tiles and returns what
the caller needs from it (links, the best partner of each row, ...), not every pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TILE_ROWS = 8192
PIVOTS = 64
ROWS_PER_TASK = 65536    # rows of both sides that the tile pairs of one task hold together
BLOCK_ROWS = 64          # left rows of a tile pair that are multiplied at a time
EXACT_ROWS = 65536       # pairs whose exact cosine is worked out at a time
HELD_MATCHES = 500_000   # matches of a tile pair that are handed on together
_SLACK = 1e-4


@dataclass
class Tile:
    """One tile inside a task: ids, order numbers, unit vectors in both precisions, hours (NaN when missing)."""

    id: np.ndarray
    ord: np.ndarray
    vec: np.ndarray
    rough: np.ndarray
    hours: np.ndarray
    extra: pd.DataFrame


@dataclass
class Match:
    """Where two tiles match: row positions on both sides and their cosines."""

    left: np.ndarray
    right: np.ndarray
    cosine: np.ndarray


def _units(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _tile(pdf: pd.DataFrame) -> Tile:
    unit = _units(pdf["vec"])
    return Tile(pdf["id"].to_numpy(), pdf["ord"].to_numpy(), unit, unit.astype(np.float32),
                pdf["hours"].to_numpy(dtype=np.float64), pdf)


def _near(gap: np.ndarray, window: float, missing: str, past_only: bool) -> np.ndarray:
    near = (gap > 0) & (gap <= window) if past_only else np.abs(gap) <= window
    return np.where(np.isnan(gap), missing == "pass", near)


def _match(a: Tile, b: Tile, rows: slice, threshold: float, strict: bool, window: float | None, missing: str,
           past_only: bool, best: bool) -> Match:
    """Matches of some rows of the left tile: a rough product first, then the time, then the exact cosine of what is left.

    With ``best`` only the partners of a row that can be its nearest one are looked at.
    """
    rough = a.rough[rows] @ b.rough.T
    floor = threshold - _SLACK
    if best:
        if window is not None:
            rough[~_near(a.hours[rows, None] - b.hours, window, missing, past_only)] = -np.inf
        floor = np.maximum(np.fmax.reduce(rough, axis=1, keepdims=True) - 2 * _SLACK, floor)
    i, j = np.divmod(np.flatnonzero(rough >= floor), len(b.id))
    i = i + rows.start
    if window is not None:
        near = _near(a.hours[i] - b.hours[j], window, missing, past_only)
        i, j = i[near], j[near]
    cos = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", a.vec[i[s:s + EXACT_ROWS]], b.vec[j[s:s + EXACT_ROWS]])
                                          for s in range(0, len(i), EXACT_ROWS)])
    ok = cos > threshold if strict else cos >= threshold
    return Match(i[ok], j[ok], cos[ok])


def vector_rows(df: DataFrame, id: str, vec: str, hours=None, order: str | None = None,
                group=None, extra: list[str] | None = None) -> DataFrame:
    """Bring a table to the columns the joins read: id, ord, vec, hours, grp and carried extras.

    Rows without a vector, or with an all-zero one, take no part in any similarity rule.
    """
    cols = [F.col(id).alias("id"), F.col(order or id).cast("long").alias("ord"),
            F.col(vec).cast("array<float>").alias("vec"),
            (hours if hours is not None else F.lit(None)).cast("double").alias("hours"),
            (group if group is not None else F.lit("")).cast("string").alias("grp")]
    cols += [F.col(c) for c in (extra or [])]
    return df.select(*cols).where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)
                                  & F.col("grp").isNotNull())


def _pick_pivots(rows: DataFrame, k: int) -> np.ndarray:
    """``k`` vectors chosen by hash: a bounded collect, whatever the table size."""
    picked = rows.orderBy(F.xxhash64("id")).select("vec").limit(k).collect()
    return _units([r["vec"] for r in picked]) if picked else np.zeros((0, 0))


def _with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def assign(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            cos = np.clip(_units(pdf["vec"]) @ pivots.T, -1.0, 1.0)
            cell = cos.argmax(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), angle=np.arccos(cos[np.arange(len(pdf)), cell]))

    return rows.mapInPandas(assign, f"{fields}, cell int, angle double")


def _chain(pivots: np.ndarray) -> list[int]:
    """The place of each pivot on a walk that goes on to the nearest pivot left."""
    cos = pivots @ pivots.T
    place, at, left = [0] * len(pivots), 0, set(range(1, len(pivots)))
    for step in range(1, len(pivots)):
        at = max(left, key=lambda p: cos[at, p])
        left.remove(at)
        place[at] = step
    return place


def _cut_into_tiles(rows: DataFrame, window: float | None, tile_rows: int, pivots: np.ndarray) -> DataFrame:
    """Add the time bucket and the tile name.

    A bucket that fits into one tile stays whole: its cell is -1 and its angle is the widest one.
    Of other buckets, small cells that are neighbours share a tile, so that few tiles meet where
    angles exclude little; a cell that is larger than a tile is dealt over several by a salt.
    """
    bucket = F.floor(F.col("hours") / F.lit(float(window))) if window is not None else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("long"))
    cells = rows.groupBy(*[F.col(c).alias(f"s_{c}") for c in ("grp", "bucket", "cell")]).agg(F.count("*").alias("n"))
    place = F.element_at(F.array(*[F.lit(p) for p in _chain(pivots)]), F.col("s_cell") + 1)
    same_bucket = Window.partitionBy("s_grp", "s_bucket")
    before = F.sum("n").over(same_bucket.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sizes = cells.select("s_grp", "s_bucket", "s_cell", (F.sum("n").over(same_bucket) <= tile_rows).alias("small"),
                         F.ceil(F.col("n") / F.lit(tile_rows)).alias("salts"), F.floor(before / F.lit(tile_rows)).alias("pack"))
    keys = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("grp", "bucket", "cell")]
    small = F.col("small")
    part = F.when(small, "").when(F.col("salts") > 1, F.concat_ws("|", F.lit("cell"), "cell", F.pmod(F.xxhash64("id"), F.col("salts")))
                                  ).otherwise(F.concat_ws("|", F.lit("pack"), "pack"))
    return (rows.join(sizes, keys[0] & keys[1] & keys[2])
            .withColumn("part", part)
            .withColumn("angle", F.when(small, F.lit(math.pi)).otherwise(F.col("angle")))
            .withColumn("cell", F.when(small, F.lit(-1)).otherwise(F.col("cell")))
            .select(*rows.columns, F.concat_ws("|", "grp", F.coalesce(F.col("bucket").cast("string"), F.lit("-")), "part")
                    .alias("tile")))


def _tile_pairs(left: DataFrame, right: DataFrame, pivots: np.ndarray, threshold: float,
                window: float | None, missing: str, symmetric: bool) -> DataFrame:
    """Pairs of tiles that can hold a match."""
    def summary(rows, side):
        return rows.groupBy("tile", "grp", "bucket", "cell").agg(
            F.max("angle").alias("radius"), F.min("hours").alias("lo"), F.max("hours").alias("hi")
        ).select(*[F.col(c).alias(f"{side}_{c}") for c in ("tile", "grp", "bucket", "cell", "radius", "lo", "hi")])

    a, b = summary(left, "a"), summary(right, "b")
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    k = len(pivots)
    spark = left.sparkSession
    angles = spark.createDataFrame(
        [(i, j, float(between[i, j]) if min(i, j) >= 0 else 0.0) for i in range(-1, k) for j in range(-1, k)],
        "a_cell int, b_cell int, apart double")
    timed = a.where("a_bucket IS NOT NULL").withColumn("b_bucket", F.explode(F.array(
        *[F.col("a_bucket") + F.lit(s) for s in (-1, 0, 1)])))
    same_grp = F.col("a_grp") == F.col("b_grp")
    b_timed = b.where("b_bucket IS NOT NULL")
    met = timed.join(b_timed.withColumnRenamed("b_bucket", "bb"), same_grp & (F.col("b_bucket") == F.col("bb")))
    if window is not None:
        met = met.where((F.col("b_lo") - F.col("a_hi") <= window) & (F.col("a_lo") - F.col("b_hi") <= window))
    met = met.select("a_tile", "b_tile", "a_cell", "b_cell", "a_radius", "b_radius")
    if window is not None and missing == "pass":
        cols = ("a_tile", "b_tile", "a_cell", "b_cell", "a_radius", "b_radius")
        met = met.unionByName(a.where("a_bucket IS NULL").join(b, same_grp).select(*cols))
        met = met.unionByName(a.where("a_bucket IS NOT NULL").join(b.where("b_bucket IS NULL"), same_grp).select(*cols))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-3
    met = met.join(F.broadcast(angles), ["a_cell", "b_cell"]).where(
        F.col("apart") - F.col("a_radius") - F.col("b_radius") <= reach)
    if symmetric:
        met = met.where(F.col("a_tile") <= F.col("b_tile"))
    return met.select("a_tile", "b_tile").distinct()


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so a table can meet itself in one cogroup."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def tile_join(left: DataFrame, right: DataFrame | None, reduce: Callable[[Tile, Tile, Match], pd.DataFrame],
              schema: str, threshold: float, *, window_hours: float | None = None, missing_time: str = "pass",
              strict: bool = False, past_only: bool = False, best: bool = False, tile_rows: int = TILE_ROWS,
              pivots: int = PIVOTS) -> DataFrame:
    """Join vector rows on cosine and time; ``right=None`` joins the table with itself.

    ``reduce`` gets two tiles and their matches, all of a left row at once and blocks of left rows
    together up to a fixed number of matches. In a self join every unordered pair is met once,
    and the lower order number is on the left. ``missing_time`` says whether a pair with an
    unknown time passes ("pass") or not ("block"). ``best`` keeps of a left row's matches in a tile
    those that can be the nearest.
    """
    symmetric = right is None
    opts = (threshold, strict, window_hours, missing_time, past_only, best)

    def meet(pa: pd.DataFrame, pb: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=names)
        if len(pa) == 0 or len(pb) == 0:
            return empty
        a, b = _tile(pa), _tile(pb)
        parts, held = [], []
        for start in range(0, len(a.id), BLOCK_ROWS):
            m = _match(a, b, slice(start, start + BLOCK_ROWS), *opts)
            if symmetric:
                m = _once(a, b, m, pa["same"].iloc[0])
            if len(m.left):
                held.append(m)
            if held and (start + BLOCK_ROWS >= len(a.id) or sum(len(x.left) for x in held) >= HELD_MATCHES):
                together = Match(*[np.concatenate([getattr(x, side) for x in held]) for side in ("left", "right", "cosine")])
                parts.append(reduce(a, b, together)[names])
                held = []
        return pd.concat(parts) if parts else empty

    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    sides = [left] if symmetric else [left, right]
    centre = _pick_pivots(left, pivots)
    if not len(centre):
        return left.sparkSession.createDataFrame([], schema)
    cut = [cut_lineage(_cut_into_tiles(_with_cells(side, centre), window_hours, tile_rows, centre)) for side in sides]
    tiles_a = cut[0]
    tiles_b = fresh(cut[-1])
    pairs = cut_lineage(_tile_pairs(tiles_a, tiles_b, centre, threshold, window_hours, missing_time, symmetric))
    pair = F.concat_ws("#", "a_tile", "b_tile").alias("pair")
    # many small tile pairs share a task, so that a task holds a bounded number of rows
    load = pairs.select(F.explode(F.array(F.concat(F.lit("a"), "a_tile"), F.concat(F.lit("b"), "b_tile"))).alias("t")).join(
        _union_sizes(tiles_a, tiles_b), "t").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_pairs = pairs.count()
    tasks = max(1, min(n_pairs, max(left.sparkSession.sparkContext.defaultParallelism * 2, load // ROWS_PER_TASK)))
    a = tiles_a.join(pairs, tiles_a["tile"] == pairs["a_tile"]).select(
        *left.columns, pair, (F.col("a_tile") == F.col("b_tile")).alias("same")).repartition(tasks, "pair")
    b = tiles_b.join(pairs, tiles_b["tile"] == pairs["b_tile"]).select(*(left if symmetric else right).columns, pair).repartition(tasks, "pair")
    return a.groupBy("pair").cogroup(b.groupBy("pair")).applyInPandas(meet, schema)


def _union_sizes(tiles_a: DataFrame, tiles_b: DataFrame) -> DataFrame:
    """Rows of each tile of both sides."""
    sized = [tiles.groupBy(F.concat(F.lit(side), "tile").alias("t")).agg(F.count("*").alias("n")) for side, tiles in
             (("a", tiles_a), ("b", tiles_b))]
    return sized[0].unionByName(sized[1])


def _once(a: Tile, b: Tile, m: Match, same: bool) -> Match:
    """In a self join keep each unordered pair once."""
    if same:
        ok = a.ord[m.left] < b.ord[m.right]
        return Match(m.left[ok], m.right[ok], m.cosine[ok])
    return m


# --- what tasks return -----------------------------------------------------------------------

def links(a: Tile, b: Tile, m: Match) -> pd.DataFrame:
    """A spanning forest of the matches between two tiles: at most one link for each row."""
    ids = np.concatenate([a.id, b.id])
    _, node = np.unique(ids, return_inverse=True)
    left, right = node[m.left], node[len(a.id) + m.right]
    label = np.arange(node.max() + 1)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    names = np.empty(node.max() + 1, dtype=ids.dtype)
    names[node] = ids
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})


def all_pairs(a: Tile, b: Tile, m: Match) -> pd.DataFrame:
    """Every match, lower order number first; for uses whose answer is the pairs themselves."""
    swap = a.ord[m.left] > b.ord[m.right]
    x, y = a.id[m.left], b.id[m.right]
    return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "cosine": m.cosine})


def directed_pairs(a: Tile, b: Tile, m: Match) -> pd.DataFrame:
    return pd.DataFrame({"a": a.id[m.left], "b": b.id[m.right], "cosine": m.cosine})


def best_right(a: Tile, b: Tile, m: Match) -> pd.DataFrame:
    """The best partner of each left row in this tile: highest cosine, then lowest order."""
    hit = pd.DataFrame({"a": a.id[m.left], "b": b.id[m.right], "b_ord": b.ord[m.right], "cosine": m.cosine})
    hit = hit.sort_values(["cosine", "b_ord"], ascending=[False, True], kind="stable")
    return hit.drop_duplicates("a")


def link_degree(a: Tile, b: Tile, m: Match) -> pd.DataFrame:
    """Number and sum of cosines of each row's matches, from both sides."""
    both = pd.DataFrame({"id": np.concatenate([a.id[m.left], b.id[m.right]]),
                         "cosine": np.concatenate([m.cosine, m.cosine])})
    out = both.groupby("id", sort=False)["cosine"].agg(["size", "sum"]).reset_index()
    return out.rename(columns={"size": "n", "sum": "total"})


# --- joins by name -----------------------------------------------------------------------------

def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def similar_pairs(rows: DataFrame, threshold: float, **kw) -> DataFrame:
    return tile_join(rows, None, all_pairs, f"a {_id_type(rows)}, b {_id_type(rows)}, cosine double", threshold, **kw)


def cross_pairs(left: DataFrame, right: DataFrame, threshold: float, **kw) -> DataFrame:
    return tile_join(left, right, directed_pairs,
                     f"a {_id_type(left)}, b {_id_type(right)}, cosine double", threshold, **kw)


def nearest(left: DataFrame, right: DataFrame, threshold: float = -1.0, **kw) -> DataFrame:
    """The nearest right row of each left row, the lower order number on a tie."""
    per_tile = tile_join(left, right, best_right,
                         f"a {_id_type(left)}, b {_id_type(right)}, b_ord long, cosine double", threshold, best=True, **kw)
    best = per_tile.groupBy("a").agg(F.max_by(F.struct("b", "cosine"), F.struct("cosine", -F.col("b_ord"))).alias("m"))
    return best.select("a", "m.b", "m.cosine")


def similar_links(rows: DataFrame, threshold: float, window_hours: float | None = None,
                  missing_time: str = "pass", **kw) -> DataFrame:
    """Links whose closure equals the closure of all similar pairs.

    Exact copies of a vector are folded first: inside one time bucket the earliest and the latest
    copy stand for all of them, because any row near a copy in between is near one of the two.
    """
    bucket = F.floor(F.col("hours") / F.lit(float(window_hours))) if window_hours else F.lit(0).cast("long")
    keyed = rows.withColumn("bucket", F.when(F.col("hours").isNotNull(), bucket) if window_hours else bucket)
    if missing_time == "block":
        keyed = keyed.where("hours IS NOT NULL")
    folded = keyed.groupBy("grp", "vec", "bucket").agg(
        F.min_by(F.struct("id", "ord", "hours"), F.struct("hours", "ord")).alias("first"),
        F.max_by(F.struct("id", "ord", "hours"), F.struct("hours", "ord")).alias("last"),
        F.count("*").alias("n"))
    ends = folded.select("grp", "vec", F.explode(F.array_distinct(F.array("first", "last"))).alias("r"))
    ends = ends.select("r.id", "r.ord", "vec", "r.hours", "grp")
    id_type = _id_type(rows)
    found = tile_join(ends, None, links, f"a {id_type}, b {id_type}", threshold, window_hours=window_hours,
                      missing_time=missing_time, **kw)
    crowded = folded.where("n > 1").select(F.col("grp").alias("s_grp"), F.col("vec").alias("s_vec"),
                                           F.col("bucket").alias("s_bucket"), F.col("first.id").alias("b"))
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("grp", "vec", "bucket")]
    copies = keyed.join(crowded, same[0] & same[1] & same[2]).where(F.col("id") != F.col("b")).select(
        F.col("id").alias("a"), "b")
    return found.unionByName(copies)
