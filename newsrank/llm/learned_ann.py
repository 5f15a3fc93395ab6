"""Nearest neighbours by largest inner product over learned partitions.

1. Equal vectors are one class with its smallest ids (``k`` + 1 are all that any query can need).
2. On a sample of at most ``sample_rows`` classes (smallest hashes) a neighbour graph is cut into balanced parts:
   balanced rounds of spherical means, then moves along graph edges under the same size limit.
3. A softmax classifier learns the parts of each sample vector's graph neighbours. It places every class in its most
   probable part and sends a query to its ``probes`` most probable parts. ``probes`` is the smallest number that finds
   ``target`` of the true neighbours on the sample.
4. Part by part, in blocks of bounded size, queries meet candidates and are reranked on the original vectors. A query's
   (k+1)-th best score within the sample rows of its parts is a true lower bound, so only better rows leave a block.

The number of parts grows with the number of classes. Only the sample, the classifier and one-row figures reach
the driver; the sample travels to the tasks (at most ``sample_rows`` vectors).

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do those of
another length than the most frequent one or without an id. Repeated rows of one id and vector count once. A query never
finds its own id. Ties go to the smaller id. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

BLOCK = 4096


def valid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, vec, key) of the vectors that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(good)
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vec") == (size["d"] if size else 0))
    return K.stored(rows.withColumn("key", F.struct(F.xxhash64("vec").alias("a"), F.hash("vec").alias("b"))))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(c, vec, ids): distinct vectors, each with its k + 1 smallest ids; c is the smallest one."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.select("key", "vec_id", "vec").withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("key").agg(F.min("vec_id").alias("c"), F.first("vec").alias("vec"), F.array_sort(F.array_distinct(F.collect_list("vec_id"))).alias("ids"))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest inner products of each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]] if out.shape[1] else 0
    return out


def _assign(wish: np.ndarray, limit: int) -> np.ndarray:
    """Each row to the part it wishes most that has room; the rows with most to lose choose first."""
    n, parts = wish.shape
    part, room = np.full(n, -1), np.full(parts, limit)
    order = np.argsort(-wish, axis=1)
    lost = np.partition(wish, -2, axis=1)[:, -2:] if parts > 1 else np.zeros((n, 2))
    for i in np.argsort(-(lost[:, 1] - lost[:, 0]), kind="stable"):
        for p in order[i]:
            if room[p]:
                part[i], room[p] = p, room[p] - 1
                break
    return part


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.05) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them."""
    limit = int(np.ceil(len(x) / parts * slack))
    rng = np.random.default_rng(11)
    centre = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(6):
        part = _assign(x @ centre.T, limit)
        for p in range(parts):
            if (part == p).any():
                m = x[part == p].mean(axis=0)
                centre[p] = m / max(1e-12, np.linalg.norm(m))
    for _ in range(6):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1.0)
        votes[np.arange(len(x)), part] += 0.5
        part = _assign(votes + 1e-3 * (x @ centre.T), limit)
    return part


def softmax_fit(x: np.ndarray, target: np.ndarray, rounds: int = 250, rate: float = 2.0) -> np.ndarray:
    """Weights (the constant last) of a softmax regression on target distributions, by momentum steps."""
    full = np.column_stack([x, np.ones(len(x))])
    w = step = np.zeros((full.shape[1], target.shape[1]))
    for _ in range(rounds):
        z = full @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = 0.9 * step - rate * (full.T @ (p - target) / len(x) + 1e-5 * w)
        w = w + step
    return w


class Router:
    """The classifier over parts, the number of probes, and the sample for lower bounds."""

    def __init__(self, sample: np.ndarray, parts: int, k: int, target: float, edges: int = 10) -> None:
        parts = max(1, min(parts, len(sample) // 4))
        self.scale = max(1e-300, float(np.abs(sample).max())) * np.sqrt(sample.shape[1]) / 4
        x = sample / self.scale
        self.sample, self.k = sample, k
        graph = neighbours(x, edges)
        part = balanced_parts(x, graph, parts) if parts > 1 else np.zeros(len(x), np.int64)
        want = np.zeros((len(x), parts))
        want[np.arange(len(x)), part] = 0.5 if graph.shape[1] else 1.0
        if graph.shape[1]:
            np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
        self.weights = softmax_fit(x, want)
        self.parts = parts
        self.home = self.ranked(sample)[:, 0]
        # probes that find the wanted share of the true neighbours of sample vectors
        own = self.ranked(sample)
        place = np.empty_like(own)
        np.put_along_axis(place, own, np.broadcast_to(np.arange(parts), own.shape), axis=1)
        tested = neighbours(x, k)
        reach = np.sort(np.take_along_axis(place, own[:, 0][tested], axis=1).ravel()) if tested.size else np.zeros(1, int)
        self.probes = int(reach[min(len(reach) - 1, int(np.ceil(target * len(reach))))]) + 1

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        return np.argsort(-(x / self.scale @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")

    def bound(self, x: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """The (k+1)-th best score of each row within the sample rows of its probed parts, a little lowered for rounding."""
        if len(self.sample) <= self.k:
            return np.full(len(x), -np.inf)
        near = np.zeros((len(x), self.parts), bool)
        np.put_along_axis(near, probed, True, axis=1)
        s = np.where(near[:, self.home], x @ self.sample.T, -np.inf)
        s = np.partition(s, -self.k - 1, axis=1)[:, -self.k - 1]
        return np.where(np.isfinite(s), s - 1e-9 * (1 + np.abs(s)), -np.inf)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def _route(router: Router, queries: bool):
    def run(frames):
        for f in frames:
            for a in range(0, len(f), 1024):
                g = f.iloc[a:a + 1024]
                x = _matrix(g["vec"])
                ranked = router.ranked(x)
                packed = [v.tobytes() for v in x]
                if queries:
                    yield pd.DataFrame({"c": g["c"].to_numpy(), "vec": packed, "parts": list(ranked[:, :router.probes].astype(np.int32)), "bound": router.bound(x, ranked[:, :router.probes])})
                else:
                    yield pd.DataFrame({"c": g["c"].to_numpy(), "vec": packed, "part": ranked[:, 0].astype(np.int32)})
    return run


def _rerank(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, c = (np.frombuffer(b"".join(f["vec"]), float).reshape(len(f), -1) for f in (left, right))
            names, q, bound = right["c"].to_numpy(), left["c"].to_numpy(), left["bound"].to_numpy()
            for a in range(0, len(x), 256):
                s = x[a:a + 256] @ c.T
                low = bound[a:a + 256]
                if s.shape[1] > k + 1:
                    top = np.partition(s, -k - 1, axis=1)[:, -k - 1]
                    low = np.maximum(low, top - 1e-9 * (1 + np.abs(top)))
                i, j = np.nonzero(s >= low[:, None])
                out.append(pd.DataFrame({"q": q[a + i], "c": names[j], "score": np.einsum("ij,ij->i", x[a + i], c[j])}))
        return pd.concat(out) if out else pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "score": np.zeros(0)})
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", sample_rows: int = 8192, rows_per_part: int = 1024,
           target: float = 0.94) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for each row whose ``vec_id`` makes ``is_query`` true."""
    spark = vectors.sparkSession
    rows = valid(vectors, id, vector)
    result = "query_id bigint, rank int, vec_id bigint, score double"
    classes = K.stored(classes_of(rows, k))
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("key"), "c").limit(sample_rows).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], result)
    router = Router(np.array([r[0] for r in sample]), 1 << max(0, int(total / rows_per_part - 1e-9).bit_length()), k, target)
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "key").distinct()
    wanted = asked.groupBy("key").agg(F.count("*").alias("n")).join(classes.select("key", "c"), "key")
    asked = K.stored(asked)
    wanted = K.stored(wanted)
    shipped = classes.select("c", "vec").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cand = K.stored(shipped.mapInPandas(_route(router, False), "c bigint, vec binary, part int"))
    qs = classes.join(wanted.select("c"), "c", "left_semi").select("c", "vec").mapInPandas(_route(router, True), "c bigint, vec binary, parts array<int>, bound double")
    qs = K.stored(qs.select("c", "vec", "bound", F.explode("parts").alias("part")))
    # blocks of bounded size on both sides; a part's rows meet in every pair of its blocks
    blocks = lambda df, n: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    sizes = F.broadcast(blocks(cand, "nc").join(blocks(qs, "nq"), "part"))                       # a row for each part
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    left = qs.join(sizes, "part").withColumn("i", block("nq")).select("part", "i", up_to("nc").alias("j"), "c", "vec", "bound")
    right = cand.join(sizes, "part").withColumn("j", block("nc")).select("part", up_to("nq").alias("i"), "j", "c", "vec")
    hits = left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j")).applyInPandas(_rerank(k), "q bigint, c bigint, score double")
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("r") <= k + 1)
    named = best.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("r"), "vec_id", "score"))).alias("found"))
    lists = K.stored(wanted.join(lists, F.col("c") == F.col("q")).select("key", "n", "found"))
    found = K.spread_join(asked, lists, "key")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = found.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
