"""Tiled joins and graph loops against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsrank.operators.graph import authority_pass, cluster_of, connected_components, mutual_best, ordered_caps
from newsrank.operators.similarity import nearest, similar_links, similar_pairs, vector_rows
from newsrank.session import cut_lineage


def vectors(n=240, dim=6, seed=3, copies=60):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[:copies] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hours = rng.integers(0, 400, size=n).astype(float)
    hours[::17] = np.nan
    return v.astype(np.float32), hours


def frame(spark, v, hours):
    rows = [(i, v[i].tolist(), None if np.isnan(hours[i]) else float(hours[i])) for i in range(len(v))]
    return spark.createDataFrame(rows, "id long, v array<float>, h double")


def truth(v, hours, thr, window, missing):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    out = set()
    for i in range(len(v)):
        for j in range(i + 1, len(v)):
            gap = abs(hours[i] - hours[j])
            near = missing == "pass" if np.isnan(gap) else gap <= window
            if c[i, j] >= thr and near:
                out.add((i, j))
    return out


@pytest.mark.parametrize("tile_rows", [4096, 25])
@pytest.mark.parametrize("missing", ["pass", "block"])
def test_pairs_and_links(spark, tile_rows, missing):
    v, h = vectors()
    rows = vector_rows(frame(spark, v, h), "id", "v", F.col("h"))
    want = truth(v, h, 0.8, 48, missing)
    kw = dict(window_hours=48.0, missing_time=missing, tile_rows=tile_rows, pivots=8)
    got = similar_pairs(rows, 0.8, **kw).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == want

    parent = list(range(len(v)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    links = similar_links(rows, 0.8, **kw)
    got = {r.id: r.cluster for r in cluster_of(rows.select("id"), links).collect()}
    assert got == {i: find(i) for i in range(len(v))}


@pytest.mark.parametrize("tile_rows", [4096, 40])
def test_nearest(spark, tile_rows):
    v, h = vectors(copies=0)
    df = frame(spark, v, h)
    left = vector_rows(df.where("id < 100"), "id", "v")
    right = vector_rows(df.where("id >= 100"), "id", "v")
    got = {r.a: r.b for r in nearest(left, right, -1.0, tile_rows=tile_rows, pivots=4).collect()}
    c = v[:100].astype(float) @ v[100:].astype(float).T
    assert got == {i: 100 + int(c[i].argmax()) for i in range(100)}


@pytest.mark.parametrize("tile_rows", [4096, 25])
def test_groups_never_mix(spark, tile_rows):
    v, h = vectors(n=120)
    df = frame(spark, v, h).withColumn("k", (F.col("id") % 3).cast("string"))
    rows = vector_rows(df, "id", "v", F.col("h"), group=F.col("k"))
    got = {(r.a, r.b) for r in similar_pairs(rows, 0.8, window_hours=48.0, missing_time="block", tile_rows=tile_rows, pivots=4).collect()}
    assert got == {(a, b) for a, b in truth(v, h, 0.8, 48, "block") if a % 3 == b % 3}


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_ordered_caps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if rng.random() < .1 else int(rng.integers(0, 9)), int(rng.integers(0, 12))) for i in range(120)]
    n1, n2, want = {}, {}, []
    for o, k1, k2 in rows:
        if (k1 is not None and n1.get(k1, 0) >= 3) or n2.get(k2, 0) >= 1:
            continue
        want.append(o)
        if k1 is not None:
            n1[k1] = n1.get(k1, 0) + 1
        n2[k2] = n2.get(k2, 0) + 1
    df = spark.createDataFrame(rows, "o long, k1 int, k2 int")
    assert sorted(r.o for r in ordered_caps(df, "o", {"k1": 3, "k2": 1}).collect()) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_authority_pass(spark, seed):
    rng = np.random.default_rng(seed)
    n, groups = 60, 25
    g, auth = rng.integers(0, groups, n), rng.integers(1, 4, n)
    edges = {(a, b) for a in range(groups) for b in range(a + 1, groups) if rng.random() < 0.08}

    def alike(i, j):
        a, b = sorted((g[i], g[j]))
        return a == b or (a, b) in edges

    keep = [True] * n
    for i in range(n):
        if not keep[i]:
            continue
        for j in range(i + 1, n):
            if keep[j] and alike(i, j):
                if auth[j] > auth[i]:
                    keep[i] = False
                    break
                keep[j] = False
    rows = spark.createDataFrame([(i, int(g[i]), int(auth[i])) for i in range(n)], "o long, g long, auth int")
    links = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    assert sorted(r.o for r in authority_pass(rows, links).collect()) == [i for i in range(n) if keep[i]]


def test_mutual_best(spark):
    rng = np.random.default_rng(5)
    pairs = [(a, 100 + b, float(round(rng.random(), 1))) for a in range(8) for b in range(9) if rng.random() < .6]
    used, want = set(), set()
    for a, b, c in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    df = spark.createDataFrame(pairs, "a long, b long, cosine double")
    assert {(r.a, r.b) for r in mutual_best(df).collect()} == want


def test_small_cells_share_tiles(spark):
    from newsrank.operators import similarity as S

    rng = np.random.default_rng(8)
    v = rng.normal(size=(800, 32)).astype(np.float32)
    rows = vector_rows(frame(spark, v, np.zeros(len(v))), "id", "v")
    centre = S._pick_pivots(rows, 64)
    tiles = S._cut_into_tiles(S._with_cells(rows, centre), None, 400, centre)
    sizes = [r["count"] for r in tiles.groupBy("tile").count().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 800 and len(sizes) <= 3


@pytest.mark.parametrize("hot_rows", [64, 1])
def test_authority_pass_takes_few_rounds(spark, monkeypatch, hot_rows):
    """Every two rows have a neighbour in common: turns must not wait for all rows within two steps."""
    from newsrank.operators import graph

    rng = np.random.default_rng(11)
    n, groups = 240, 200
    g, auth = np.append(np.arange(groups), rng.integers(0, 20, n - groups)), rng.integers(1, 6, n)
    near = np.triu(rng.random((groups, groups)) < 0.12, 1)
    near = near | near.T | np.eye(groups, dtype=bool)
    keep = [True] * n
    for i in range(n):
        for j in range(i + 1, n):
            if keep[i] and keep[j] and near[g[i], g[j]]:
                if auth[j] > auth[i]:
                    keep[i] = False
                else:
                    keep[j] = False
    written = []
    monkeypatch.setattr(graph, "HOT_ROWS", hot_rows, raising=False)
    monkeypatch.setattr(graph, "cut_lineage", lambda df, *path: written.append(1) or cut_lineage(df, *path))
    rows = spark.createDataFrame([(i, int(g[i]), int(auth[i])) for i in range(n)], "o long, g long, auth int")
    links = spark.createDataFrame([(a, b) for a in range(groups) for b in range(a + 1, groups) if near[a, b]], "a long, b long")
    assert sorted(r.o for r in authority_pass(rows, links).collect()) == [i for i in range(n) if keep[i]]
    assert hot_rows == 1 or len(written) < 60
