"""What the title join and the ordered pass send, and grams that are not handed to the tasks."""

import math
import random
from collections import Counter

import pytest

from newsrank.operators import dedup as DD
from newsrank.operators.graph import authority_pass


def shuffled(spark) -> tuple[int, int]:
    """Rows and bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleWriteBytes() for s in stages)


def counted(title):
    return Counter(f" {w} "[i:i + n] for w in title.split() for n in (2, 3, 4) for i in range(len(w) + 3 - n))


def made(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(40)]
    titles = [" ".join(rng.sample(words, 25)) for _ in range(n)]
    return titles + [" ".join(t.split() + [words[i]]) for i, t in enumerate(titles[:40])]


def test_titles_travel_packed_and_in_large_tiles(spark):
    titles = made(600)
    rows = spark.createDataFrame(list(enumerate(titles)), "o long, title string")
    vectors = DD.cut_lineage(DD.title_vectors(rows, "o", "title"))
    n_grams = sum(len(counted(t)) for t in titles)
    before = shuffled(spark)[1]
    assert DD.title_pairs(vectors, 0.85, tile_rows=80).count() >= 30
    # about eight tiles; with number and weight of a gram in 16 bytes and both titles at each pair of tiles it was over 32 bytes
    assert shuffled(spark)[1] - before < 4 * 4 * n_grams


@pytest.mark.parametrize("known, tile_rows", [(1 << 19, 1000), (100, 15), (1, 1000)])
def test_grams_that_are_not_handed_out_count_as_well(spark, known, tile_rows):
    titles = made(60) + ["a", "é", "a b", "😀 😀x", "x" * 300, "zq " * 70 + "zq", "İstanbul ΑΣ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles + titles[:5])], "o long, title string")
    small = {t: " ".join(t.lower().split()) for t in titles}
    tf = {i: counted(small[t]) for i, t in enumerate(titles)}
    df = Counter(x for t in titles + titles[:5] for x in counted(small[t]))
    w = {i: {x: n * (math.log((1 + len(titles) + 5) / (1 + df[x])) + 1) for x, n in g.items()} for i, g in tf.items()}
    norm = {i: math.sqrt(sum(v * v for v in g.values())) for i, g in w.items()}
    cos = lambda i, j: sum(v * w[j].get(x, 0) for x, v in w[i].items()) / norm[i] / norm[j]
    want = {(i, j): c for i in tf for j in tf if i < j and (c := cos(i, j)) > 0.5}
    vectors = DD.cut_lineage(DD.title_vectors(rows, "o", "title", known_grams=known))
    got = {(r.a, r.b): r.cosine for r in DD.title_pairs(vectors, 0.5, tile_rows=tile_rows).collect()}
    assert got == pytest.approx(want)
    assert len(want) >= 40


def test_decided_groups_leave_the_ordered_pass(spark):
    # 60 rows near each other are decided at once; a chain of 24 rows takes a round for every second one
    rows = [(i, i, 1) for i in range(60)] + [(100 + i, 100 + i, 1) for i in range(24)]
    edges = [(i, j) for i in range(60) for j in range(i + 1, 60)] + [(100 + i, 101 + i) for i in range(23)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)[0]
        kept = authority_pass(spark.createDataFrame(rows, "o long, g long, auth int"), spark.createDataFrame(edges, "a long, b long"))
        assert sorted(r.o for r in kept.collect()) == [0] + list(range(100, 124, 2))
        assert shuffled(spark)[0] - before < 15 * 2 * len(edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
