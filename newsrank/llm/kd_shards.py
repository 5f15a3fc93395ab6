"""Shards of near equal bytes by a k-d tree over metadata.

A node of k shards is cut at the weighted k-th part of its bytes along its widest dimension (spread as a share of the
spread of the whole table), until every leaf holds one shard's bytes. The dimensions are the crc32 of the text (equal
texts have one place), its size, and hashes of language and source.

A cut is found by aggregations alone: each row has a 42-bit key (21 bits of place, 21 bits that break ties by text
and id), and three rounds of weighted histograms with 2^14 bins for each node narrow the key down; only one row for each
node reaches the driver. Cuts (fewer than ``shards``) come to the rows by broadcast, so rows are never shuffled while the
tree grows. A group of equal texts has one place in all dimensions, that of its smallest language and source, and is never torn
where it holds at most a fiftieth of a shard (``WHOLE``); larger groups are cut by id, since kept whole they would make
shards unequal.

Slots number the rows of a shard without a gap: rows get a number in one of many parts of the shard, and parts get offsets.

Null text is empty, null language or source is a value of its own. Repeated rows are rows. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

PLACE, TIE, BIN = 21, 21, 14
DIMENSIONS = ("d0", "d1", "d2", "d3")
ROWS_PER_PART = 50_000
WHOLE = 50


def measured(docs: DataFrame, shards: int, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, dimensions of 21 bits, tie)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    code = lambda c: F.pmod(F.xxhash64(c) if c in docs.columns else F.lit(0), F.lit(1 << PLACE)).cast("bigint")
    rows = K.stored(docs.select("doc_id", (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
                                code("lang").alias("l"), code("source").alias("s")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("text_key").agg(F.min(F.struct("l", "s")).alias("at"), F.count("*").alias("n"), (F.sum("size") * shards * WHOLE <= total).alias("whole"))
    rows = K.spread_join(rows, groups.select("text_key", F.col("at.l").alias("d2"), F.col("at.s").alias("d3"), "whole", "n"), "text_key")
    place = F.least(F.floor(F.log2(F.col("size")) * (1 << 15)), F.lit((1 << PLACE) - 1)).cast("bigint")
    torn = F.shiftrightunsigned(F.xxhash64("text_key"), 64 - 10) * (1 << 11) + F.shiftrightunsigned(F.xxhash64("doc_id", "text_key"), 64 - 11)
    tie = F.when(F.col("whole"), F.shiftrightunsigned(F.xxhash64("text_key"), 64 - TIE)).otherwise(torn)
    return rows.withColumns({"d0": F.shiftright("text_crc32", 32 - PLACE), "d1": place, "tie": tie}).drop("text_key", "l", "s", "whole")


def _with_nodes(rows: DataFrame, nodes: list[tuple], schema: str) -> DataFrame:
    """Rows of the given nodes with the nodes' figures; there are fewer nodes than shards."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(nodes, schema)), "node")


def _key() -> Column:
    return F.shiftleft(F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1), TIE) + F.col("tie")


def _cuts(rows: DataFrame, level: dict[int, int], whole: dict) -> list[tuple]:
    """(node, dimension, key) of the cut of each open node: rows with smaller keys go left."""
    spread = [F.max(d).alias(f"hi{d}") for d in DIMENSIONS] + [F.min(d).alias(f"lo{d}") for d in DIMENSIONS]
    widths = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *spread).collect()      # one row for each open node
    if not whole:
        whole |= {d: max([1, *(w[f"hi{d}"] - w[f"lo{d}"] for w in widths)]) for d in DIMENSIONS}
    dims = {w["node"]: max(range(len(DIMENSIONS)), key=lambda i: ((w[f"hid{i}"] - w[f"lod{i}"]) / whole[f"d{i}"], i)) for w in widths}
    want = {w["node"]: w["bytes"] * (level[w["node"]] // 2) // level[w["node"]] for w in widths}
    low = dict.fromkeys(dims, 0)
    for shift in range(PLACE + TIE - BIN, -1, -BIN):
        keyed = _with_nodes(rows, [(n, dims[n], low[n], want[n]) for n in dims], "node int, dim int, low bigint, goal bigint")
        bins = (keyed.select("node", "goal", "size", F.shiftright(_key() - F.col("low"), shift).alias("bin")).where(f"bin >= 0 and bin < {1 << BIN}")
                .groupBy("node", "goal", "bin").agg(F.sum("size").alias("bytes")))
        before = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")) - F.col("bytes")     # at most 2^14 rows a node
        found = bins.withColumn("before", before).where("before <= goal").groupBy("node").agg(F.max_by(F.struct("bin", "before"), "bin").alias("x")).collect()
        for f in found:
            low[f["node"]] += f["x"]["bin"] << shift
            want[f["node"]] -= f["x"]["before"]
    return [(n, dims[n], low[n]) for n in dims]


def split(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with the number of their leaf as ``shard``; leaves are numbered in the order of the tree."""
    rows = rows.withColumn("node", F.lit(0))                     # a node is named by the first shard below it
    level, whole = {0: shards}, {}
    while any(k > 1 for k in level.values()):
        open_nodes = {n: k for n, k in level.items() if k > 1}
        cuts = _cuts(rows.where(F.col("node").isin(list(open_nodes))), open_nodes, whole)
        level = {n: k for n, k in level.items() if k == 1} | {n: k // 2 for n, k in open_nodes.items()} | {n + k // 2: k - k // 2 for n, k in open_nodes.items()}
        if not cuts:
            break
        moves = rows.sparkSession.createDataFrame([(*c, c[0] + open_nodes[c[0]] // 2) for c in cuts], "node int, dim int, cut bigint, right int")
        node = F.when(_key() >= F.col("cut"), F.col("right")).otherwise(F.col("node"))
        rows = K.stored(rows.join(F.broadcast(moves), "node", "left").withColumn("node", node.cast("int")).drop("dim", "cut", "right"))
    return rows.withColumnRenamed("node", "shard")


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = K.stored(measured(docs, shards, overhead))
    rows = split(rows, shards).select("doc_id", "size", "text_crc32", "shard")
    parts = max(16, rows.count() // (shards * ROWS_PER_PART))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    numbered = rows.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")).cast("bigint") - 1)
    sizes = rows.groupBy("shard", "part").count()
    offsets = sizes.withColumn("offset", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).drop("count")
    return numbered.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("offset")).alias("slot"))
