"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Each of ``trees`` trees has ``depth`` minwise tokens of its own, one for each level, so that trees are independent:
a set's tokens of a tree are its path, and two sets of similarity s stay together in one tree with probability
s^depth. After ``depth`` branchings nodes are small for unrelated sets; a node of more than ``node_limit`` sets
branches on, twice a level, by one byte of each of two tokens that the node chooses outside its own tree, until its parts are
small or much alike. No text is read for that.

At s = 0.8, depth 4 and 24 trees a link is missed with probability (1 - 0.8^4)^24 = 3.3e-6 where no node
branches on. Below a node that does, two branchings a level lose the pair with probability ((1 - s) / s)^2 = 1/16
at most, however deep they go, so a link is missed with probability below (1 - 0.8^4 * 15/16)^24 = 9e-6 if the bytes of
different branchings are taken as independent; they come from a pool of ``TOKENS``, so this is an estimate.

A small node is compared exhaustively on full sets: it is searched breadth first, each set against those
not yet reached, so a component costs its spanning links only and no list of all pairs is ever made.
A large node of much alike sets is cut into blocks; sets outside the node's largest component are then
compared with every block, so nothing is lost. Nodes of equal members in several trees are
compared once. Sets that are equal are one class from the start, joined by digest.

Only node keys, set numbers, sizes and two bits of each of the 96 minwise tokens (24 bytes) travel for all
documents. Inside a node a set goes on only where another one is near enough in size (exact) and agrees in so many of
these pairs of bits that a pair at the threshold falls short by 5.5 standard deviations only: for 96 tokens and s = 0.8
with probability below 1e-6. What goes on is grouped by components of such candidates, over all nodes and trees: a
group of at most ``node_limit`` sets is compared once, each set shipped once; larger groups are compared by their nodes.
Texts and shingle sets travel for these sets only (a Bloom filter of a fixed 8 MB keeps the other texts out of the
shuffle; where it is full, texts travel that the join then drops). Rows of nodes that hold one set are kept out in the
same way. Links and components stay distributed.

Null or blank text has no words: n_shingles 0, linked with nothing. A class of equal sets is named by its digest, so rows with
a null doc_id are linked as all others; a component's id is its smallest doc_id, null where all its ids are null. Repeated
rows are one class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsrank.operators.graph import connected_components
from newsrank.session import settled

from . import kernels as K

_U = np.uint64
#: Minwise tokens of a set at least; what the trees do not take serves the branchings below large nodes and the comparison.
TOKENS = 96
#: Bits of a Bloom filter of wanted texts or nodes: 8 MB at every input size. It only spares shuffling rows that a join then drops.
FILTER_BITS = 26
#: Equal pairs of bits in a byte of two briefs, by the exclusive or of the bytes.
EQUAL_PAIRS = np.array([sum(x >> k & 3 == 0 for k in (0, 2, 4, 6)) for x in range(256)], np.int16)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int):
    """Sorted distinct shingle hashes of each row, one after the other, and their offsets."""
    starts, ends, at = K.word_spans(data, offs, K.SPACED)
    count = np.diff(at)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    each = K.span_hash(K.prefix_sums(data, K.byte_codes(2)), starts, ends)
    # the hash of a shingle is a polynomial over its word hashes, and its length where the text is shorter
    size = np.minimum(count, words)
    n = np.where(count > 0, count - size + 1, 0)
    first = K.ragged(at[:-1], n)
    width = np.repeat(size, n)
    value = width.astype(_U) * _U(0xD6E8FEB86659FD93)
    for k in range(words):
        inside = width > k
        nxt = each[np.minimum(first + k, len(each) - 1)]
        value = np.where(inside, K.mix(value * _U(0x9E3779B97F4A7C15) + nxt), value)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def _multipliers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor and summand of the minwise function of each key."""
    return (K.mix(keys * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) | np.uint32(1), (K.mix(keys ^ _U(0xA0761D6478BD642F)) >> _U(32)).astype(np.uint32)


def _branch(node: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The child that the token chooses at the node."""
    return K.mix(node * _U(0x9E3779B97F4A7C15) + token.astype(_U) + _U(1))


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of equal width."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _profiles(words: int, trees: int, depth: int, tokens: int):
    """doc_id, text_key, size, digest, sketch (a byte of each token) and brief (two bits of each) of the shingle set, its node in each tree."""
    mul, add = _multipliers(np.arange(1, tokens + 1, dtype=_U))
    roots = K.mix(np.arange(1, trees + 1, dtype=_U))

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key"))
            for a, b, data, offs in K.text_chunks(batch):
                sets, at = shingle_sets(data, offs, words)
                n = np.diff(at)
                sketch = np.zeros((b - a, tokens), np.uint8)
                brief = np.zeros((b - a, -(-tokens // 4)), np.uint8)
                some = np.flatnonzero(n)
                d1, d2 = np.zeros(b - a, _U), np.zeros(b - a, _U)
                node = np.repeat(roots[None], b - a, axis=0)
                if len(some):
                    cut = at[:-1][some]
                    d1[some] = np.add.reduceat(K.mix(sets), cut)
                    d2[some] = np.add.reduceat(K.mix(sets ^ _U(0x5851F42D4C957F2D)), cut)
                    h = (sets >> _U(32)).astype(np.uint32)
                    for k in range(tokens):
                        token = np.minimum.reduceat(h * mul[k] + add[k], cut)
                        if k < trees * depth:
                            node[some, k % trees] = _branch(node[some, k % trees], token)
                        sketch[some, k] = K.mix(token.astype(_U)) >> _U(56)
                        brief[:, k // 4] |= (sketch[:, k] >> 6) << 2 * (k % 4)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                     _fixed(sketch), _fixed(brief),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * trees, pa.int32()), pa.array(node.view(np.int64).ravel()))],
                    ["doc_id", "text_key", "n_shingles", "d1", "d2", "sketch", "brief", "nodes"])
    return run


def _own_set(sets: np.ndarray, d1: int, d2: int) -> bool:
    return len(sets) > 0 and int(K.mix(sets).sum(dtype=_U).view(np.int64)) == d1 and int(K.mix(sets ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)) == d2


def _deeper(rows: DataFrame, classes: DataFrame, trees: int, depth: int, tokens: int) -> DataFrame:
    """Children of large nodes: two branchings each, by the bytes of two tokens that the node chooses, none of its own tree."""
    others = tokens - depth
    first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(others))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit("second")), F.lit(others - 1)), F.lit(others))

    def child(which: Column) -> Column:
        # the tokens of the other trees come first, then those of no tree
        beside = F.pmod(F.col("tree") + 1 + which % max(trees - 1, 1), F.lit(trees)) + trees * F.floor(which / max(trees - 1, 1))
        at = F.when(which < (trees - 1) * depth, beside).otherwise(which + depth)
        return F.xxhash64("node", at, F.substring("sketch", (at + 1).cast("int"), F.lit(1)))

    j = rows.join(classes.select("rep", "sketch"), "rep")
    return j.select(F.explode(F.array(child(first), child(second))).alias("node"), "rep", F.col("n").alias("parent"), "tree")


def _member_sets(words: int):
    """(node, side, rep, shingle set) for each node of a document."""
    def run(batches):
        for batch in batches:
            at_name = batch.schema.get_field_index
            reps, d1, d2 = (batch.column(at_name(c)).to_pylist() for c in ("rep", "d1", "d2"))
            nodes = batch.column(at_name("nodes")).to_pylist()
            for a, b, data, offs in K.text_chunks(batch):
                sets, at = shingle_sets(data, offs, words)
                out = []
                for d in range(b - a):
                    own = sets[at[d]:at[d + 1]]
                    if _own_set(own, d1[a + d], d2[a + d]):
                        raw = own.tobytes()
                        out += [(x["node"], x["side"], reps[a + d], raw) for x in nodes[a + d]]
                for i in range(0, len(out), 256):
                    cols = list(zip(*out[i:i + 256]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                                                     ["node", "side", "rep", "shingles"])
    return run


def node_links(reps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of one node, each confirmed on the full sets.

    Sides: 0 is compared with all others, 1 only with side 0 (its own pairs are compared elsewhere).
    """
    size = np.array([len(s) for s in sets])
    flat, token = np.unique(np.concatenate(sets), return_inverse=True)
    row_at = np.append(0, np.cumsum(size))
    mark = np.zeros(len(flat), bool)
    left = np.ones(len(reps), bool)
    links = []
    for seed in range(len(reps)):
        if not left[seed]:
            continue
        left[seed] = False
        queue, group = [seed], [seed]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left & (sides == 0) if sides[i] else left)
            # a size ratio below the threshold rules a pair out before any token is read
            rest = rest[(100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
            if not len(rest):
                continue
            mark[token[row_at[i]:row_at[i + 1]]] = True
            hit = mark[token[K.ragged(row_at[rest], size[rest])]]
            mark[token[row_at[i]:row_at[i + 1]]] = False
            cut = np.cumsum(size[rest]) - size[rest]
            both = np.add.reduceat(hit.astype(np.int64), cut)
            near = rest[100 * both >= percent * (size[rest] + size[i] - both)]
            left[near] = False
            queue += near.tolist()
            group += near.tolist()
        # named by its smallest set, so that the same group found in several trees gives the same links
        names = sorted(int(reps[i]) for i in group)
        links += [(names[0], x) for x in names[1:]]
    return links


def _confirm(percent: int):
    def run(batches):
        held, now = [], None

        def close():
            out = node_links(np.array([h[1] for h in held]), np.array([h[0] for h in held]), [np.frombuffer(h[2], _U) for h in held], percent)
            if out:
                a, b = zip(*out)
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for node, side, rep, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "side", "rep", "shingles"))):
                if node != now:
                    if len(held) > 1 and (out := close()):
                        yield out
                    held, now = [], node
                held.append((side, rep, raw))
        if len(held) > 1 and (out := close()):
            yield out
    return run


def least_agreement(percent: int, tokens: int) -> int:
    """Equal pairs of bits, of ``tokens``, that sets at the threshold reach but for 5.5 standard deviations."""
    q = (3 * percent + 100) / 400                                # tokens agree, or differ and agree in two bits
    return max(0, int(tokens * q - 5.5 * (tokens * q * (1 - q)) ** 0.5))


def candidate_groups(sides: np.ndarray, sizes: np.ndarray, briefs: np.ndarray, percent: int, tokens: int) -> np.ndarray:
    """For each member of a node the first member of its component of candidate pairs, -1 where it has no pair."""
    n = len(sides)
    agree = least_agreement(percent, tokens) + 4 * briefs.shape[1] - tokens      # unused bits agree always
    left, right = [], []
    step = max(1, (4 << 20) // briefs.size)
    for a in range(0, n, step):
        part = slice(a, a + step)
        near = 100 * np.minimum(sizes[part, None], sizes) >= percent * np.maximum(sizes[part, None], sizes)
        near &= (sides[part, None] == 0) | (sides == 0)
        near &= np.arange(a, a + near.shape[0])[:, None] < np.arange(n)
        i, j = np.nonzero(near)
        for k in range(0, len(i), 1 << 15):
            x, y = i[k:k + (1 << 15)] + a, j[k:k + (1 << 15)]
            ok = EQUAL_PAIRS[briefs[x] ^ briefs[y]].sum(axis=1) >= agree
            left.append(x[ok])
            right.append(y[ok])
    i, j = np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])
    first = np.arange(n)
    while True:
        low = np.minimum(first[i], first[j])
        before = first.copy()
        np.minimum.at(first, i, low)
        np.minimum.at(first, j, low)
        first = first[first]
        if (first == before).all():
            break
    paired = np.zeros(n, bool)
    paired[i] = paired[j] = True
    return np.where(paired, first, -1)


def _promising(percent: int, tokens: int):
    """Members of a node that another member is near enough to, by size and by brief, with the first of their group."""
    def close(node, rows):
        briefs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        first = candidate_groups(np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64), briefs, percent, tokens)
        return [(node, rows[i][0], rows[i][1], rows[first[i]][1]) for i in np.flatnonzero(first >= 0).tolist()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["node", "side", "rep", "head"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            out = []
            for node, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "side", "rep", "n_shingles", "brief"))):
                if node != now:
                    if len(held) > 1:
                        out += close(now, held)
                    held, now = [], node
                held.append(row)
            if out:
                yield batch_of(out)
        if len(held) > 1 and (out := close(now, held)):
            yield batch_of(out)
    return run


def _held(rows: DataFrame, columns: list[str], wanted: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are not among the ``names`` of ``wanted``: a Bloom filter of fixed size."""
    def spots(key: list[str]) -> list[Column]:
        return [F.shiftrightunsigned(F.xxhash64(*key, F.lit(k)), 64 - FILTER_BITS) for k in (0, 1)]

    at = wanted.select(F.explode(F.array(*spots(names))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)              # at most 2^20 words reach the driver
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b, t = a.to_numpy(), b.to_numpy(), shared.value
        return pd.Series((t[a >> 6] >> (a & 63)) & (t[b >> 6] >> (b & 63)) & 1 == 1)

    return rows.where(held(*spots(columns)))


def _texts(rows: DataFrame, columns: list[str], classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text, nodes, d1, d2): the text of each set of the (node, rep, ...) rows beside the list of its nodes."""
    lists = rows.groupBy("rep").agg(F.collect_list(F.struct(*columns)).alias("nodes"))
    wanted = K.stored(lists.join(classes.select("rep", "d1", "d2", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), "rep"))
    docs = _held(docs, ["doc_id", "text_key"], wanted, ["__id", "__key"])
    # null ids are many rows under one key: one row of each text is enough
    texts = docs.where("doc_id is not null").unionByName(docs.where("doc_id is null").dropDuplicates(["text_key"]))
    return texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).select("rep", "text", "nodes", "d1", "d2")


def _grouped(left: DataFrame, node_limit: int) -> DataFrame:
    """(node, side, rep): candidate groups of at most ``node_limit`` sets as one node each, the other rows as they are."""
    groups = connected_components(left.where("head != rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
    small = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= node_limit).select("root")
    small = K.stored(groups.join(small, "root").select(F.col("node").alias("rep"), F.xxhash64("root", F.lit("group")).alias("node")))
    rest = left.join(small.select("rep"), "rep", "left_anti").select("node", "side", "rep")
    return small.select("node", F.lit(0).alias("side"), "rep").unionByName(rest)


def _links(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, tokens: int, node_limit: int | None = None) -> DataFrame:
    """Confirmed links of the given (node, side, rep) rows; with ``node_limit`` groups of candidates stand for nodes."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = members.join(classes.select("rep", "n_shingles", "brief"), "rep")
    left = K.stored(sketched.repartition(n, "node").sortWithinPartitions("node", "rep").mapInArrow(_promising(percent, tokens), "node bigint, side int, rep bigint, head bigint"))
    left = left.drop("head") if node_limit is None else K.stored(_grouped(left, node_limit))
    # one node of each set of members, as before: what is left of a group is the same in most trees
    same = left.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep", "side").cast("decimal(38,0)")).alias("mark"))
    left = left.join(same.groupBy("n", "mark").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
    texts = _texts(left, ["node", "side"], classes, docs)
    sets = texts.mapInArrow(_member_sets(words), "node bigint, side int, rep bigint, shingles binary")
    return sets.repartition(n, "node").sortWithinPartitions("node", "rep").mapInArrow(_confirm(percent), "a bigint, b bigint")


def _components(docs: DataFrame, words: int, percent: int, trees: int, depth: int, node_limit: int, deepest: int) -> tuple[DataFrame, DataFrame]:
    """(profile of every row, (d1, d2, root, doc_id, text_key) of every class of equal sets)."""
    tokens = max(TOKENS, trees * depth)
    profile = K.stored(docs.mapInArrow(_profiles(words, trees, depth, tokens), "doc_id bigint, text_key bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary, brief binary, nodes array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row")
    classes = profile.where("n_shingles > 0").groupBy("d1", "d2").agg(first, F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"),
                                                                 F.first("brief").alias("brief"), F.first("n_shingles").alias("n_shingles"))
    classes = K.stored(classes.select("d1", "d2", F.xxhash64("d1", "d2").alias("rep"), "row.doc_id", "row.text_key", "nodes", "sketch", "brief", "n_shingles"))
    level = classes.select(F.posexplode("nodes").alias("tree", "node"), "rep", F.lit(None).cast("bigint").alias("parent"))
    leaves, dense = [], []
    for step in range(depth, deepest + 1):
        if step == depth:
            # of all rows only their nodes travel, to be counted; the rows of a node of one set stay where they are
            shared = K.stored(level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
            level = K.stored(_held(level, ["node"], shared, ["node"]))
        sizes = K.stored(level.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"),
                                                   F.min("parent").alias("parent")).where("n > 1"))
        small = sizes.where(F.col("n") <= node_limit)
        # one node of each set of members
        kept = small.groupBy("n", "mark").agg(F.min("node").alias("node"))
        leaves.append(level.join(kept.select("node"), "node").select("node", "rep"))
        large = sizes.where(F.col("n") > node_limit)
        if large.isEmpty():
            break
        # a node that keeps more than half of its parent is a group of much alike sets: branching on would only lose links
        alike = F.lit(step == deepest) | (2 * F.col("n") > F.coalesce("parent", F.lit(1 << 62)))
        rows = K.stored(level.select("node", "rep", "tree").join(large.select("node", "n", alike.alias("alike")), "node"))
        dense.append(rows.where("alike").select("node", "rep", "n"))
        level = K.stored(_deeper(rows.where("not alike"), classes, trees, depth, tokens))
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    members = members.withColumn("side", F.lit(0))
    large = None
    for more in dense:
        large = more if large is None else large.unionByName(more)
    # a power of two, and by set alone: a group that several trees find alike is cut alike
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(F.col("n") / node_limit).cast("double")) - 1e-9)).cast("bigint")
    if large is not None:
        large = large.withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
        members = members.unionByName(large.select(F.xxhash64("node", "block", F.lit("block")).alias("node"), "rep", F.lit(0).alias("side")))
    links = K.stored(_links(members, classes, docs, words, percent, tokens, node_limit))
    found = connected_components(links)
    if large is not None:
        # sets outside the largest component of a cut node meet every block of it
        placed = K.stored(large.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
        by_size = placed.groupBy("node", "root").count()
        main = by_size.groupBy("node").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        outside = placed.join(main, "node").where("root != main").select("node", "n", "rep", "block")
        if not outside.isEmpty():
            chunk = F.pmod(F.xxhash64("rep", F.lit("chunk")), F.ceil(F.col("outs") / node_limit))
            counts = outside.groupBy("node").agg(F.count("*").alias("outs"))
            outside = K.stored(outside.join(counts, "node").withColumn("chunk", chunk))
            groups = outside.select("node", "n", "outs").distinct()
            cell = lambda c, b: F.xxhash64("node", c, b, F.lit("cell"))
            a = outside.select("node", "rep", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
            b = placed.join(groups.select("node", "outs"), "node").select(
                "node", "rep", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("outs") / node_limit) - 1)).alias("chunk"))
            a = a.select(cell("chunk", "block").alias("node"), "rep", F.lit(0).alias("side"))
            b = b.select(cell("chunk", "block").alias("node"), "rep", F.lit(1).alias("side"))
            cells = a.unionByName(b).groupBy("node", "rep").agg(F.min("side").cast("int").alias("side"))
            links = links.unionByName(_links(cells, classes, docs, words, percent, tokens))
            found = connected_components(links)
    return profile, classes.select("d1", "d2", "rep", "doc_id", "text_key").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("root", "rep").alias("root"), "doc_id", "text_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


@settled
def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, trees: int = 24, depth: int = 4,
                    node_limit: int = 256, deepest: int = 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Rows are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable.
    """
    profile, classes = _components(_keyed(docs), words, percent, trees, depth, node_limit, deepest)
    named = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = classes.select("d1", "d2", "root").join(named, "root").drop("root")
    out = profile.select("doc_id", "n_shingles", "d1", "d2").join(of, ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@settled
def _keepers(docs: DataFrame, words: int, percent: int, trees: int, depth: int, node_limit: int, deepest: int) -> DataFrame:
    """(doc_id, text_key) of the row that stands for each component, and of every row without words."""
    profile, classes = _components(docs, words, percent, trees, depth, node_limit, deepest)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row"))
    return first.select("row.doc_id", "row.text_key").unionByName(profile.where("n_shingles = 0").select("doc_id", "text_key").distinct())


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 24, depth: int = 4, node_limit: int = 256,
                         deepest: int = 20) -> DataFrame:
    """One row of each group of near duplicates, its columns untouched: that of the smallest doc_id, nulls last.

    Of rows that repeat id and text one stays.
    """
    key = lambda id, text: F.concat_ws("/", F.coalesce(id.cast("bigint").cast("string"), F.lit("none")), text.cast("string"))
    kept = _keepers(_keyed(docs), words, percent, trees, depth, node_limit, deepest).select(key(F.col("doc_id"), F.col("text_key")).alias("__key"))
    rows = docs.withColumn("__key", key(F.col("doc_id"), F.xxhash64("text"))).join(kept, "__key", "left_semi")
    # partitioned as the join is: no further shuffle
    copies = Window.partitionBy("__key").orderBy("__key")
    return rows.withColumn("__n", F.row_number().over(copies)).where("__n = 1").select(*docs.columns)
