"""Prefix trie of conversations by fixed-length blocks of turns.

1. Turns get their place in their conversation and a digest of role and text; every ``block`` successive turns of a
   conversation make a block with a digest of its own. A block's rows are at most ``block``, whatever the conversation.
2. Rounds group conversations by successive block digests: a conversation stays in the rounds while another one shares
   all its blocks so far. A round takes one block, the next one two, then four, up to 64, so that a prefix shared over n
   blocks costs about log2(n) + n / 64 rounds. A conversation that is alone leaves; the rest of it is its own branch.
3. A block that all its group shares is one *unit*: all its depths have the same members. Only where siblings diverge
   inside a block are turn boundaries looked at, and each depth of such a block is a unit of its own.
4. A node is named by its smallest member and its depth, so every conversation owns one chain of nodes, from where it
   becomes the smallest member to its end. Sums over a subtree are therefore sums over members: each member brings what
   its own chain holds, and one grouping by unit gives them all; no walk over the tree is needed.

Groupings combine before the shuffle; joins on a group's key send the thousand largest groups by broadcast (at most
1,000 rows). The digest of the members that end at a node is fed in pieces of at most 65,536 ids, in order.

Rows without conv_id belong to no conversation. Null role and null text are empty. Turns are ordered by turn, nulls first;
rows of one conversation with the same turn by role, then by digest; repeated rows are turns of their own. An empty table
has no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsrank.operators.ordering import numbered_within
from newsrank.session import settled

from . import kernels as K

BLOCK = 4
WIDEST_ROUND = 64
ID_BITS = 16
ROOT = hashlib.sha256(b"root").digest()
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): every turn of a conversation in its order, from place 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = _sha(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    return K.stored(numbered_within(turns, "conv_id", ["turn", "role", "digest"], "place").select("conv_id", "place", "digest", "bytes"))


def rebuilt(turns: DataFrame, step: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The turns after each conversation took its first turns from another one, and (conv_id, n_turns).

    Conversation c begins with the first h turns of c - c % ``step`` and goes on with its own turns after its first h;
    h is crc32 of c modulo ``heads``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    wanted = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = K.stored(wanted.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "conv_id", "base", "h", "n", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    head = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(head, "base").where("place <= h").select("conv_id", "place", "digest", "bytes")
    rest = K.spread_join(turns.where(F.col("place") > h), convs.select("conv_id", (F.col("taken") - F.col("h")).alias("shift"), "n"), "conv_id")
    rest = rest.select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "digest", "bytes")
    return K.stored(first.unionByName(rest)), convs.select("conv_id", "n_turns")


def _chain(items: Column, start: Column, value) -> Column:
    """[(before, after, item)] with after = digest of (before, value(item)), before of the first being ``start``."""
    kind = "array<struct<before:binary,after:binary>>"

    def step(done, x):
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["after"], start)
        return F.concat(done, F.array(F.struct(before.alias("before"), _sha(before, value(x)).alias("after"))))

    return F.arrays_zip(F.aggregate(items, F.lit([]).cast(kind), step).alias("link"), items.alias("item"))


def _rounds(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, b, before, after): the blocks of conversations that still shared everything before them (step 2)."""
    active, rounds, b, width = convs.select("conv_id", F.lit(ROOT).alias("group")), [], 0, 1
    while True:
        here = blocks.where((F.col("b") >= b) & (F.col("b") < b + width)).select("conv_id", "b", "key").join(active, "conv_id")
        here = here.groupBy("conv_id", "group").agg(F.array_sort(F.collect_list(F.struct("b", "key"))).alias("items"))
        links = here.select("conv_id", F.explode(_chain(F.col("items"), F.col("group"), lambda x: x["key"])).alias("x"))
        rounds.append(K.stored(links.select("conv_id", "x.item.b", "x.link.before", "x.link.after")))
        at_end = rounds[-1].where(F.col("b") == b + width - 1).select("conv_id", F.col("after").alias("group"))
        groups = at_end.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        b, width = b + width, min(2 * width, WIDEST_ROUND)
        active = K.stored(K.spread_join(at_end, groups.withColumn("more", F.lit(True)), "group").where("more").select("conv_id", "group"))
        if active.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def _units(blocks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """(m, unit, d1, d2): the member rows of every unit, the root among them (step 3)."""
    links = _rounds(blocks, convs)
    kinds = K.stored(links.groupBy("before", "after").agg(F.count("*").alias("n")))
    fans = kinds.groupBy("before").agg(F.count("*").alias("n")).withColumn("splits", F.col("n") > 1)
    kinds = K.stored(K.spread_join(kinds.withColumnRenamed("n", "members"), fans, "before").select("after", "splits", F.col("members").alias("n")))
    member = K.spread_join(links, kinds, "after").join(blocks.select("conv_id", "b", "items"), ["conv_id", "b"])
    low = F.col("b") * block
    whole = member.where("not splits").select(F.col("conv_id").alias("m"), F.col("after").alias("unit"), (low + 1).alias("d1"), (low + F.size("items")).alias("d2"))
    inside = member.where("splits").select("conv_id", low.alias("low"), F.posexplode(_chain(F.col("items"), F.col("before"), lambda x: x["digest"])).alias("j", "x"))
    depth = F.col("low") + F.col("j") + 1
    inside = inside.select(F.col("conv_id").alias("m"), F.col("x.link.after").alias("unit"), depth.alias("d1"), depth.alias("d2"))
    root = convs.select(F.col("conv_id").alias("m"), F.lit(ROOT).alias("unit"), F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"))
    return K.stored(whole.unionByName(inside).unionByName(root))


def _end_digests(batches):
    """SHA-256 of the joined ids of each node; pieces come in order, so one piece is in memory at a time."""
    now, sha = None, None

    def closed(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        done = []
        for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (conv, depth) == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((*now, sha.hexdigest()))
            now, sha = (conv, depth), hashlib.sha256(ids.encode())
        if done:
            yield closed(done)
    if now is not None:
        yield closed([(*now, sha.hexdigest())])


@settled
def trie(conversations: DataFrame, step: int = 5, heads: int = 9, block: int = BLOCK) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``step`` and ``heads`` say how conversations are rebuilt (see ``rebuilt``); ``block`` is the length of a block in turns.
    """
    turns, convs = rebuilt(digested(conversations), step, heads)
    at = F.col("place") - 1
    blocks = turns.groupBy("conv_id", F.floor(at / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("items"))
    blocks = K.stored(blocks.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("items", lambda x: F.hex(x["digest"])), "").cast("binary"), 256))))
    rows = _units(blocks, convs, block)
    units = K.stored(rows.groupBy("unit", "d1", "d2").agg(F.min("m").alias("rep"), F.count("*").alias("n")))
    named = K.stored(K.spread_join(rows, units.select("unit", "rep", "n"), "unit").select("m", "unit", "d1", "d2", "rep"))

    # where each conversation leaves the shared part, and its own branch after that
    last = named.groupBy("m").agg(F.max("d2").alias("last"), F.max_by("rep", "d2").alias("last_rep"))
    last = K.stored(last.withColumnRenamed("m", "conv_id").join(convs, "conv_id"))
    tail = K.spread_join(turns.select("conv_id", "place"), last.select("conv_id", "last", "last_rep", F.col("n_turns").alias("n")), "conv_id").where("place > last")
    tail = tail.select("conv_id", F.col("place").alias("depth"), F.when(F.col("place") == F.col("last") + 1, F.col("last_rep")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                       F.lit(1).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("value"), F.lit(None).cast("binary").alias("unit"))

    up = named.select(F.col("m").alias("rep"), (F.col("d2") + 1).alias("d1"), F.col("rep").alias("up"))
    shared = units.join(up, ["rep", "d1"], "left").withColumn("depth", F.explode(F.sequence("d1", "d2")))
    sizes = turns.select(F.col("conv_id").alias("rep"), F.col("place").alias("depth"), "bytes")
    shared = shared.join(sizes, ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("d1"), F.col("up")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.coalesce("bytes", F.lit(0))).alias("value"), "unit")
    nodes = K.stored(shared.unionByName(tail))

    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = K.stored(nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    chain = nodes.groupBy(F.col("conv_id").alias("m")).agg(F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaf"), F.sum("value").alias("worth"))
    members = named.join(chain, "m", "left").groupBy("unit").agg(
        F.sum("leaf").alias("leaves"), F.sum(F.when(F.col("m") != F.col("rep"), F.col("worth"))).alias("others"))
    below = F.sum("value").over(Window.partitionBy("conv_id").orderBy(F.desc("depth")))
    inner = nodes.where("unit is not null").withColumn("own", below).join(members, "unit", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("others", F.lit(0)) + F.col("own")).alias("saved_tokens"))
    outer = nodes.where("unit is null").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.lit(1).cast("bigint").alias("n_leaves"), F.col("value").alias("saved_tokens"))

    # members that end inside the shared part, in pieces of ids
    ends = named.join(convs.withColumnRenamed("conv_id", "m"), "m").where("d2 = n_turns")
    pieces = ends.groupBy("rep", "d2", F.shiftright("m", ID_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x.cast("string")), ",").alias("ids"))
    pieces = pieces.repartition("rep", "d2").sortWithinPartitions("rep", "d2", "piece").select("rep", "d2", "ids")
    ended = pieces.mapInArrow(_end_digests, "conv_id bigint, depth bigint, ends_sha256 string")
    inner = inner.join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    outer = outer.withColumn("ends_sha256", F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA)))
    return inner.unionByName(outer)
