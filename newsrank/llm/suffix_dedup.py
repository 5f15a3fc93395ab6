"""Removal of long repeated substrings by blockwise suffix sorting with a difference cover.

1. Cover sample. In each text, positions whose residue lies in a difference cover D of period v are
   sampled, and each is named by its following ``length - v + 1`` bytes. Two equal strings of
   ``length`` bytes, wherever they start, hold an aligned pair of sampled positions with equal names.
   The names are sorted one name bucket at a time; those that occur once get no rank.
2. Candidate suffixes. A suffix can share its first ``length`` bytes with another one only when a
   ranked cover position lies in its first v bytes. All other suffixes are settled as unique here: no
   tie is ever followed beyond the cover.
3. Buckets. Candidate suffixes are dealt into buckets by the smallest k-gram of their first ``length``
   bytes, so that neighbours stay together; one bucket at a time is sorted by (k-gram, prefix name) and
   each suffix that ties with another one is a repeat. A bucket is sized from the number of
   candidates, so memory is bounded at every input size. Equal (k-gram, name) entries of one map chunk
   travel once.
4. Each text takes the union of [p, p + length) over its repeated suffixes p.

Exact copies of a text are one class: all but one leave before step 3, and the remaining one is sorted
for the others' sake. Texts travel by joins on their digest; nothing is collected.

Null text is empty; null doc_id is an ordinary value; extra columns are ignored by ``repeated_spans``
and kept by ``drop_repeats``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrank.session import settled

from . import kernels as K

GRAM = 16
#: Names of the cover sample in a bucket, and candidate suffixes in a bucket, on average.
SEED_BUCKET = 2 << 20
SUFFIX_BUCKET = 3 << 20
#: Entries of a bucket that are sorted at a time.
SLICE = 1 << 18
MASK40 = np.uint64((1 << 40) - 1)


def singer_cover(q: int) -> np.ndarray:
    """A perfect difference set of q + 1 residues modulo q*q + q + 1 (q prime), by powers in GF(q^3)."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, seen = (0, 1, 0), []
                for i in range(1, v + 1):
                    if x[2] == 0:
                        seen.append(i % v)
                    if i < v and x[1] == x[2] == 0:
                        break
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                else:
                    d = np.array(sorted(set(seen)))
                    if len(d) == q + 1 and len(np.unique((d[:, None] - d) % v)) == v:
                        return d
    raise ValueError(f"no difference set for {q}")


def _pack(a: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False).astype(np.int64)


def _seed_blobs(length: int, period: int, cover: np.ndarray, buckets: int):
    """Map side of step 1: (bucket, docs, counts, names, positions) packed per chunk."""
    width = length - period + 1

    def run(batches):
        codes = K.byte_codes(0, lower=False)
        for batch in batches:
            keys = _keys(batch)
            for a, b, data, offs in K.text_chunks(batch):
                size = offs[1:] - offs[:-1]
                _, first = np.unique(keys[a:b], return_index=True)
                keep = np.zeros(b - a, bool)
                keep[first] = True
                rows = np.flatnonzero((size >= length) & keep)
                if not len(rows):
                    continue
                longest = int(size[rows].max())
                grid = (np.arange(longest // period + 1)[:, None] * period + cover).ravel()
                count = np.searchsorted(grid, size[rows] - width, side="right")
                at = grid[K.ragged(np.zeros(len(rows), np.int64), count)]
                start = at + np.repeat(offs[:-1][rows], count)
                sums = K.prefix_sums(data, codes)
                name = K.span_hash(sums, start, start + width)
                bucket = ((name >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                doc = np.repeat(np.arange(len(rows)), count)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for k in range(buckets):
                    part = order[edges[k]:edges[k + 1]]
                    if not len(part):
                        continue
                    docs, n = np.unique(doc[part], return_counts=True)
                    low = (name[part] & MASK40).view(np.uint8).reshape(-1, 8)[:, :5]
                    out.append((k, _pack(keys[a:b][rows[docs]], "<i8"), _pack(n, "<u4"), _pack(low, "u1"), _pack(at[part], "<u4")))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOB_TYPES)], BLOB_NAMES)
    return run


BLOB_NAMES = ["bucket", "docs", "counts", "names", "spots"]
BLOB_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
BLOBS = "bucket bigint, docs binary, counts binary, names binary, spots binary"


def _by_bucket(batches):
    """Rows of a partition sorted by bucket, one bucket at a time."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != now:
                yield now, held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, held


def _slices(entries: int, by: np.ndarray):
    """Positions in ``by`` in slices of about ``SLICE`` of the ``entries`` they stand for; equal values share a slice."""
    parts = min(-(-entries // SLICE), 1 << 8)
    part = (K.mix(by.astype(np.uint64)) >> np.uint64(32)) % np.uint64(max(parts, 1))
    for k in range(parts):
        if len(at := np.flatnonzero(part == k) if parts > 1 else np.arange(len(by))):
            yield at


def _spans_batch(key: np.ndarray, a: np.ndarray, b: np.ndarray):
    """One row a text: its spans [a, b) packed; the input is sorted by (key, a)."""
    docs, first = np.unique(key, return_index=True)
    ends = np.append(first[1:], len(key))
    pack = np.stack([a, b], axis=1).astype("<u4")
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([pack[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())],
                                      ["key", "spans"])


def _runs(key: np.ndarray, spot: np.ndarray, reach: int):
    """Sorted (key, spot) as maximal spans in which neighbours are at most ``reach`` apart."""
    order = np.lexsort((spot, key))
    key, spot = key[order], spot[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (spot[1:] - spot[:-1] > reach)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], spot[first], spot[last]


def _seed_ranks(period: int):
    """Reduce side of step 1: candidate suffix ranges of each text, for the ranked names of one bucket."""
    def run(batches):
        for _, rows in _by_bucket(batches):
            cat = lambda f, kind: np.concatenate([np.frombuffer(r[f], kind) for r in rows])
            low, spot = cat("names", np.uint8).reshape(-1, 5), cat("spots", "<u4")
            keys, count = cat("docs", "<i8"), cat("counts", "<u4")
            doc = np.repeat(np.arange(len(keys), dtype=np.uint32), count)
            rows.clear()
            ranked = np.zeros(len(low), bool)
            for at in _slices(len(low), low[:, :4].copy().view("<u4").ravel()):
                name = np.zeros((len(at), 8), np.uint8)
                name[:, :5] = low[at]
                name = name.view(np.uint64).ravel()
                order = np.argsort(name, kind="stable")
                s = name[order]
                edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                size = np.diff(np.append(edge, len(s)))
                # a name is ranked when two of its entries differ in text or place; copies of a text agree in both
                tag = (K.mix(keys[doc[at]].view(np.uint64)) + spot[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[order]
                alike = np.minimum.reduceat(tag, edge) == np.maximum.reduceat(tag, edge)
                ranked[at[order[np.repeat(~alike, size)]]] = True
            ranked = np.flatnonzero(ranked)
            for at in _slices(len(ranked), keys[doc[ranked]]):
                k, a, b = _runs(keys[doc[ranked[at]]], spot[ranked[at]].astype(np.int64), period)
                yield _spans_batch(k, np.maximum(a - period + 1, 0), b + 1)
    return run


def _union(spans: list[bytes], top: int) -> np.ndarray:
    """Packed spans as sorted disjoint (start, end) rows within [0, top)."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    s = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in spans]).astype(np.int64)
    s = np.minimum(s, top)
    s = s[s[:, 0] < s[:, 1]]
    if not len(s):
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.append(True, s[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], reach[np.append(first[1:], len(s)) - 1]], axis=1)


def _zones(length: int):
    """Step 2: texts with candidate suffixes keep text and ranges; all others are settled."""
    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            text, zone, n_zone = [], [], []
            for t, n, spans, lead in zip(cols["text"], cols["n_bytes"], cols["spans"], cols["lead"]):
                z = _union(spans, n - length + 1) if lead and spans else np.zeros((0, 2), np.int64)
                text.append(t if len(z) else None)
                zone.append(_pack(z, "<u4") if len(z) else None)
                n_zone.append(int((z[:, 1] - z[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest", "n_bytes", "copies")]
                + [pa.array(text, pa.string()), pa.array(zone, pa.binary()), pa.array(n_zone, pa.int64())],
                ["doc_id", "digest", "n_bytes", "copies", "text", "zone", "n_zone"])
    return run


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]) by doubling."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (width - step)], x[width - step:]) if width > step else x


def _suffix_blobs(length: int, buckets: int):
    """Map side of step 3: runs of neighbouring candidate suffixes that share their smallest k-gram."""
    def run(batches):
        codes = K.byte_codes(0, lower=False)
        for batch in batches:
            keys = _keys(batch)
            zones = batch.column(batch.schema.get_field_index("zone"))
            for a, b, data, offs in K.text_chunks(batch):
                sums = K.prefix_sums(data, codes)
                each = [np.frombuffer(zones[i].as_py(), "<u4").reshape(-1, 2).astype(np.int64) for i in range(a, b)]
                doc = np.repeat(np.arange(b - a), [len(z) for z in each])
                z = np.concatenate(each)
                count = z[:, 1] - z[:, 0]
                doc = np.repeat(doc, count)
                spot = K.ragged(z[:, 0], count)
                start = spot + offs[:-1][doc]
                name = K.span_hash(sums, start, start + length)
                n = len(data)
                gram = K.mix(K.span_hash(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
                least = _sliding_min(gram, length - GRAM + 1)[start]
                del gram
                # equal entries of this chunk travel once; the others are known repeats
                order = np.lexsort((name, least))
                same = np.zeros(len(order), bool)
                same[1:] = (name[order[1:]] == name[order[:-1]]) & (least[order[1:]] == least[order[:-1]])
                known = np.zeros(len(order), bool)
                known[order[same]] = True
                lead = order[:-1][same[1:]]
                repeat = known.copy()
                repeat[lead] = True
                if repeat.any():
                    k, s, e = _runs(doc[repeat], spot[repeat], 1)
                    real = keys[a:b][k]
                    by = np.lexsort((s, real))
                    got = _spans_batch(real[by], s[by], e[by] + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - (got.column(0).to_numpy() & 0x3FFFFFFF), pa.int64()), pa.array([_pack([x], "<i8") for x in got.column(0).to_pylist()], pa.binary()),
                                                      pa.nulls(len(got), pa.binary()), pa.nulls(len(got), pa.binary()), got.column(1)], BLOB_NAMES)
                sent = np.flatnonzero(~known)
                doc, spot, name, least = doc[sent], spot[sent], name[sent], least[sent]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1] + 1) | (least[1:] != least[:-1])
                first = np.flatnonzero(new)
                run_n = np.diff(np.append(first, len(doc)))
                bucket = (K.mix(least[first]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for i in range(buckets):
                    part = order[edges[i]:edges[i + 1]]
                    if len(part):
                        out.append((i, _pack(keys[a:b][doc[first[part]]], "<i8"), _pack(np.stack([spot[first[part]], run_n[part]]), "<u4"),
                                    _pack(name[K.ragged(first[part], run_n[part])], "<u8"), _pack(least[first[part]], "<u8")))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOB_TYPES)], BLOB_NAMES)
    return run


def _suffix_ties(batches):
    """Reduce side of step 3: sort one bucket, return its repeated suffixes as spans of start positions."""
    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(r["docs"], "<i8")[0]) for r in rows], pa.int64()),
                                              pa.array([r["spots"] for r in rows], pa.binary())], ["key", "spans"])
            continue
        key, spot, count, least, name = [], [], [], [], []
        for r in rows:
            s = np.frombuffer(r["counts"], "<u4").reshape(2, -1).astype(np.int64)
            key.append(np.frombuffer(r["docs"], "<i8"))
            spot.append(s[0])
            count.append(s[1])
            least.append(np.frombuffer(r["spots"], "<u8"))
            name.append(np.frombuffer(r["names"], "<u8"))
        key, spot, count, least, name = map(np.concatenate, (key, spot, count, least, name))
        rows.clear()
        before = np.cumsum(count) - count
        hit = np.zeros(len(name), bool)
        for runs in _slices(len(name), least):
            # the k-gram decides first: its order in this slice, then the prefix name
            gram = np.repeat(np.unique(least[runs], return_inverse=True)[1], count[runs])
            at = K.ragged(before[runs], count[runs])
            order = np.lexsort((name[at], gram))
            at, gram = at[order], gram[order]
            tie = (name[at[1:]] == name[at[:-1]]) & (gram[1:] == gram[:-1])
            hit[at[1:][tie]] = True
            hit[at[:-1][tie]] = True
        # hits of a run as spans of neighbours, joined by text
        hit = np.flatnonzero(hit)
        for at in _slices(len(hit), key[run := np.searchsorted(before, hit, side="right") - 1]):
            k, s, e = _runs(key[run[at]], spot[run[at]] + hit[at] - before[run[at]], 1)
            yield _spans_batch(k, s, e + 1)


def _settle(length: int):
    """Step 4: the removed runs of each text and what is left."""
    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            spans, removed, n_spans, digest = [], [], [], []
            for t, n, got, copies, own in zip(cols["text"], cols["n_bytes"], cols["spans"], cols["copies"], cols["digest"]):
                if copies > 1 and n >= length:
                    cut = np.array([[0, n]])
                elif got:
                    starts = _union(got, n)
                    cut = _union([_pack(np.stack([starts[:, 0], starts[:, 1] + length - 1], axis=1), "<u4")], n)
                else:
                    cut = np.zeros((0, 2), np.int64)
                if len(cut) and t is not None and copies == 1:
                    raw, at, h = t.encode(), 0, hashlib.sha256()
                    for s, e in cut.tolist():
                        h.update(raw[at:s])
                        at = e
                    h.update(raw[at:])
                    digest.append(h.hexdigest())
                else:
                    digest.append(hashlib.sha256(b"").hexdigest() if len(cut) else own.hex())
                spans.append(cut.tolist())
                removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                n_spans.append(len(cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_bytes")),
                 pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 batch.column(batch.schema.get_field_index("digest"))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "digest"])
    return run


@settled
def repeated_spans(docs: DataFrame, length: int = 400, cover_order: int = 13, seed_bucket: int = SEED_BUCKET,
                   suffix_bucket: int = SUFFIX_BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, digest) for every row.

    ``spans`` are the maximal removed byte runs. ``cover_order`` is the prime q of the difference cover
    modulo q*q + q + 1, which must be below ``length``.
    """
    cover = singer_cover(cover_order)
    period = cover_order * cover_order + cover_order + 1
    if period > length - GRAM:
        raise ValueError("the cover's period must be shorter than the repeated string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn("key", F.xxhash64("digest"))

    classes = K.stored(rows.groupBy("digest", "key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("n_bytes").alias("n_bytes")))
    total = classes.agg(F.sum("n_bytes")).first()[0] or 0
    # the sample of a short cover is denser: what a task holds follows the names, not the bytes
    buckets = total * len(cover) // period // seed_bucket + 1

    seeds = rows.select("key", "text").mapInArrow(_seed_blobs(length, period, cover, buckets), BLOBS)
    ranked = K.stored(seeds.repartition(buckets, "bucket").sortWithinPartitions("bucket")
                      .mapInArrow(_seed_ranks(period), "key bigint, spans binary")
                      .groupBy("key").agg(F.collect_list("spans").alias("spans")))
    plan = classes.join(ranked, "key", "left").select("digest", "copies", "first", "spans")
    joined = rows.join(plan, "digest").withColumn("lead", F.col("doc_id").eqNullSafe(F.col("first")))
    joined = joined.select("doc_id", "digest", "n_bytes", "copies", "text", "lead", F.when(F.col("lead"), F.col("spans")).alias("spans"))
    work = K.stored(joined.mapInArrow(_zones(length), "doc_id bigint, digest binary, n_bytes bigint, copies bigint, text string, zone binary, n_zone bigint"))

    candidates = work.agg(F.sum("n_zone")).first()[0] or 0
    buckets = candidates // suffix_bucket + 1
    zoned = work.where("zone is not null")
    names = zoned.select(F.xxhash64("digest").alias("key"), "text", "zone").mapInArrow(_suffix_blobs(length, buckets), BLOBS)
    ties = K.stored(names.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_suffix_ties, "key bigint, spans binary")
                    .groupBy("key").agg(F.collect_list("spans").alias("spans")))
    single = zoned.where("copies = 1").withColumn("key", F.xxhash64("digest")).join(ties, "key", "left")
    rest = work.where("zone is null or copies > 1").withColumn("spans", F.lit(None).cast("array<binary>"))
    cols = ["doc_id", "digest", "n_bytes", "copies", "text", "spans"]
    rest = rest.withColumn("text", F.lit(None).cast("string"))
    return (single.select(cols).unionByName(rest.select(cols))
            .mapInArrow(_settle(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, digest binary"))


def _cut_text(batches):
    for batch in batches:
        cols = batch.to_pydict()
        out = []
        for t, spans in zip(cols["text"], cols["spans"]):
            if spans:
                raw, at, kept = t.encode(), 0, []
                for s, e in spans:
                    while s < len(raw) and raw[s] & 0xC0 == 0x80:   # a character that is cut on the left stays whole
                        s += 1
                    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(raw[at:s])
                    at = max(at, e, s)
                kept.append(raw[at:])
                t = b"".join(kept).decode()
            out.append(t)
        i = batch.schema.get_field_index("text")
        keep = [c for c in batch.schema.names if c != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in keep], keep)
        del i


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the repeated runs (characters cut at a run's edge stay whole).

    Every text keeps its row; a text without repeats is left as it is, and a null text stays null.
    """
    found = repeated_spans(docs, **options).where("n_removed > 0").select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))
    found = found.groupBy("__digest").agg(F.first("__spans").alias("__spans"))
    keyed = docs.withColumn("__digest", F.unhex(F.sha2("text", 256)))
    joined = keyed.join(found, "__digest", "left").drop("__digest").withColumnRenamed("__spans", "spans")
    return joined.mapInArrow(_cut_text, docs.schema)
