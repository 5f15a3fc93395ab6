"""Removal of repeated word runs by recompression.

1. Parsing. Each document is a sequence of words. A level first turns every maximal run of one symbol into a symbol, then
   every neighbouring pair whose left half is drawn "left" and whose right half is drawn "right" by a coin that only the
   symbol decides. A name is a hash of what it stands for (symbol and count, or two symbols), so that all tasks give the
   same run or pair the same global name without exchanging a dictionary.
2. Interiors. What a level makes of a window depends on its surroundings only at its ends: the first and last run may go on
   outside, the first symbol may be the right half of a pair and the last one the left half. Taking these off leaves the
   window's *interior*, the same symbols wherever the window stands.
3. First Spark round. Of each interior the least run of ``gram`` successive top-level symbols is sent (neighbouring windows
   mostly share it); where an interior is shorter, as in a run of one word, the window itself stands for it. Names are dealt
   into buckets; a bucket says which names occur at two places. Windows whose name occurs once are unique and settled.
4. Second Spark round. The windows left are verified by 96 bits over their words, not over symbols: dealt into buckets again, every
   place of a window but the first is a removal. A chunk of text sends each window once; its other places are known then.

Each document takes the union of its removed windows. Exact copies of a text are one class: only the rows of its smallest
doc_id are searched, all others are removed as a whole (if they have a window at all). Buckets are sized by the number of
names, so memory is bounded at every input size; a window that stands in every chunk of text costs 20 bytes a chunk.

Null text has no words. "Earlier" is a smaller (doc_id, start): null ids come after all others and are equal among
themselves, as are repeated rows; of equal places neither is earlier, so both stay. Documents shorter than a window, empty
ones and an empty table lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrank.session import settled

from . import kernels as K
from .suffix_dedup import _by_bucket, _pack, _runs, _spans_batch, _union

WINDOW = 20
LEVELS = 2
GRAM = 4
NAME_BUCKET = 1 << 19
WINDOW_BUCKET = 1 << 18
ROWS = 512          # documents whose Python strings a task holds at a time
CHUNK = K.CHUNK_BYTES
LAST = np.iinfo(np.int64).max
_U = np.uint64
_ODD = _U(0xD6E8FEB86659FD93)
NAMES = "bucket bigint, docs binary, counts binary, names binary, spots binary"
NAME_COLUMNS = ["bucket", "docs", "counts", "names", "spots"]
PLACES = "bucket bigint, docs binary, orders binary, counts binary, names binary, spots binary"
PLACE_COLUMNS = ["bucket", "docs", "orders", "counts", "names", "spots"]


REPLY = "bucket bigint, docs binary, spans binary"
REPLY_COLUMNS = ["bucket", "docs", "spans"]


def _reply(key: np.ndarray, a: np.ndarray, b: np.ndarray, shards: int) -> list[tuple]:
    """Spans [a, b) of documents for the shards that gather them: one row for each shard, whatever the documents."""
    shard = (K.mix(key.view(_U)) % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    out = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = order[edges[k]:edges[k + 1]]
        out.append((k, _pack(key[part], "<i8"), _pack(np.stack([a[part], b[part]], axis=1), "<u4")))
    return out


def _gather(batches):
    """One row a document: all its spans, from the replies of one shard."""
    for _, rows in _by_bucket(batches):
        key = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])
        spans = np.concatenate([np.frombuffer(r["spans"], "<u4").reshape(-1, 2) for r in rows])
        order = np.lexsort((spans[:, 0], key))
        yield _spans_batch(key[order], spans[order, 0], spans[order, 1])


def _gathered(replies: DataFrame, shards: int) -> DataFrame:
    return K.stored(replies.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "key bigint, spans binary"))


def _blobs(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], columns)


def interiors(words: np.ndarray, at: np.ndarray, window: np.ndarray, size: int, levels: int = LEVELS):
    """Top-level symbols of the documents that start at ``at``, and the interior [lo, hi) of each window in them.

    ``window`` holds the first words of the windows, each ``size`` words long and inside one document; where lo >= hi the
    interior is empty.
    """
    x, head = K.mix(words), np.zeros(len(words) + 1, bool)
    head[at] = True
    head = head[:-1]
    lo, hi = window.copy(), window + size
    for level in range(levels):
        first = np.append(True, x[1:] != x[:-1])[:len(x)] | head
        run, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        count = np.diff(np.append(begin, len(x)))
        live = lo < hi
        lo, hi = run[np.where(live, lo, 0)] + 1, run[np.where(live, hi - 1, 0)]
        x, head = np.where(count > 1, K.mix(x[begin] * _U(3) + count.astype(_U)), x[begin]), head[begin]
        right = ((K.mix(x + _U(77 + level)) >> _U(17)) & _U(1)).astype(bool)
        pair = np.zeros(len(x), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~head[1:]
        keep = ~np.append(False, pair[:-1])
        index = np.cumsum(keep) - 1
        live &= lo < hi
        lo, hi = np.where(live, lo, 0), np.where(live, hi - 1, 0)
        lo, hi = lo + right[lo], hi - ~right[hi]
        live &= lo <= hi
        lo, hi = np.where(live, index[np.minimum(lo, len(x) - 1)], 0), np.where(live, index[np.maximum(hi, 0)] + 1, 0)
        both = K.mix(K.mix(x + _U(level + 1)) * _ODD ^ np.append(x[1:], _U(0)))
        x, head = np.where(pair, both, x)[keep], head[keep]
    return x, lo, hi


def _least(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each nonempty range [lo, hi), the first place of its least value."""
    width = int((hi - lo).max(initial=1))
    tables = [np.arange(len(value))]
    while 2 << (len(tables) - 1) <= width:
        t, half = tables[-1], 1 << (len(tables) - 1)
        other = t[np.minimum(np.arange(len(t)) + half, len(t) - 1)]
        tables.append(np.where(value[other] < value[t], other, t))
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k, t in enumerate(tables):
        of = np.flatnonzero(level == k)
        a, b = t[lo[of]], t[hi[of] - (1 << k)]
        out[of] = np.where(value[b] < value[a], b, a)
    return out


def _sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums for hashes over spans of words (or symbols)."""
    out = np.zeros(len(words) + 1, _U)
    np.cumsum(words * K.POWERS.upto(len(words) + 1)[0][:len(words)], out=out[1:])
    return out


def names_of(words: np.ndarray, at: np.ndarray, window: np.ndarray, size: int, levels: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The name that stands for each window, and the place of what is named (equal for neighbours that share it)."""
    x, lo, hi = interiors(words, at, window, size, levels)
    deep = hi - lo >= gram
    name = np.empty(len(window), _U)
    place = len(x) + window                                     # a window that stands for itself
    if deep.any():
        sums = _sums(x)
        spots = np.arange(len(x) - gram + 1)
        value = K.span_hash(sums, spots, spots + gram)
        place[deep] = _least(value, lo[deep], hi[deep] - gram + 1)
        name[deep] = value[place[deep]]
    flat = np.flatnonzero(~deep)
    if len(flat):
        name[flat] = K.mix(K.span_hash(_sums(K.mix(words + _U(5))), window[flat], window[flat] + size))
    return name, place


def _windows(at: np.ndarray, size: int) -> np.ndarray:
    return K.ragged(at[:-1], np.maximum(np.diff(at) - size + 1, 0))


def _words(data: np.ndarray, offs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = K.word_spans(data, offs, K.SPACED)
    return (K.span_hash(K.prefix_sums(data, codes), starts, ends) if len(starts) else np.zeros(0, _U)), at


def _send_names(size: int, levels: int, gram: int, buckets: int):
    """Map side of step 3: for each bucket the names of a chunk, each with its document, first window and number of windows."""
    def run(batches):
        codes = K.byte_codes(0, lower=False)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offs in K.text_chunks(batch, limit=CHUNK):
                words, at = _words(data, offs, codes)
                window = _windows(at, size)
                if not len(window):
                    continue
                name, place = names_of(words, at, window, size, levels, gram)
                doc = np.searchsorted(at, window, side="right") - 1
                first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
                count = np.diff(np.append(first, len(window)))
                name, doc, spot = name[first], doc[first], window[first] - at[doc[first]]
                bucket = ((name >> _U(40)) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    part = order[edges[k]:edges[k + 1]]
                    docs, n = np.unique(doc[part], return_counts=True)
                    low = (name[part] & _U((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
                    out.append((k, _pack(keys[a:b][docs], "<i8"), _pack(n, "<u4"), _pack(low, "u1"), _pack(np.stack([spot[part], count[part]]), "<u4")))
                yield _blobs(out, NAME_COLUMNS)
    return run


def _shared_names(shards: int):
    """Reduce side of step 3: the windows of the names that occur at two places of one bucket, one bucket at a time."""
    def run(batches):
        for _, rows in _by_bucket(batches):
            low = np.concatenate([np.frombuffer(r["names"], np.uint8) for r in rows]).reshape(-1, 5)
            name = np.zeros((len(low), 8), np.uint8)
            name[:, :5] = low
            name = name.view(_U).ravel()
            key = np.repeat(np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows]), np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]))
            spot, count = np.concatenate([np.frombuffer(r["spots"], "<u4").reshape(2, -1) for r in rows], axis=1).astype(np.int64)
            order = np.argsort(name, kind="stable")
            s = name[order]
            edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            tag = (K.mix(key.view(_U)) + spot.astype(_U) * _ODD)[order]
            once = np.minimum.reduceat(tag, edge) == np.maximum.reduceat(tag, edge)          # copies of a text agree in both
            got = order[np.repeat(~once, np.diff(np.append(edge, len(s))))]
            if len(got):
                yield _blobs(_reply(key[got], spot[got], spot[got] + count[got], shards), REPLY_COLUMNS)
    return run


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _settle_unique(size: int):
    """End of step 3: documents with open windows keep text and windows; the others get their result."""
    def run(batches):
        for batch in _slices(batches):
            cols = batch.to_pydict()
            out = {c: [] for c in ("zone", "n_zone", "n_words", "n_removed", "kept")}
            for t, spans, lead in zip(cols["text"], cols["spans"], cols["lead"]):
                raw = (t or "").encode().split()
                zone = _union([spans], LAST) if lead and spans else None
                gone = len(raw) if not lead and len(raw) >= size else 0
                out["zone"].append(None if zone is None else _pack(zone, "<u4"))
                out["n_zone"].append(0 if zone is None else int((zone[:, 1] - zone[:, 0]).sum()))
                out["n_words"].append(len(raw))
                out["n_removed"].append(gone)
                out["kept"].append(None if zone is not None else "" if gone else b" ".join(raw).decode())
            keep = ["doc_id", "key"]
            text = pa.array([None if z is None else t for t, z in zip(cols["text"], out["zone"])], pa.string())
            kinds = {"zone": pa.binary(), "kept": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [text] + [pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()],
                                             keep + ["text", *out])
    return run


def _send_windows(size: int, buckets: int):
    """Map side of step 4: every open window of a chunk once, with its first place; later places are removals (bucket -1)."""
    def run(batches):
        codes, second = K.byte_codes(0, lower=False), K.byte_codes(9, lower=False)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            zones = batch.column(batch.schema.get_field_index("zone"))
            for a, b, data, offs in K.text_chunks(batch, limit=CHUNK):
                words, at = _words(data, offs, codes)
                twin, _ = _words(data, offs, second)
                each = [np.frombuffer(zones[i].as_py(), "<u4").reshape(-1, 2).astype(np.int64) for i in range(a, b)]
                doc = np.repeat(np.arange(b - a), [len(z) for z in each])
                z = np.concatenate(each)
                doc, spot = np.repeat(doc, z[:, 1] - z[:, 0]), K.ragged(z[:, 0], z[:, 1] - z[:, 0])
                start = at[doc] + spot
                name = K.span_hash(_sums(K.mix(words)), start, start + size)
                check = K.mix(K.span_hash(_sums(K.mix(twin + _U(3))), start, start + size)) >> _U(32)
                order = np.lexsort((spot, ids[a:b][doc], check, name))
                doc, spot, name, check = doc[order], spot[order], name[order], check[order]
                same = np.append(False, (name[1:] == name[:-1]) & (check[1:] == check[:-1]))
                # a place that equals its group's first one in id and start is not later than it
                group = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                later = same & ((ids[a:b][doc] != ids[a:b][doc[group]]) | (spot != spot[group]))
                out = []
                if later.any():
                    k, s, e = _runs(keys[a:b][doc[later]], spot[later], 1)
                    out += [(-1 - shard, docs, None, None, None, spans) for shard, docs, spans in _reply(k, s, e + 1, buckets)]
                sent = np.flatnonzero(~later)
                bucket = ((name[sent] >> _U(8)) % _U(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    part = sent[by[edges[k]:edges[k + 1]]]
                    part = part[np.argsort(doc[part], kind="stable")]
                    docs, n = np.unique(doc[part], return_counts=True)
                    both = _pack(name[part], "<u8") + _pack(check[part], "<u4")
                    out.append((k, _pack(keys[a:b][docs], "<i8"), _pack(ids[a:b][docs], "<i8"), _pack(n, "<u4"), both, _pack(spot[part], "<u4")))
                if out:
                    yield _blobs(out, PLACE_COLUMNS)
    return run


def _later_windows(shards: int):
    """Reduce side of step 4: all places of a window but the first, as spans of window starts, one bucket at a time."""
    def run(batches):
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                yield _blobs([(-1 - bucket, r["docs"], r["spots"]) for r in rows], REPLY_COLUMNS)
                continue
            count = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
            key = np.repeat(np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows]), count)
            doc = np.repeat(np.concatenate([np.frombuffer(r["orders"], "<i8") for r in rows]), count)
            spot = np.concatenate([np.frombuffer(r["spots"], "<u4") for r in rows]).astype(np.int64)
            name = np.concatenate([np.frombuffer(r["names"], "<u8", len(r["names"]) // 12) for r in rows])
            check = np.concatenate([np.frombuffer(r["names"], "<u4", len(r["names"]) // 12, len(r["names"]) // 12 * 8) for r in rows])
            order = np.lexsort((spot, doc, check, name))
            key, doc, spot, name, check = key[order], doc[order], spot[order], name[order], check[order]
            same = np.append(False, (name[1:] == name[:-1]) & (check[1:] == check[:-1]))
            group = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            later = same & ((doc != doc[group]) | (spot != spot[group]))
            if later.any():
                k, s, e = _runs(key[later], spot[later], 1)
                yield _blobs(_reply(k, s, e + 1, shards), REPLY_COLUMNS)
    return run


def _settle(size: int):
    """What is left of the documents that had open windows."""
    def run(batches):
        for batch in _slices(batches):
            cols = batch.to_pydict()
            removed, kept = [], []
            for t, spans in zip(cols["text"], cols["spans"]):
                raw = t.encode().split()
                cut = _union([spans] if spans else [], LAST)
                gone = np.zeros(len(raw), bool)
                for s, e in cut.tolist():
                    gone[s:e + size - 1] = True
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(raw, gone.tolist()) if not g).decode())
            keep = ["doc_id", "n_words"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             keep + ["n_removed", "kept"])
    return run


@settled
def repeated_runs(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS, gram: int = GRAM, name_bucket: int = NAME_BUCKET,
                  window_bucket: int = WINDOW_BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row; ``kept`` is what is left, words joined by one space."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("key", F.xxhash64("digest"))
    order = F.coalesce("doc_id", F.lit(int(LAST)))
    classes = K.stored(rows.groupBy("digest", "key").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("n_bytes")))
    total = classes.agg(F.sum("n_bytes")).first()[0] or 0

    buckets = total // (20 * name_bucket) + 1                                     # about one name for 20 bytes
    sent = rows.select("key", "text").mapInArrow(_send_names(window, levels, gram, buckets), NAMES)
    shared = _gathered(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_names(buckets), REPLY), buckets)
    plan = classes.join(shared, "key", "left").select("digest", "first", "copies", "spans")
    work = K.spread_join(rows, plan.withColumnRenamed("copies", "n"), "digest").withColumn("lead", order == F.col("first"))
    work = work.select("doc_id", "key", "text", "lead", F.when(F.col("lead"), F.col("spans")).alias("spans"))
    work = K.stored(work.mapInArrow(_settle_unique(window), "doc_id bigint, key bigint, text string, zone binary, n_zone bigint, n_words bigint, n_removed bigint, kept string"))

    open_ = work.where("zone is not null").select("doc_id", "key", "text", "zone", "n_words")
    buckets = (work.agg(F.sum("n_zone")).first()[0] or 0) // window_bucket + 1
    sent = open_.mapInArrow(_send_windows(window, buckets), PLACES)
    later = _gathered(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_later_windows(buckets), REPLY), buckets)
    cut = open_.join(later, "key", "left").select("doc_id", "n_words", "text", "spans").mapInArrow(_settle(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    done = work.where("zone is null").select("doc_id", "n_words", "n_removed", "kept").unionByName(cut)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept")
