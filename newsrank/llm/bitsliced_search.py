"""Ranked lexical search over bit-sliced Bloom signatures.

1. Index. Whole documents are taken in chunks and grouped by how much they hold, so that one signature width suits a
   group. A group's signatures are stored by slices: row r of its bitmap says, for each of its documents (one bit each),
   whether bit r is set. A term sets bits for "at least once", "at least twice", 3, 4, 6, 8, 12, 16, ... times, so that the
   slices bound term frequencies too. The texts lie beside their signatures in the same row, and a chunk's dictionary (terms
   and in how many of its documents each occurs) gives document frequencies without another pass over the texts.
2. Bounds. For each query term the slices of its bits are ANDed: the documents left may hold it, the others do not. The
   highest level that is left bounds its frequency from above, and as the score grows with the frequency, the weighted sum
   over an item's terms is an upper bound of the document's score, in the same integers.
3. Threshold. The documents with the ten highest bounds of each item are scored exactly. The tenth highest of their scores
   is a score that the true tenth reaches at least.
4. Answer. Every document whose bound reaches the threshold of an item is scored exactly from its text, where it lies; all
   others are provably below. A task keeps the ten best of each item, so what is shuffled is ten rows an item and task.

Texts are never shuffled, and no pair of item and document leaves a task except those ten. The items are the stated query
set: they are read in blocks of at most ``query_bytes`` and each block meets the index, so a task's memory is bounded by
a chunk (or one text that alone is longer) and a block. Terms are compared by 64-bit hashes.

Null text has no terms; null doc_id is an ordinary document that comes after all others among equal scores; rows that
repeat are documents of their own, and so are rows of the benchmark. An item without terms, an item that meets nothing, and
an empty table give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsrank.session import settled

from . import kernels as K

INDEX = ("ids array<bigint>, n_terms binary, width int, top int, slices binary, texts array<string>, terms binary, counts binary")
INDEX_NAMES = ["ids", "n_terms", "width", "top", "slices", "texts", "terms", "counts"]
HASHES = 5
BITS = 10
CHUNK = 4 << 20
PAIRS = 8192
LEVELS = np.array(sorted({1, 2, 3} | {v for i in range(2, 31) for v in (1 << i, 3 << (i - 1))}), np.int64)
_U = np.uint64


def _terms(data: np.ndarray, offs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and, for each row, the number of terms before it."""
    starts, ends, at = K.word_spans(data, offs, K.ALNUM)
    return (K.span_hash(K.prefix_sums(data, codes), starts, ends) if len(starts) else np.zeros(0, _U)), at


def _rows_of(term: np.ndarray, level: np.ndarray, width: int) -> np.ndarray:
    """The slices of each (term, level): ``HASHES`` a row."""
    h = K.mix(term + (level.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    step = (h >> _U(32)) | _U(1)
    return (((h & _U(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype=_U)) % _U(width)).astype(np.int64)


def _groups(load: np.ndarray):
    """Rows whose signatures hold about equally much, by powers of two."""
    kind = np.ceil(np.log2(np.maximum(load, 8))).astype(np.int64)
    for k in np.unique(kind[load > 0]):
        yield int(k), np.flatnonzero((kind == k) & (load > 0))


def _build(batches):
    """Index rows of a partition: a chunk at a time, a row for each group of the chunk."""
    codes = K.byte_codes(1)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        text = batch.column(batch.schema.get_field_index("text"))
        for a, b, data, offs in K.text_chunks(batch, limit=CHUNK):
            words, at = _terms(data, offs, codes)
            if not len(words):
                continue
            n = np.diff(at)
            known, code = np.unique(words, return_inverse=True)
            doc = np.repeat(np.arange(b - a), n)
            pair, tf = np.unique(doc * np.int64(len(known)) + code, return_counts=True)
            doc, code = pair // len(known), pair % len(known)
            levels = np.searchsorted(LEVELS, tf, side="right")
            load = np.bincount(doc, weights=levels, minlength=b - a).astype(np.int64)
            out, first = [], True
            for kind, rows in _groups(load):
                width = BITS << kind
                place = np.full(b - a, -1)
                place[rows] = np.arange(len(rows))
                mine = np.flatnonzero(place[doc] >= 0)
                which = np.repeat(mine, levels[mine])
                level = K.ragged(np.zeros(len(mine), np.int64), levels[mine])
                bits = np.zeros((width, len(rows)), bool)
                bits[_rows_of(known[code[which]], level, width), place[doc[which]][:, None]] = True
                at_rows = pa.array(a + rows)
                out.append((ids.take(at_rows).to_pylist(), n[rows].astype("<i8").tobytes(), width, int(levels[mine].max()), np.packbits(bits, axis=1).tobytes(),
                            text.take(at_rows).to_pylist(), known.astype("<u8").tobytes() if first else None,
                            np.bincount(code, minlength=len(known)).astype("<i8").tobytes() if first else None))
                first = False
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], INDEX_NAMES)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: one row (with a number ``uid``) for each group of documents; every document with a term is in one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_build, INDEX)
    return K.stored(rows.withColumn("uid", F.monotonically_increasing_id()))


class Queries:
    """A block of items: their terms, how often each item has them and, once the index is counted, their weights."""

    def __init__(self, texts: list) -> None:
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        words, at = _terms(data, np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), K.byte_codes(1))
        self.vocabulary, code = np.unique(words, return_inverse=True)
        pair, self.times = np.unique(np.repeat(np.arange(len(raw)), np.diff(at)) * np.int64(len(self.vocabulary) or 1) + code, return_counts=True)
        self.item, self.term = pair // (len(self.vocabulary) or 1), pair % (len(self.vocabulary) or 1)
        self.n_docs = self.n_terms = 0
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        for t in range(len(self.vocabulary)):
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def scores(self, tf: np.ndarray, n: np.ndarray):
        """(items, their scores for each document), a bounded number of (item, term) pairs at a time; ``tf`` is term by document."""
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        part = self.weight[:, None] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        start = np.flatnonzero(np.append(True, self.item[1:] != self.item[:-1]))
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + PAIRS, side="right")) - 1) if start[-1] > start[lo] + PAIRS else len(start)
            a, b = start[lo], start[hi] if hi < len(start) else len(self.item)
            yield self.item[start[lo:hi]], np.add.reduceat(part[self.term[a:b]] * self.times[a:b, None], start[lo:hi] - a, axis=0)
            lo = hi

    def most(self, width: int, top: int, slices: bytes, n: np.ndarray) -> np.ndarray:
        """Upper bounds of the frequency of each term in each document of a group, from its slices."""
        d = len(n)
        bitmap = np.frombuffer(slices, np.uint8).reshape(width, -1)
        tf = np.zeros((len(self.vocabulary), d), np.int64)
        live = np.arange(len(self.vocabulary))
        may = np.full((len(live), bitmap.shape[1]), 255, np.uint8)
        for level in range(top):
            may = may & np.bitwise_and.reduce(bitmap[_rows_of(self.vocabulary[live], np.full(len(live), level), width)], axis=1)
            some = may.any(axis=1)
            live, may = live[some], may[some]
            if not len(live):
                break
            has = np.unpackbits(may, axis=1, count=d).astype(bool)
            tf[live] = np.where(has, LEVELS[level + 1] - 1, tf[live])
        return np.minimum(tf, n)

    def exact(self, texts: list) -> np.ndarray:
        """True frequencies of each term in each text."""
        raw = [t.encode() for t in texts]
        words, at = _terms(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), K.byte_codes(1))
        spot = self.find(words)
        doc = np.repeat(np.arange(len(raw)), np.diff(at))
        hit = spot >= 0
        return np.bincount(spot[hit] * len(raw) + doc[hit], minlength=len(self.vocabulary) * len(raw)).reshape(-1, len(raw))


class Best:
    """The ``keep`` best rows of each item seen so far; at most a few hundred thousand rows are held."""

    def __init__(self, keep: int) -> None:
        self.keep, self.parts, self.size = keep, [], 0

    def add(self, item, score, *ties) -> None:
        """Higher scores first, then smaller ties in the order given."""
        if len(item):
            self.parts.append(np.stack([item, -score, *ties]).astype(np.int64))
            self.size += len(item)
            if self.size > 200_000:
                self._prune()

    def _prune(self) -> None:
        rows = np.concatenate(self.parts, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        rank = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.append(first, rows.shape[1])))
        rows = rows[:, rank < self.keep]
        self.parts, self.size = [rows], rows.shape[1]

    def rows(self) -> np.ndarray:
        if self.parts:
            self._prune()
        return self.parts[0] if self.parts else np.zeros((3, 0), np.int64)


def _group_rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}


def _count(queries: Queries):
    """Documents, terms, and documents for each query term, from the dictionaries of the index."""
    def run(batches):
        df, docs, terms = np.zeros(len(queries.vocabulary), np.int64), 0, 0
        for row in _group_rows(batches):
            n = np.frombuffer(row["n_terms"], "<i8")
            docs, terms = docs + len(n), terms + int(n.sum())
            if row["terms"] is not None and len(df):
                spot = queries.find(np.frombuffer(row["terms"], "<u8"))
                df[spot[spot >= 0]] += np.frombuffer(row["counts"], "<i8")[spot >= 0]
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], hit]), pa.int64()), pa.array(np.concatenate([[docs, terms], df[hit]]), pa.int64())], ["term", "n"])
    return run


def _highest(queries: Queries, keep: int):
    """Step 3: the documents of a partition with the highest bounds of each item."""
    def run(batches):
        best = Best(keep)
        for row in _group_rows(batches):
            n = np.frombuffer(row["n_terms"], "<i8")
            for items, bound in queries.scores(queries.most(row["width"], row["top"], row["slices"], n), n):
                few = min(keep, len(n))
                spot = np.argpartition(-bound, few - 1, axis=1)[:, :few]
                score = np.take_along_axis(bound, spot, axis=1).ravel()
                item, spot = np.repeat(items, few), spot.ravel()
                hit = score > 0
                best.add(item[hit], score[hit], np.full(int(hit.sum()), row["uid"]), spot[hit])
        rows = best.rows()
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(-rows[1]), pa.array(rows[2]), pa.array(rows[3])], ["item", "bound", "uid", "spot"])
    return run


def _emit(best: Best):
    rows = best.rows()
    if rows.shape[1]:
        return [pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(-rows[1]), pa.array(rows[3], mask=rows[2] == 1)], ["item", "score", "doc_id"])]
    return []


def _add_scores(best: Best, items, docs, score, ids) -> None:
    hit = score > 0
    doc = docs[hit]
    none = np.array([ids[d] is None for d in doc.tolist()], np.int64)
    best.add(items[hit], score[hit], none, np.array([ids[d] or 0 for d in doc.tolist()], np.int64))


def _seed_scores(queries: Queries, keep: int):
    """Exact scores of the documents that came out of step 3."""
    def run(batches):
        best = Best(keep)
        for row in _group_rows(batches):
            n = np.frombuffer(row["n_terms"], "<i8")
            wanted = sorted({s["spot"] for s in row["seeds"]})
            pairs = {(s["item"], s["spot"]) for s in row["seeds"]}
            for items, score in queries.scores(queries.exact([row["texts"][s] for s in wanted]), n[wanted]):
                at = [(i, j) for i, x in enumerate(items.tolist()) for j, s in enumerate(wanted) if (x, s) in pairs]
                if at:
                    i, j = np.array(at).T
                    _add_scores(best, items[i], np.array(wanted)[j], score[i, j], row["ids"])
        yield from _emit(best)
    return run


def _answers(queries: Queries, floor: np.ndarray, keep: int):
    """Step 4: exact scores of all documents that are not provably below the floor of an item."""
    def run(batches):
        best = Best(keep)
        for row in _group_rows(batches):
            n = np.frombuffer(row["n_terms"], "<i8")
            open_ = [(items, bound >= floor[items][:, None]) for items, bound in queries.scores(queries.most(row["width"], row["top"], row["slices"], n), n)]
            docs = np.flatnonzero(np.any([o.any(axis=0) for _, o in open_], axis=0)) if open_ else np.zeros(0, np.int64)
            if len(docs):
                for (_, o), (items, score) in zip(open_, queries.scores(queries.exact([row["texts"][d] for d in docs.tolist()]), n[docs])):
                    i, j = np.nonzero(o[:, docs])
                    _add_scores(best, items[i], docs[j], score[i, j], row["ids"])
        yield from _emit(best)
    return run


FOUND = "item bigint, score bigint, doc_id bigint"


@settled
def search(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item.

    A document's score sums w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the item's terms, repeats included, with
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 25 + (75 * n * N) div L. Equal scores come by doc_id.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = (tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes + 1
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()   # about query_bytes
        queries = Queries([r["text"] for r in block])
        if not len(queries.item):
            continue
        seen = {r["term"]: r["n"] for r in index.select("n_terms", "terms", "counts").mapInArrow(_count(queries), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not seen.get(-1):
            continue
        queries.weigh(seen.pop(-2), seen.pop(-1), seen)
        best = Window.partitionBy("item").orderBy(F.desc("bound"), "uid", "spot")
        seeds = index.select("uid", "n_terms", "width", "top", "slices").mapInArrow(_highest(queries, k), "item bigint, bound bigint, uid bigint, spot bigint")
        seeds = seeds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
        seeds = K.stored(seeds.groupBy("uid").agg(F.collect_list(F.struct("item", "spot")).alias("seeds")))     # k rows an item of the block
        exact = index.select("uid", "ids", "n_terms", "texts").join(F.broadcast(seeds), "uid").mapInArrow(_seed_scores(queries, k), FOUND)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        tenth = exact.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("item", "score").collect()
        floor = np.ones(len(block), np.int64)
        for r in tenth:
            floor[r["item"]] = max(1, r["score"])
        found = index.drop("terms", "counts").mapInArrow(_answers(queries, floor, k), FOUND)
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item bigint, item_id bigint")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
