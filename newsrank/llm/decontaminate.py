"""Benchmark decontamination with one FM-index for each shard of training text.

A shard is a run of whole documents of about ``shard_bytes``. Its words become symbols: a word of the
benchmark has a number, every other word and every document end is a separator, and stretches of numbered
words too short for any test phrase are left out, as no phrase fits in them. Over what remains the task
builds suffix order, Burrows-Wheeler transform, wavelet matrix and sampled suffix positions; all test
phrases are searched backwards at once, one wavelet rank a step; occurrences are located by walking to the
next sampled position, and the covered words of a document are merged into removal spans.

The benchmark is the stated query set: it is read in blocks of at most ``phrase_bytes`` and the documents
pass through one search a block, so what a task holds is bounded whatever its size. Documents are never
shuffled.

Null text has no words. Items with a null id hit, but are not counted or named. Repeated item ids count once.
A benchmark without words hits nothing. Extra columns of the documents stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 13
SAMPLE = 8
ADDED = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<array<bigint>>"


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of ``seq`` by prefix doubling; zeros are separators, each smaller than all words and different from the others."""
    n = len(seq)
    seps = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:n - step] = rank[step:] + 1
        key = rank * (n + int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.cumsum(np.append(0, (s[1:] != s[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of word numbers that ends with a separator (0)."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        order = suffix_order(seq)
        before = seq[order - 1]
        self.last = before                      # the transform; position 0 is preceded by the last separator
        self.less = np.searchsorted(np.sort(seq), np.arange(symbols + 1))
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        level = before
        for bit in range(self.bits - 1, -1, -1):
            b = (level >> bit) & 1
            self.ones.append(np.append(0, np.cumsum(b)).astype(np.int32))
            self.zeros.append(len(b) - int(b.sum()))
            level = np.concatenate([level[b == 0], level[b == 1]])
        self.base = self._descend(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))
        self.mark = (order % sample == 0) | (before == 0)
        self.slot = np.cumsum(self.mark) - 1
        self.value = order[self.mark]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ones[at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at`` of the transform."""
        return self._descend(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order ranges [lo, hi) of phrases of one length, one a row."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.last), np.int64)
        live = np.arange(len(phrases))
        for col in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, col]
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places of the suffix order."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        walk = np.flatnonzero(~self.mark[row])
        while len(walk):
            c = self.last[row[walk]]
            row[walk] = self.less[c] + self.rank(c, row[walk])
            steps[walk] += 1
            walk = walk[~self.mark[row[walk]]]
        return self.value[self.slot[row]] + steps


class Phrases:
    """Windows of a block of benchmark items as word numbers, with the items each belongs to."""

    def __init__(self, items: list[tuple]) -> None:
        codes = K.byte_codes(1)
        raw = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        starts, ends, at = K.word_spans(data, offs, K.ALNUM)
        words = K.span_hash(K.prefix_sums(data, codes), starts, ends)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        number = number.astype(np.int64) + 1
        found: dict[int, dict[tuple, set]] = {}
        for i, (item, _) in enumerate(items):
            w = number[at[i]:at[i + 1]].tolist()
            size = min(WINDOW, len(w))
            for j in range(len(w) - size + 1) if size else ():
                found.setdefault(size, {}).setdefault(tuple(w[j:j + size]), set()).add(item)
        self.groups = [(size, np.array(list(d), np.int64), [sorted(x for x in s if x is not None) for s in d.values()]) for size, d in sorted(found.items())]
        self.shortest = min(found, default=0)
        slots = 1 << 18
        self.table = np.zeros(slots, np.int32)
        low = (self.vocabulary & np.uint64(slots - 1)).astype(np.int64)
        self.table[low] = np.arange(len(low))
        self.crowded = np.bincount(low, minlength=slots) > 1

    def number(self, words: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, or 0 for a word that no item has."""
        if not len(self.vocabulary) or not len(words):
            return np.zeros(len(words), np.int64)
        low = (words & np.uint64(len(self.table) - 1)).astype(np.int64)
        got = self.table[low].astype(np.int64)
        hit = self.vocabulary[got] == words
        rest = np.flatnonzero(~hit & self.crowded[low])
        if len(rest):
            spot = np.minimum(np.searchsorted(self.vocabulary, words[rest]), len(self.vocabulary) - 1)
            got[rest] = spot
            hit[rest] = self.vocabulary[spot] == words[rest]
        return np.where(hit, got + 1, 0)


def shard_hits(phrases: Phrases, number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Search one shard: (first word, word count) of every occurrence and the items of its window."""
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not len(number):
        return none, none, []
    new = np.zeros(len(number) + 1, bool)
    new[at] = True
    known = number > 0
    first = np.flatnonzero(known & (new[:-1] | np.append(True, ~known[:-1])))
    last = np.flatnonzero(known & (new[1:] | np.append(~known[1:], True))) + 1
    keep = last - first >= phrases.shortest
    first, size = first[keep], (last - first)[keep]
    if not len(first):
        return none, none, []
    source = K.ragged(first, size + 1)          # each stretch and one separator after it
    seq = np.zeros(len(source), np.int64)
    inner = np.ones(len(source), bool)
    inner[np.cumsum(size + 1) - 1] = False
    seq[inner] = number[source[inner]]
    index = FMIndex(seq, len(phrases.vocabulary))
    where, length, items = [], [], []
    for width, rows, owners in phrases.groups:
        lo, hi = index.search(rows)
        hit = np.flatnonzero(lo < hi)
        if len(hit):
            count = hi[hit] - lo[hit]
            where.append(source[index.locate(K.ragged(lo[hit], count))])
            length.append(np.full(int(count.sum()), width))
            items += [owners[h] for h, n in zip(hit.tolist(), count.tolist()) for _ in range(n)]
    if not where:
        return none, none, []
    return np.concatenate(where), np.concatenate(length), items


def _search(phrases: Phrases, names: list[str], last: bool, shard_bytes: int):
    """One pass of all documents against one block of phrases; earlier passes' finds come in ``__runs`` and ``__items``."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        codes = K.byte_codes(1)
        for batch in batches:
            had_runs = batch.column(batch.schema.get_field_index("__runs"))
            had_items = batch.column(batch.schema.get_field_index("__items"))
            n = batch.num_rows
            runs, items = [None] * n, [None] * n
            out = {"n_words": np.zeros(n, np.int64), "n_hit": np.zeros(n, np.int64), "n_items": np.zeros(n, np.int64)}
            sha, spans = [empty] * n, [[] for _ in range(n)]
            for a, b, data, offs in K.text_chunks(batch, limit=shard_bytes):
                starts, ends, at = K.word_spans(data, offs, K.ALNUM)
                out["n_words"][a:b] = np.diff(at)
                words = K.span_hash(K.prefix_sums(data, codes), starts, ends) if len(starts) else np.zeros(0, np.uint64)
                where, length, owners = shard_hits(phrases, phrases.number(words), at)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, where, 1)
                np.add.at(change, where + length, -1)
                found: dict[int, set] = {}
                for d, own in zip((np.searchsorted(at, where, side="right") - 1).tolist(), owners):
                    found.setdefault(d, set()).update(own)
                for d in range(b - a):
                    if had_runs[a + d].is_valid:
                        old = np.frombuffer(had_runs[a + d].as_py(), "<i8").reshape(-1, 2) + at[d]
                        np.add.at(change, old[:, 0], 1)
                        np.add.at(change, old[:, 1], -1)
                        found.setdefault(d, set()).update(had_items[a + d].as_py() or [])
                covered = np.cumsum(change[:-1]) > 0
                total = np.append(0, np.cumsum(covered))
                out["n_hit"][a:b] = total[at[1:]] - total[at[:-1]]
                for d in np.flatnonzero(out["n_hit"][a:b]).tolist():
                    mine = np.append(np.append(False, covered[at[d]:at[d + 1]]), False).astype(np.int8)
                    edge = np.flatnonzero(np.diff(mine)).reshape(-1, 2)
                    ids = sorted(found.get(d, ()))
                    if last:
                        out["n_items"][a + d] = len(ids)
                        sha[a + d] = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
                        spans[a + d] = [[int(starts[at[d] + s] - offs[d]), int(ends[at[d] + e - 1] - offs[d])] for s, e in edge.tolist()]
                    else:
                        runs[a + d], items[a + d] = edge.astype("<i8").tobytes(), ids
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            if last:
                dirty = (out["n_hit"] > 0) & (20 * out["n_hit"] >= out["n_words"])
                yield pa.RecordBatch.from_arrays(cols + [pa.array(out[c], pa.int64()) for c in ("n_words", "n_hit", "n_items")]
                                                 + [pa.array(sha, pa.string()), pa.array(dirty, pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                                                 names + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])
            else:
                yield pa.RecordBatch.from_arrays(cols + [pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names + ["__runs", "__items"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, shard_bytes: int = K.CHUNK_BYTES,
                  phrase_bytes: int = 4 << 20) -> DataFrame:
    """The columns ``keep`` of every document (default: all but the text) with

    n_words, n_hit, n_items, items_sha256, contaminated and ``spans``, the merged removal spans in bytes.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    clash = set(keep) & {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be written twice; leave them out of keep")
    types = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)
    tests = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // phrase_bytes + 1
    carried = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*[F.col(f"`{c}`") for c in carried]).withColumns({"__runs": F.lit(None).cast("binary"), "__items": F.lit(None).cast("array<bigint>")})
    ddl = lambda cols: ", ".join(f"`{c}` {types[c]}" for c in cols)
    for k in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()   # at most about phrase_bytes
        phrases, last = Phrases([(r[0], r[1]) for r in block]), k == blocks - 1
        names = keep if last else carried
        schema = ", ".join(x for x in (ddl(names), ADDED if last else "__runs binary, __items array<bigint>") if x)
        rows = rows.mapInArrow(_search(phrases, names, last, shard_bytes), schema)
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns and texts untouched."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    found = contamination(packed, benchmark, keep=["__row"], **options).where(~F.col("contaminated"))
    return found.select("__row.*")
