"""Document quality by a sparse ensemble of rules over text statistics.

Twenty statistics of a whole text come from array kernels over its bytes. On at most ``sample_rows`` labelled rows (those with the
smallest hash of their id) shallow trees are boosted; every path from a root is a rule, a conjunction of
thresholds; a logistic model with an L1 penalty keeps few of them. The kept rules are compiled into one column
expression over the statistics, and nothing is shuffled.

Null and empty texts have all statistics 0 and a score like any other. Labels that are null or whose doc_id is null
are not used; of several labels of one document the highest counts. Without both kinds of labels the score is the
share of good labels (0.5 without any). Extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

# fixed values: frequent function words of four languages
FUNCTION_WORDS = "the and of to in is for that with der die und das ist von den mit le la les et des est que el los las por una del".split()


# fixed values: byte classes; continuation bytes (0) belong to the character before them
_OTHER, _SMALL, _UPPER, _DIGIT, _SPACE, _STOP, _COMMA, _QUOTE, _LINK = range(1, 10)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 0, _SMALL
for _chars, _kind in ((range(97, 123), _SMALL), (range(65, 91), _UPPER), (b"0123456789", _DIGIT), (b" \t\n\r\x0b\x0c", _SPACE), (b".!?", _STOP), (b",;:", _COMMA), (b"'\"()-", _QUOTE), (b"@/", _LINK)):
    _CLASS[list(_chars)] = _kind
_IN_LINE = np.arange(256) != 10
N_STATS = 20


def _count(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of true entries of ``kind`` in each row."""
    total = np.append(0, np.cumsum(kind))
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    _, first = np.unique(K.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=n)


def text_statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of figures for each text."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros((n, N_STATS))
    kind = _CLASS[data]
    c = np.bincount(np.repeat(np.arange(n) * 10, np.diff(offs)) + kind, minlength=10 * n).reshape(n, 10).astype(float)
    chars, letters = c[:, 1:].sum(axis=1), c[:, _SMALL] + c[:, _UPPER]
    sums = K.prefix_sums(data, _CODES)
    starts, ends, at = K.word_spans(data, offs, K.SPACED)
    words, size = np.diff(at).astype(float), ends - starts
    hashes = K.span_hash(sums, starts, ends)
    so_far = np.append(0, np.cumsum((kind == _SMALL) | (kind == _UPPER)))
    bare = so_far[ends] == so_far[starts]
    l0, l1, lat = K.word_spans(data, offs, _IN_LINE)
    lines = np.diff(lat).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    return np.column_stack([
        np.log1p(chars), np.log1p(words), share(letters, chars), share(c[:, _UPPER], chars), share(c[:, _DIGIT], chars), share(c[:, _OTHER], chars),
        share(c[:, _STOP], words), share(c[:, _COMMA], words), share(c[:, _SPACE], chars), share(c[:, _LINK], words), share(chars, words), share(_distinct(hashes, at), words),
        share(_distinct(K.span_hash(sums, l0, l1), lat), lines), share(words, lines), np.log1p(lines), share(_count(np.isin(hashes, _KNOWN), at), words),
        share(_count(size <= 2, at), words), share(_count(size >= 14, at), words), share(_count(bare, at), words),
        share(_count(kind[l1 - 1] == _STOP, lat) if len(l1) else np.zeros(n), lines)])


_CODES = K.byte_codes(5)
_KNOWN = np.array([K.span_hash(K.prefix_sums(b, _CODES), np.array([0]), np.array([len(b)]))[0] for b in (np.frombuffer(w.encode(), np.uint8) for w in FUNCTION_WORDS)])


def _stats(names: list[str]):
    def run(batches):
        for batch in batches:
            for a, b, data, offs in K.text_chunks(batch):
                flat = text_statistics(data, offs).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * N_STATS, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in names] + [lists], [*names, "stats"])
    return run


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the array column ``stats``."""
    keep = [c for c in docs.columns if c not in ("text", "stats")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["stats array<double>"])
    return docs.select(*[f"`{c}`" for c in keep], "text").mapInArrow(_stats(keep), schema)


def _best_cut(x: np.ndarray, r: np.ndarray, least: int):
    """(gain, feature, threshold) of the split that lowers the squared error of ``r`` most."""
    best, n = (0.0, -1, 0.0), len(r)
    total = r.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(r[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= n - least)]
        if len(at):
            gain = s[at - 1] ** 2 / at + (total - s[at - 1]) ** 2 / (n - at) - total ** 2 / n
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] - 1]) / 2))
    return best


def _grow(x, r, path, depth, least, rules):
    """Adds the path to every node below to ``rules``; returns the tree's value for each row."""
    gain, f, cut = _best_cut(x, r, least) if depth and len(r) >= 2 * least else (0.0, -1, 0.0)
    if f < 0:
        return np.full(len(r), r.mean() if len(r) else 0.0)
    left, out = x[:, f] <= cut, np.empty(len(r))
    for side, rows in ((True, left), (False, ~left)):
        below = path + ((f, side, cut),)
        rules[below] = None
        out[rows] = _grow(x[rows], r[rows], below, depth - 1, least, rules)
    return out


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= (x[:, f] <= cut) == below
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, least: int) -> list[tuple]:
    """The distinct paths of boosted trees."""
    rules: dict[tuple, None] = {}
    margin = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    rng = np.random.default_rng(7)
    for _ in range(trees):
        part = np.sort(rng.choice(len(y), min(len(y), max(200, min(len(y) // 2, 5_000))), replace=False))
        p = 1 / (1 + np.exp(-margin))
        seen: dict[tuple, None] = {}
        _grow(x[part], (y - p)[part], (), depth, least, seen)
        rules |= seen
        leaves = [r for r in seen if not any(len(o) > len(r) and o[:len(r)] == r for o in seen)]
        for leaf in leaves:
            at = holds(leaf, x)
            if at.any():
                margin[at] += rate * (y - p)[at].sum() / max(1e-3, (p * (1 - p))[at].sum())
        margin = np.clip(margin, -8, 8)
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and constant by accelerated proximal gradient steps."""
    n, m = x.shape
    full = np.column_stack([x, np.ones(n)])
    v = np.ones(m + 1)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (full.T @ (full @ v)))
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        g = full.T @ (1 / (1 + np.exp(-np.clip(full @ z, -30, 30))) - y) / n
        new = z - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


class RuleModel:
    """Rules (feature, below or above, threshold) with weights, and the constant."""

    def __init__(self, rules: list[tuple], weights: list[float], constant: float) -> None:
        self.rules, self.weights, self.constant = rules, weights, constant

    def score(self) -> Column:
        """The ensemble over the column ``stats``."""
        total = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights):
            told = None
            for f, below, cut in rule:
                s = F.col("stats")[f]
                one = s <= cut if below else s > cut
                told = one if told is None else told & one
            total = total + F.when(told, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), sample_rows: int = 20_000, trees: int = 40, depth: int = 3, rate: float = 0.3,
        penalty: float = 0.001) -> RuleModel:
    """A rule ensemble from labelled rows whose crc32(doc_id) % held_out[0] is not held_out[1]."""
    train = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .where(F.crc32(F.col("doc_id").cast("string")) % held_out[0] != held_out[1])
             .groupBy("doc_id").agg(F.max("quality").alias("__good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    labelled = K.stored(docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(sample_rows))
    rows = statistics(labelled).select("stats", "__good").collect()        # at most sample_rows rows of twenty numbers
    y = np.array([float(r[1] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel([], [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    x = np.array([r[0] for r in rows])
    rules = tree_rules(x, y, trees, depth, rate, max(3, len(y) // 500))
    weights, constant = lasso_logistic(np.column_stack([holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0)), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel([rules[i] for i in kept], [float(weights[i]) for i in kept], constant)


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` without text, with the column ``score`` (one of that name is replaced)."""
    return statistics(docs).withColumn("score", model.score()).drop("stats")
