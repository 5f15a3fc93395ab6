"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, replaces homoglyphs of other scripts by their Latin letters, and reads digits and signs
that stand before a letter as the letters they imitate. Lexicon terms are whole words or word beginnings;
their weights are smoothed log odds over labelled rows. A word counts once with its strongest term, a term
inside an exception phrase (given, or learned as a word pair that only harmless rows have) does not count.
The sum is normalised by length, and a logistic curve over these figures turns it into a score.

Lexicon, exceptions and curve are fitted on at most ``sample_rows`` labelled rows (those with the smallest
hash of their id, so the sample does not depend on row order); every document is scored on its whole text.

Null and empty texts have no words and get the score of a text without a match. Labels that are null or whose
doc_id is null are not used; several labels of one document count as toxic if one is. Without any label row
of either kind the score is 0. Extra columns of the documents stay in ``score_toxicity`` and
``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrank.session import tidy

from . import kernels as K

# fixed values: letters of other scripts that look like Latin ones
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
              "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "η": "n",
              "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ӏ": "l"}
# fixed values: digits and signs and the letters they stand for
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# fixed values: harmless phrases of general English
EXCEPTIONS = ["pond scum", "trash can", "trash bin", "trash bag", "clown fish", "class clown", "sore loser", "idiot proof"]

FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} \
    | {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_FOREIGN = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "Ａ-Ｚａ-ｚ­​-‍⁠﻿]")
_DIGIT = re.compile(r"[0134578@$9]+(?=[^\W\d_])")
_DIGIT_TABLE = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W\d_]+")
PREFIX = (3, 8)


def fold(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, imitating digits as letters."""
    text = text.lower()
    if _FOREIGN.search(text):
        text = text.translate(FOLD)
    return _DIGIT.sub(lambda m: m[0].translate(_DIGIT_TABLE), text)


class Lexicon:
    """Weighted terms in one automaton: ``word`` matches a whole word, ``stem*`` the beginning of one."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]) -> None:
        self.weights, self.exceptions = weights, exceptions
        self.auto = ahocorasick.Automaton()
        terms: dict[str, list] = {}
        for term, w in weights.items():
            terms.setdefault(term.rstrip("*"), [None, None, False])[1 if term.endswith("*") else 0] = w
        for phrase in exceptions:
            terms.setdefault(phrase, [None, None, False])[2] = True
        for term, kinds in terms.items():
            self.auto.add_word(term, (len(term), *kinds))
        self.auto.make_automaton()

    def matches(self, text: str) -> dict[int, float]:
        """Weight of each matched word of a folded text by its start."""
        found: dict[int, float] = {}
        if not len(self.auto):
            return found
        excused, n = [], len(text)
        for end, (size, word, stem, phrase) in self.auto.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end + 1 == n or not text[end + 1].isalpha()
            if phrase and closed:
                excused.append((start, end))
            best = max((w for w, ok in ((word, closed), (stem, True)) if w is not None and ok), default=None)
            if best is not None and best > found.get(start, 0.0):
                found[start] = best
        for a, b in excused:
            for s in [s for s in found if a <= s <= b]:
                del found[s]
        return found

    def figures(self, text: str) -> tuple[float, float, float]:
        """Strongest weight, log of the sum, and sum for each root of the length."""
        got = self.matches(fold(text)) if text else {}
        if not got:
            return 0.0, 0.0, 0.0
        total = sum(got.values())
        return max(got.values()), math.log1p(total), total / math.sqrt(1 + text.count(" "))


def _term_counts(batches):
    """(term, toxic rows, other rows) of each batch: words and word beginnings of folded texts."""
    lo, hi = PREFIX
    for batch in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
            words = set(_WORD.findall(fold(text or "")))
            terms = set(words)
            for w in words:
                terms.update(w[:k] + "*" for k in range(lo, min(hi, len(w)) + 1))
            (pos if toxic else neg).update(terms)
        terms = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())],
                                         ["term", "pos", "neg"])


def _pair_counts(lexicon: Lexicon):
    """(word pair, toxic rows, other rows) for the neighbours of matched words."""
    def run(batches):
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, toxic in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
                folded = fold(text or "")
                pairs = set()
                for start in lexicon.matches(folded):
                    m = _WORD.match(folded, start)
                    if m is None:
                        continue
                    after = re.compile(r" ([^\W\d_]+)").match(folded, m.end())
                    if after:
                        pairs.add(f"{m[0]} {after[1]}")
                    before = folded[max(0, start - 40):start]
                    if before.endswith(" ") and (w := _WORD.findall(before)) and before[:-1].endswith(w[-1]):
                        pairs.add(f"{w[-1]} {m[0]}")
                (pos if toxic else neg).update(pairs)
            pairs = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array([pos[t] for t in pairs], pa.int64()), pa.array([neg[t] for t in pairs], pa.int64())],
                                             ["term", "pos", "neg"])
    return run


def _figures(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            f = [lexicon.figures(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            cols = list(zip(*f)) if f else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols] + [batch.column(batch.schema.get_field_index("toxic"))], ["f0", "f1", "f2", "toxic"])
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients (the constant last) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray | None) -> None:
        self.lexicon, self.curve = lexicon, curve

    def scores(self, texts) -> np.ndarray:
        f = np.array([self.lexicon.figures(t) for t in texts], float).reshape(-1, 3)
        if self.curve is None:
            return np.zeros(len(f))
        return 1 / (1 + np.exp(-np.clip(f @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _specific(terms: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights without the beginnings that (nearly) one longer term accounts for: the longer term says as much with fewer matches."""
    longer: dict[str, int] = {}
    for term, (pos, _) in terms.items():
        bare = term.rstrip("*")
        for k in range(PREFIX[0], len(bare) + (not term.endswith("*"))):
            longer[bare[:k] + "*"] = max(longer.get(bare[:k] + "*", 0), pos)
    return {t: w for t, (pos, w) in terms.items() if not (t.endswith("*") and longer.get(t, 0) >= 0.95 * pos)}


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of ``_fit``; the stored sample is dropped when it is made."""
    with tidy(docs.sparkSession):
        return _fit(docs, labels, **options)


def _fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), sample_rows: int = 20_000, least_rows: int = 6, least_weight: float = 3.0,
         max_terms: int = 5_000) -> Model:
    """Lexicon, exceptions and curve from labelled rows whose crc32(doc_id) % held_out[0] is not held_out[1]."""
    train = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .where(F.crc32(F.col("doc_id").cast("string")) % held_out[0] != held_out[1])
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))           # sample_rows rows: a bound for the broadcast
    sample = K.stored(docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "toxic"))
    n_pos, n_all = sample.agg(F.sum(F.col("toxic").cast("bigint")), F.count("*")).first()
    n_pos, n_neg = n_pos or 0, n_all - (n_pos or 0)
    if not n_pos or not n_neg:
        return Model(Lexicon({}, []), None)
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    counts = sample.mapInArrow(_term_counts, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    terms = (counts.where(F.col("pos") >= least_rows).withColumn("weight", weight).where(F.col("weight") >= least_weight)
             .orderBy(F.desc("weight"), "term").limit(max_terms).collect())
    weights = _specific({t["term"]: (t["pos"], t["weight"]) for t in terms})
    pairs = (sample.mapInArrow(_pair_counts(Lexicon(weights, [])), "term string, pos bigint, neg bigint").groupBy("term")
             .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("neg >= 3 and pos = 0").orderBy(F.desc("neg"), "term").limit(max_terms).collect())
    lexicon = Lexicon(weights, sorted({*EXCEPTIONS, *(p["term"] for p in pairs)}))
    rows = sample.mapInArrow(_figures(lexicon), "f0 double, f1 double, f2 double, toxic int").collect()   # at most sample_rows rows of four numbers
    x = np.array([r[:3] for r in rows], float)
    return Model(lexicon, logistic(x, np.array([float(r[3] > 0) for r in rows])))


def _score(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            s = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(s, pa.float64())], [*names, "score"])
    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each document (default: all but text and score) and its ``score``."""
    keep = [c for c in docs.columns if c not in ("text", "score")] if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_score(model, keep), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """The documents whose score is below ``cut``, untouched."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    return score_toxicity(packed, fit(docs, labels, **options), ["__row"]).where(F.col("score") < cut).select("__row.*")
