"""SentencePiece encoding and decoding with a shared-prefix forward table.

A text becomes marked words: each run of spaces opens the word that follows it, and the text itself opens with
one. No piece crosses such an opening, so words are encoded on their own, each distinct word of a task once.
The distinct words are sorted, which lays them out as the depth-first order of their trie; the forward table
(best score, or last piece, of every prefix) is cut back to the prefix shared with the word before and grown
from there, so a prefix common to many words is scored once.

The rule that fills the table follows the model file. For unigram models it is Viterbi's: the best sum of
piece scores. For models trained by pair merging that sum gives other pieces than the model's own encoder;
there the table keeps the last piece of each prefix, which is the only piece that the merges leave intact
behind the last piece before it (a sequence is what the merges give exactly when each two neighbours are).

Characters outside the vocabulary fall back to byte pieces, or to the unknown piece in models without them.
Nothing is shuffled; words are remembered within a task up to ``remembered`` entries.

Null texts give a null list, empty ones an empty list; null ids decode to null. The mark character itself in
a text reads as a space, as in the model's own encoder. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 2_000_000
WORD_CHUNK = 4 << 20
_LAST = float("inf")


class Pieces:
    """The vocabulary of a model file and the encoder over it."""

    def __init__(self, model: bytes, rule: str | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal, spec = proto.normalizer_spec, proto.trainer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
            raise ValueError("only models that keep the text as it is are supported")
        if spec.model_type not in (1, 2):
            raise ValueError("only unigram and pair-merge models are supported")
        self.rule = rule or ("viterbi" if spec.model_type == 1 else "merges")
        self.vocab, self.score, self.byte, self.bytes_of = {}, [], {}, []
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            self.score.append(p.score)
            raw = b""
            if p.type == kind.NORMAL or p.type == kind.USER_DEFINED:
                self.vocab[p.piece] = i
                raw = p.piece.replace(MARK, " ").encode()
            elif p.type == kind.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                raw = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                self.unknown = i
                raw = spec.unk_surface.encode()
            self.bytes_of.append(raw)
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("a piece crosses words; this model cannot be encoded word by word")
        self.longest = max(map(len, self.vocab), default=1)
        self.low = min((self.score[i] for i in self.vocab.values()), default=0.0) - 10.0
        self.pairs: dict[tuple[int, int], bool] = {}
        self.name = {i: p for p, i in self.vocab.items()}
        self.rank = {p: -self.score[i] for p, i in self.vocab.items()}
        self.grown: dict[int, tuple] = {}

    def merged(self, word: str) -> list[str]:
        """Pair merges over one string: the best-scoring neighbour pair first, the leftmost of equals."""
        n = len(word)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                i = self.vocab.get(word[a:end[b]])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a] if alive[a] else n
            if not alive[a] or b >= n or end[b] != stop:
                continue
            alive[b] = False
            end[a] = stop
            if stop < n:
                prev[stop] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        out, a = [], 0
        while a < n:
            out.append(word[a:end[a]])
            a = end[a]
        return out

    def chains(self, i: int) -> tuple[list, list]:
        """How a piece grows at its left and at its right edge: (part, rank of the merge that takes it up) from the single character on."""
        got = self.grown.get(i)
        if got is None:
            word = self.name[i]
            if len(word) == 1:
                got = ([(word, _LAST)], [(word, _LAST)])
            else:
                cut = self._last_cut(word)
                left, right = self.chains(self.vocab[word[:cut]])[0], self.chains(self.vocab[word[cut:]])[1]
                rank = -self.score[i]
                got = (left[:-1] + [(left[-1][0], rank), (word, _LAST)], right[:-1] + [(right[-1][0], rank), (word, _LAST)])
            self.grown[i] = got
        return got

    def _last_cut(self, word: str) -> int:
        """Where the last merge joins a piece: the one place at which its two parts are pieces that stand and stay apart until then."""
        top = self.vocab[word]
        for cut in range(1, len(word)):
            l, r = self.vocab.get(word[:cut]), self.vocab.get(word[cut:])
            if l is not None and r is not None and self.stands(-1, l) and self.stands(-1, r) and self._apart(l, r, -self.score[top]):
                return cut
        raise ValueError(f"the merges never give the piece {word!r}")

    def _apart(self, left: int, right: int, until: float) -> bool:
        """Whether no merge of rank below ``until`` joins parts of the two pieces across their border."""
        a, b = self.chains(left)[1], self.chains(right)[0]
        i = j = 0
        while True:
            (x, up), (y, down) = a[i], b[j]
            both = self.rank.get(x + y, _LAST)
            if both < until and both < up and both <= down:
                return False
            if up is _LAST and down is _LAST:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave these two pieces as they are (left -1: nothing known before)."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if left >= 0:
                got = self.stands(-1, right) and self._apart(left, right, _LAST)
            else:
                got = len(self.name[right]) == 1 or self.merged(self.name[right]) == [self.name[right]]
            self.pairs[key] = got
        return got

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Piece numbers of marked words in sorted order; the forward table is shared along common prefixes."""
        viterbi = self.rule == "viterbi"
        vocab, longest, score, pairs = self.vocab, self.longest, self.score, self.pairs
        before, out = "", []
        piece, back, best = [-1], [0], [0.0]
        for word in words:
            if not viterbi and word.startswith(MARK * 3):      # runs of marks have equal scores: merge them outright
                out.append(self._numbers([(vocab.get(p, -1), p) for p in self.merged(word)]))
                continue
            k, n = 0, min(len(before), len(word))
            while k < n and before[k] == word[k]:
                k += 1
            del piece[k + 1:], back[k + 1:], best[k + 1:]      # back to the shared prefix
            for i in range(k + 1, len(word) + 1):
                choice, start = -1, i - 1
                if viterbi:
                    top, first = best[i - 1] + self.low, True
                    for j in range(max(0, i - longest), i):
                        p = vocab.get(word[j:i])
                        if p is not None and (first or best[j] + score[p] > top):
                            choice, start, top, first = p, j, best[j] + score[p], False
                    best.append(top)
                else:
                    for j in range(i - longest if i > longest else 0, i):
                        p = vocab.get(word[j:i])
                        if p is not None:
                            ok = pairs.get((piece[j], p))
                            if ok or ok is None and self.stands(piece[j], p):
                                choice, start = p, j
                                break
                piece.append(choice)
                back.append(start)
            before = word
            ids, i, odd = [], len(word), False
            while i:
                ids.append(piece[i])
                odd = odd or piece[i] < 0
                i = back[i]
            if odd:
                ids, i = [], len(word)
                while i:
                    ids.append((piece[i], word[back[i]:i]))
                    i = back[i]
                out.append(self._numbers(ids[::-1]))
            else:
                out.append(ids[::-1])
        return out

    def _numbers(self, path) -> list[int]:
        ids = []
        for p, text in path:
            if p >= 0:
                ids.append(p)
            elif self.byte:
                ids += [self.byte[b] for b in text.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids


class WordEncoder:
    """Encodes chunks of texts; remembers the words of earlier chunks of the task."""

    def __init__(self, pieces: Pieces, remembered: int) -> None:
        self.pieces, self.limit = pieces, remembered
        self._forget()
        self.codes = K.byte_codes(3, lower=False)
        size = [len(b) for b in pieces.bytes_of]
        self.raw = np.frombuffer(b"".join(pieces.bytes_of), np.uint8)
        self.raw_n = np.array(size, np.int64)
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n

    def _forget(self) -> None:
        self.words, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)

    def _learn(self, words: np.ndarray, spelled: list[str]) -> None:
        """Encode the words in sorted order and keep them, ordered by hash."""
        order = sorted(range(len(spelled)), key=spelled.__getitem__)
        ids = self.pieces.encode_sorted([spelled[i] for i in order])
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.at = np.append(self.at, len(self.flat) + np.cumsum(n) - n)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))
        self.words, self.n = np.append(self.words, words[order]), np.append(self.n, n)
        by = np.argsort(self.words)
        self.words, self.n, self.at = self.words[by], self.n[by], self.at[by]

    def chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts of a chunk and the offsets of each text."""
        size = np.diff(offs)
        full = np.flatnonzero(size)
        data = np.insert(data, offs[:-1][full], 0x20)           # every text opens with a mark
        offs = np.append(0, np.cumsum(size + (size > 0)))
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        space = data == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offs[:-1][full]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        h = K.span_hash(K.prefix_sums(data, self.codes), starts, ends)
        words, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.words) > self.limit:
            self._forget()
        spot = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        new = np.flatnonzero(self.words[spot] != words) if len(self.words) else np.arange(len(words))
        if len(new):
            raw = data.tobytes()
            self._learn(words[new], [raw[i:j].decode().replace(" ", MARK) for i, j in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        spot = np.searchsorted(self.words, words)
        n, at = self.n[spot], self.at[spot]
        ids = self.flat[K.ragged(at[which], n[which])]
        upto = np.append(0, np.cumsum(n[which]))
        return ids, upto[np.searchsorted(starts, offs)]

    def spell(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts and their offsets (the opening mark of each text taken off)."""
        n = self.raw_n[ids]
        out = self.raw[K.ragged(self.raw_at[ids], n)]
        offs = np.append(0, np.cumsum(n))[upto]
        first = offs[:-1][np.diff(offs) > 0]
        first = first[out[first] == 0x20]
        cut = np.zeros(len(offs), np.int64)
        cut[1:] = np.searchsorted(first, offs[1:])
        return np.delete(out, first), offs - cut


def _plain_marks(column: pa.Array) -> pa.Array:
    """Texts that hold the mark character itself have it as a space."""
    data, _ = K.text_bytes(column)
    if MARK.encode() not in data.tobytes():
        return column
    return pa.array([t.replace(MARK, " ") if t is not None else None for t in column.to_pylist()], pa.string())


def _encode(pieces: Pieces, names: list[str], remembered: int, check: bool):
    def run(batches):
        coder = WordEncoder(pieces, remembered)
        for batch in batches:
            text = _plain_marks(batch.column(batch.schema.get_field_index("text")))
            data, offs = K.text_bytes(text)
            missing = text.is_null().to_numpy(zero_copy_only=False)
            for a, b in K.chunks(offs, WORD_CHUNK):
                part = data[offs[a]:offs[b]]
                ids, upto = coder.chunk(part, offs[a:b + 1] - offs[a])
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(missing[a:b]))
                cols = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in names] + [lists, pa.array(np.diff(upto), pa.int64())]
                if check:
                    raw, at = coder.spell(ids, upto)
                    back = raw.tobytes()
                    cols.append(pa.array([hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()))
                    cols.append(pa.array([np.array_equal(raw[i:j], part[s:e]) for i, j, s, e in zip(at[:-1], at[1:], offs[a:b] - offs[a], offs[a + 1:b + 1] - offs[a])], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, [*names, "ids", "n_ids"] + (["decoded_sha256", "round_trip"] if check else []))
    return run


def _decode(pieces: Pieces, names: list[str]):
    def run(batches):
        coder = WordEncoder(pieces, 0)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            texts = []
            for x in lists:
                if not x.is_valid:
                    texts.append(None)
                    continue
                ids = np.array([i for i in x.as_py() if i is not None], np.int64)
                raw, _ = coder.spell(ids, np.array([0, len(ids)]))
                texts.append(raw.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(texts, pa.string())], [*names, "text"])
    return run


def load(path: str = DEFAULT_MODEL, rule: str | None = None) -> Pieces:
    with open(path, "rb") as f:     # the driver reads the model; tasks get its tables
        return Pieces(f.read(), rule)


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, keep: list[str] | None = None, rule: str | None = None, check: bool = False,
           remembered: int = REMEMBERED) -> DataFrame:
    """The columns ``keep`` (default: all but text), ``ids`` and ``n_ids``; with ``check`` also the decoded text's digest and whether it equals the text."""
    added = ("ids", "n_ids", "decoded_sha256", "round_trip")
    keep = [c for c in docs.columns if c != "text" and c not in added] if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["ids array<int>", "n_ids bigint"] + (["decoded_sha256 string", "round_trip boolean"] if check else []))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_encode(load(model, rule), keep, remembered, check), schema)


def decode(rows: DataFrame, model: str = DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but ids and text) and the decoded ``text``."""
    keep = [c for c in rows.columns if c not in ("ids", "text")] if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["text string"])
    return rows.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(_decode(load(model), keep), schema)
