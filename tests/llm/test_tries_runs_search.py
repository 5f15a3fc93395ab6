"""Conversation trie, repeated word runs and ranked search against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from newsrank.llm import bitsliced_search, conversation_trie, recompression

SF = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append(((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()), (r, x)))
    conv = {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in conv.items()}
    built = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def test_conversation_trie(spark):
    rnd = random.Random(1)
    rows = [(c, t if rnd.random() < .9 else None, rnd.choice(["user", None, "a"]), rnd.choice([None, "x", "yy", "zé"])) for c in range(-12, 40) for t in range(rnd.randint(1, 14))]
    rows += [(c, t, "u", "diff" if c == 1003 and t > 25 else "same") for c in (1000, 1001, 1002, 1003) for t in range(40)]
    rows += [(None, 1, "a", "b"), *rows[:5], (2000, 0, "u", "w" * 3_000_000)]
    for part in (rows, [], [(7, 1, None, None)]):
        table = spark.createDataFrame([(*r, 1, 2) for r in part], "conv_id bigint, turn bigint, role string, text string, depth int, unit int")
        assert Counter(tuple(r[c] for c in NODE) for r in conversation_trie.trie(table).collect()) == plain_trie(part)


def plain_runs(rows, size=20):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    key, first, out = lambda i: (i is None, i or 0), {}, Counter()
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            first[k] = min(first.get(k, ((True, 1), 0)), (key(i), p))
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < (key(i), p):
                gone[p:p + size] = [True] * size
        out[(i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long, short = prose(60), prose(21)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, prose(3000)), (6, long + " " + prose(10)), (7, prose(9) + "\t" + long), (7, prose(9) + "\n" + long),
            (None, long + " x"), (None, long + " x"), (8, "a " * 200), (9, "b " + "a " * 100 + "c"), (10, "a b " * 90), (11, "a a b " * 50 + short),
            (12, "é" + short + " ü"), (13, short), (14, short), (4, "one"), (-3, long), (15, " ".join([long] * 3)), (16, "W1 w2, W3! w4")]
    rows += [(20 + i, prose(rnd.randint(1, 60)) + (" " + short if i % 3 == 0 else "")) for i in range(40)]
    return rows + [(100 + i % 7, long + " z") for i in range(20)]


@pytest.mark.parametrize("options", [{}, {"name_bucket": 7, "window_bucket": 5}, {"levels": 1, "gram": 3}, {"levels": 3, "gram": 1}])
def test_repeated_runs(spark, texts, options):
    table = spark.createDataFrame([(i, t, None, "s") for i, t in texts], "doc_id bigint, text string, kept string, n_words string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.repeated_runs(table, **options).collect())
    assert got == plain_runs(texts)


def test_repeated_runs_of_given_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows.append((-1, " ".join(t for _, t in rows if t) * 12))                 # longer than a chunk
    assert len(rows[-1][1].encode()) > recompression.CHUNK
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.repeated_runs(spark.createDataFrame(rows, docs.schema)).collect())
    assert got == plain_runs(rows)
    assert recompression.repeated_runs(docs.limit(0)).count() == 0


def plain_search(docs, items, k=10):
    terms = lambda t: [x.lower() for x in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in held]
    out = []
    for item, text in items:
        found = []
        for i, n, tf in counts:
            s = 0
            for x in terms(text):
                if tf[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    s += w * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def test_ranked_search(spark, texts):
    items = [(1, "w1 w2 w2 w49"), (2, "a b"), (3, None), (4, "nowhere"), (5, ""), (6, " ".join(f"w{i}" for i in range(50))), (6, "one"), (None, "Z x"), (7, texts[4][1])]
    docs = texts + [(500 + i, "a b c") for i in range(40)]
    for rows in (docs, docs[:1], []):
        table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int")
        asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
        for options in ({}, {"query_bytes": 40}):
            got = Counter(tuple(r) for r in bitsliced_search.search(table, asked, **options).select("item_id", "rank", "doc_id", "score").collect())
            assert got == plain_search(rows, items)
    assert bitsliced_search.search(table, asked.limit(0)).count() == 0


def test_bounds_are_never_below_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    queries = bitsliced_search.Queries([t for _, t in items])
    import numpy as np

    seen = higher = 0
    for row in bitsliced_search.build_index(docs).collect():
        n = np.frombuffer(row.n_terms, "<i8")
        most, true = queries.most(row.width, row.top, row.slices, n), queries.exact(row.texts)
        assert (most >= true).all()
        seen, higher = seen + true.size, higher + int((most > true).sum())
    assert 0 < higher < seen // 50
