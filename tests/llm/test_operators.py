"""The dealt operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsrank.llm import decontaminate, jobs, kd_shards, learned_ann, licences, neardup, pieces, rule_quality, suffix_dedup, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, score double, spans string"
BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long, shared = prose(3000), prose(150)
    rows = [(1, None), (2, ""), (3, "   \n "), (4, "one"), (5, long), (6, long), (7, long + " tail"), (8, "Ünïcode ▁ text " + shared), (9, shared + " more"), (None, "no id"), (4, "one"), (10, shared + shared)]
    rows += [(20 + i, prose(rnd.randint(1, 80))) for i in range(30)]
    return spark.createDataFrame([(i, t, None, "s", 0.5, "x") for i, t in rows], DOCS), rows


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "u\r\n1", big), (5, "u", big), (9, None, big), (2, "u", "y" * 999), (3, "u", "y" * 999), (4, "u", None), (6, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\n" + "é" * 600), (None, "u", big), (7, "u", "z" * 1000), (7, "u", "z" * 1000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, n int")
    got = warc.archive(pages).collect()
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, 0), i)
    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), top.get(h) if top.get(h, i) != i else None) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert all(r.intact and r.refers_to is None if r.record_type == "response" else r.html is None for r in got)
    assert {r.page_id: r.html for r in got}[6] == rows[6][2]
    assert warc.archive(pages.limit(0)).count() == 0


def test_one_long_page_does_not_shorten_the_files_of_others(spark):
    import gzip
    import tempfile
    from pathlib import Path

    pages = spark.range(1, 601, numPartitions=1).selectExpr("id AS page_id", "'u' AS url", "if(id = 7, repeat('long ', 1000000), concat('page ', id)) AS html")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    warc.write_archives(pages, path)
    files = [gzip.decompress(f.read_bytes()) for f in Path(path).rglob("part-*.gz")]
    counts = sorted(n for f in files if (n := f.count(b"WARC/1.1\r\n")))
    assert counts == [1, 599]
    assert warc.read_archives(spark, path).where("intact").count() == 600


def test_pieces_equal_the_models_own_encoder(odd):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    docs, rows = odd
    coded = pieces.encode(docs.withColumn("raw", F.col("text")), check=True)
    for r in coded.collect():
        assert r.ids == (None if r.raw is None else sp.encode(r.raw))
        assert r.round_trip or "▁" in r.raw
    back = pieces.decode(coded.select("doc_id", "raw", "ids")).collect()
    assert all(r.text == (None if r.raw is None else r.raw.replace("▁", " ")) for r in back)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_viterbi_shares_prefixes():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.remove_extra_whitespaces = False
    for p, s, t in (("<unk>", 0, 2), ("▁", -2, 1), ("▁a", -1.5, 1), ("a", -3, 1), ("b", -3, 1), ("ab", -2.6, 1), ("▁ab", -6, 1), ("bb", -1, 1)):
        proto.pieces.add(piece=p, score=s, type=t)
    model = pieces.Pieces(proto.SerializeToString())
    best = lambda w: max((sum(model.score[i] for i in c), c) for c in splits(w))[1]

    def splits(w):
        return [[]] if not w else [[model.vocab[w[:k]]] + rest for k in range(1, len(w) + 1) if w[:k] in model.vocab for rest in splits(w[k:])]

    words = sorted(["▁a", "▁ab", "▁abb", "▁abba", "▁b", "▁bb"])
    assert model.encode_sorted(words) == [best(w) for w in words]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[100:300] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0]), (980, [])]
    t = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, score int")
    got = {}
    for r in learned_ann.search(t, F.col("vec_id") % 20 == 0, rows_per_part=100, sample_rows=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert np.allclose([f[2] for f in found], [s[f[1]] for f in found])
        assert [f[1] for f in found] == sorted((f[1] for f in found), key=lambda i: (-round(s[i], 9), i))
        hit += sum(s[f[1]] >= s[want[-1]] - 1e-9 for f in found)
    assert hit >= 0.9 * 20 * len(got)
    assert learned_ann.search(t.limit(0), F.lit(True)).count() == 0


def test_suffix_dedup(odd):
    docs, rows = odd
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 399):
            if seen[t[p:p + 400]] > 1:
                gone[p:p + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(i, len(t), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_near_duplicates(odd):
    docs, rows = odd
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    low = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), low[g]) for (i, _), s, g in zip(rows, sets, group))


def test_near_duplicates_keep_recall_in_deep_trees(spark):
    # pairs at 0.80 to 0.83 in a crowd that shares words of one pool: with small nodes every tree branches on;
    # few trees and a low depth make the misses of the deeper levels countable
    rng = random.Random(5)
    rows, sets = [], []
    for pair in range(1200):
        common = [f"c{i}" for i in range(100) if rng.random() < 0.45]
        size = len(common) + 20
        swapped = rng.choice([k for k in range(1, 21) if 0.80 <= (size - k) / (size + k) <= 0.83])
        for side in (0, 1):
            words = common + [f"w{pair}_{i}" for i in range(swapped * side, 20)] + [f"w{pair}_{side}_{i}" for i in range(swapped * side)]
            sets.append(set(words))
            rng.shuffle(words)
            rows.append((len(rows), " ".join(words)))
    # brute force: documents are linked inside their pair only
    for a in rng.sample(range(2400), 60):
        assert [b for b in range(2400) if b != a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] == [a ^ 1]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=1, trees=2, depth=1, node_limit=2).collect()
    assert len(got) == len(rows) and all(r.component_id in (r.doc_id, r.doc_id // 2 * 2) for r in got)
    missed = sum(r.doc_id % 2 == 1 and r.component_id == r.doc_id for r in got)
    assert missed <= 1200 * (1 - 0.8 * 15 / 16) ** 2                   # the stated bound; 1.5 branchings a level miss up to 1200 * 0.25


def test_decontamination(spark, odd):
    docs, rows = odd
    bench = [(1, " ".join(rows[4][1].split()[100:130])), (2, "one"), (3, None), (4, "never seen here"), (10, " ".join(rows[7][1].split()[4:30]))]
    words = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())
    want = Counter()
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            v = words(b)
            for win in ([v] if 0 < len(v) < 13 else [v[k:k + 13] for k in range(len(v) - 12)]):
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        items.add(str(item))
        want[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    got = decontaminate.contamination(docs, spark.createDataFrame(bench, "item_id bigint, text string"), keep=["doc_id"]).drop("spans").collect()
    assert Counter(map(tuple, got)) == want


def test_classifiers_on_held_out_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for name, of, column in (("op5_toxicity", 4, "toxic"), ("op8_rule_quality", 5, "quality")):
        rows = jobs.QUERIES[name](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
        assert sum(r.predicted == r[column] for r in rows) >= 0.9 * len(rows)
    model = rule_quality.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in rule_quality.score_quality(odd[0], model).collect())
    kept = rule_quality.fit(docs, labels.limit(0))
    assert {round(r.score, 3) for r in rule_quality.score_quality(odd[0], kept).collect()} == {0.5}
    assert rule_quality.score_quality(odd[0].limit(0), model).count() == 0
    assert toxicity.drop_toxic(odd[0], labels.limit(0)).count() == odd[0].count()


def test_rules_equal_their_columns(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    model = rule_quality.RuleModel([((0, True, 6.0), (2, False, 0.5)), ((9, False, 5.5),)], [1.5, -2.0], 0.25)
    for r in rule_quality.statistics(docs.select("doc_id", "text")).withColumn("score", model.score()).collect():
        x = np.array([r.stats])
        z = 0.25 + sum(w * float(rule_quality.holds(rule, x)[0]) for rule, w in zip(model.rules, model.weights))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12


def test_licences(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", gpl, True), (2, "a/b/c/x.txt", "plain words", False), (3, "a/b/LICENSE", "Released under the MIT License.", True), (4, "a/d/y", None, False), (5, "e/z", "Copyright nobody.", False),
            (6, None, "words", False), (7, "q/r", "Some words. Licensed under the Apache License, Version 2.0. More words.\nend", None), (2, "a/b/c/x.txt", "plain words", False), (8, "top", "", False)]
    files = spark.createDataFrame(rows, "file bigint, path string, text string, is_licence_file boolean")
    got = sorted((r.file, r.licence, r.origin, r.folder) for r in licences.scan(files).na.fill("").collect())
    assert got == sorted([(1, "GPL-3.0", "own", ""), (2, "MIT", "inherited", "a/b"), (2, "MIT", "inherited", "a/b"), (3, "MIT", "own", ""), (4, "GPL-3.0", "inherited", "a"), (5, "", "none", ""),
                          (6, "", "none", ""), (7, "Apache-2.0", "own", ""), (8, "", "none", "")])
    assert licences.scan(files.limit(0)).count() == 0


def test_licence_sentences_of_licence_files(spark):
    # a licence file holds other words; files of any length grant by a header that is all they hold or speaks for the folder
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "a/x", "Atly ingnd thintion thheeshe ering and oneaor of rentating.\nReleased under the MIT License.", True), (2, "a/y", words, False),
            (3, "b/x", f"{words}.\nThis project is licensed under CC BY 4.0.\n{words}", False), (4, "b/y", words, False),
            (5, "c/x", "\nLicensed under the Apache License, Version 2.0.\n", False), (6, "c/y", words, False),
            (7, "d/x", f"{words}.\nReleased under the MIT License.", False), (8, "d/y", words, False)]
    files = spark.createDataFrame(rows, "file bigint, path string, text string, is_licence_file boolean")
    got = sorted((r.file, r.licence, r.origin, r.folder) for r in licences.scan(files).na.fill("").collect())
    assert got == [(1, "MIT", "own", ""), (2, "MIT", "inherited", "a"), (3, "CC-BY-4.0", "own", ""), (4, "CC-BY-4.0", "inherited", "b"),
                   (5, "Apache-2.0", "own", ""), (6, "Apache-2.0", "inherited", "c"), (7, "MIT", "own", ""), (8, "", "none", "")]


def test_shards(odd):
    docs, rows = odd
    got = kd_shards.shard(docs, 5).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 16) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(5))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    largest = max(r.size for r in got)
    assert max(sum(r.size for r in s) for s in by.values()) <= sum(r.size for r in got) / 5 + 3 * largest
    assert kd_shards.shard(docs.limit(0), 5).count() == 0


def test_small_groups_of_equal_texts_share_a_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kd_shards.shard(docs, 8).join(docs.select("doc_id", F.sha2("text", 256).alias("g")), "doc_id").collect()
    total, size, where = sum(r.size for r in rows), Counter(), {}
    for r in rows:
        size[r.g] += r.size
        where.setdefault(r.g, set()).add(r.shard)
    small = [g for g in where if size[g] * 8 * kd_shards.WHOLE <= total]
    assert sum(1 for r in rows if r.g in set(small)) > len(small) and all(len(where[g]) == 1 for g in small)
    by = Counter()
    for r in rows:
        by[r.shard] += r.size
    assert max(by.values()) <= 1.1 * total / 8 and min(by.values()) >= 0.9 * total / 8


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, BASE)
        if name != "sentencepiece":
            assert out.columns == columns
        assert out.count() <= rows.count()
        rows = out
    assert rows.where("not round_trip").count() == 0
    assert 0.6 * docs.count() <= rows.count() <= docs.count()


def test_near_duplicates_without_ids_and_below_large_nodes(spark):
    rnd = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows = [(None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (None, None)]
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((None if i % 50 == 0 else 100 + i, " ".join(words)))
    sets = [frozenset(zip(w, w[1:])) for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter((i, least.get(r) if t else i) for (i, t), r in zip(rows, root))
    assert Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(table, node_limit=16).collect()) == want
    kept = neardup.drop_near_duplicates(table.where("doc_id is null or doc_id < 100"), words=2).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept)[0] == (0, "") and 5 in {r.doc_id for r in kept}
    assert not any(r.doc_id is None and (r.text or "").startswith("a b") for r in kept)


def test_sibling_licences_and_negations(spark):
    heads = {"Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
             "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
             "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
             "This is not released under the MIT License.": None, "Licensed under the Apache License, Version 1.1.": None,
             "Released under the ISC License.": "ISC", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
             "Made available under the terms of the Eclipse Public License 2.0": "EPL-2.0"}
    files = spark.createDataFrame([(i, f"f{i}/x", head, True) for i, head in enumerate(heads)], "file bigint, path string, text string, is_licence_file boolean")
    got = {r.file: r.licence for r in licences.scan(files).collect()}
    assert {head: got[i] for i, head in enumerate(heads)} == heads
