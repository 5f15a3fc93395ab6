"""What a task of the suffix sort holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newsrank.llm import suffix_dedup


def _buckets(make):
    """What the map side sends for a few hundred texts that share passages, as batches of one bucket."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(4000)]
    pool = [" ".join(rng.choice(words, 120)) for _ in range(20)]
    texts = [" ".join(rng.choice(words, 400)) + pool[i % 20] * (i % 3) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600) * 7 - 1000), pa.array(texts)], ["key", "text"])
    return [b for at in (0, 300) for b in make(batch.slice(at, 300), texts[at:at + 300])]


def _as_spans(batches):
    spans = {}
    for b in batches:
        for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            spans.setdefault(k, []).append(s)
    return {k: suffix_dedup._union(s, 1 << 30).tolist() for k, s in spans.items()}


def _peak(run, batches):
    tracemalloc.start()
    for _ in run(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_suffix_buckets_are_sorted_in_slices_of_bounded_memory(monkeypatch):
    cover = suffix_dedup.singer_cover(7)
    seeds = _buckets(lambda batch, texts: suffix_dedup._seed_blobs(150, 57, cover, 1)([batch]))
    zones = lambda batch, texts: suffix_dedup._suffix_blobs(150, 1)([pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([np.array([[0, len(t) - 149]], "<u4").tobytes() for t in texts])], ["key", "text", "zone"])])
    suffixes = [b.filter(pc.greater_equal(b.column(0), 0)) for b in _buckets(zones)]
    for run, batches, width in ((suffix_dedup._seed_ranks(57), seeds, 9), (suffix_dedup._suffix_ties, suffixes, 8)):
        n = sum(len(x) for b in batches for x in b.column(3).to_pylist()) // (5 if width == 9 else 8)
        whole = _as_spans(run(iter(batches)))
        monkeypatch.setattr(suffix_dedup, "SLICE", max(64, n // 30), raising=False)
        assert len(whole) > 150 and _as_spans(run(iter(batches))) == whole
        # what is held for all entries of a bucket: its bytes as they came and joined, and a slice's share of the rest
        assert _peak(run, batches) < 50 * n
        monkeypatch.undo()


def test_a_denser_cover_sample_makes_more_buckets(spark, monkeypatch):
    seen = []
    blobs = suffix_dedup._seed_blobs
    monkeypatch.setattr(suffix_dedup, "_seed_blobs", lambda length, period, cover, buckets: seen.append(buckets) or blobs(length, period, cover, buckets))
    docs = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(20)], "doc_id bigint, text string")
    names = []
    for length, order in ((400, 13), (150, 7)):
        suffix_dedup.repeated_spans(docs, length, order, 500).count()
        total = sum(len(f"text {i} " * 400) for i in range(20))
        names.append(total * (order + 1) / (order * order + order + 1) / seen[-1])
    assert max(names) <= 500
