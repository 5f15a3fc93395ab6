"""One registered query for each operator, over its whole table, and checker SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced_search, conversation_trie, kd_shards, learned_ann, licences, pieces, rule_quality, toxicity, warc
from .decontaminate import contamination
from .neardup import near_duplicates
from .recompression import repeated_runs
from .suffix_dedup import repeated_spans

ORACLES: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written with revisits for repeated payloads and read back."""
    rows = warc.archive(read(spark, folder, "pages"), keep_text=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS dig FROM p),
o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY dig) END AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, dig AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM o"""


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece numbers of each document and the digest of the text decoded from them."""
    return pieces.encode(read(spark, folder, "documents"), keep=["doc_id"], check=True)


def op3_learned_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest vectors found for every vector whose id is divisible by 20."""
    return learned_ann.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Removed bytes, runs and the digest of what is left, for each document."""
    return repeated_spans(read(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score and verdict of each document; labels of the held-out quarter are never read."""
    docs = read(spark, folder, "documents")
    model = toxicity.fit(docs, read(spark, folder, "labels"), held_out=(4, 2))
    return toxicity.score_toxicity(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near duplicates of each document."""
    return near_duplicates(read(spark, folder, "documents"))


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of each document, its own or its folder's.

    A document lies at source/lang/doc_id; one of at most 60 words that names a licence is its folder's licence file, and
    longer ones grant where their best header is all they hold or speaks for the folder.
    """
    docs = read(spark, folder, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    # sixty words have at most 59 gaps: a short text is told without splitting a long one
    short = F.when(F.length("text") < 1000, F.size(F.split("text", r"\s+")) <= 60).otherwise(False)
    rows = licences.scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text", short.alias("is_licence_file")))
    return rows.withColumnRenamed("file", "doc_id")


def op8_rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score and verdict of each document; labels of the held-out fifth are never read."""
    docs = read(spark, folder, "documents")
    model = rule_quality.fit(docs, read(spark, folder, "labels"), held_out=(5, 0))
    return rule_quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Forty shards of near equal bytes."""
    rows = kd_shards.shard(read(spark, folder, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words hit by benchmark windows, the items found and the verdict, for each document."""
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    return found.drop("spans")


def op11_recompression(spark: SparkSession, folder: str) -> DataFrame:
    """Words removed as part of a run of twenty that occurs earlier, and what is left, for each document."""
    return repeated_runs(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").alias("text"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    return bitsliced_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


ORACLES["op12_ranked_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (
  SELECT q.item_id, p.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + ((75 * p.n * s.nd) // s.nt))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie.trie(read(spark, folder, "conversations"))


ORACLES["op13_conversation_trie"] = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS place FROM t),
crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM t
  UNION ALL
  SELECT conv_id, s, i + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END AS x FROM crc WHERE i < 8 * length(s))),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(s)),
r AS (
  SELECT h.conv_id, 0 AS part, p.place, p.role, p.text FROM h JOIN p ON p.conv_id = h.base AND p.place <= h.h
  UNION ALL
  SELECT h.conv_id, 1, p.place, p.role, p.text FROM h JOIN p ON p.conv_id = h.conv_id AND p.place > h.h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text FROM r),
k AS (
  SELECT conv_id, 0 AS depth, '' AS key, 0 AS bytes FROM h
  UNION ALL
  SELECT k.conv_id, q.depth, sha256(k.key || ';' || strlen(q.role) || ':' || q.role || q.text), strlen(q.text)
  FROM k JOIN q ON q.conv_id = k.conv_id AND q.depth = k.depth + 1),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM k GROUP BY ALL),
up AS (  -- node and its parent's smallest member
  SELECT a.depth, a.key, b.conv_id AS parent
  FROM n a JOIN k m ON m.conv_id = a.conv_id AND m.depth = a.depth - 1 JOIN n b ON b.depth = m.depth AND b.key = m.key),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS c FROM up GROUP BY ALL),
v AS (SELECT n.*, coalesce(kids.c, 0) AS kids, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n - 1) * n.bytes END AS val
      FROM n LEFT JOIN kids ON kids.parent = n.conv_id AND kids.depth = n.depth),
sub AS (  -- each node's sums at all its ancestors, along the path of its smallest member
  SELECT m.depth, m.key, sum(CAST(v.kids = 0 AS BIGINT)) AS leaves, sum(v.val) AS saved
  FROM v JOIN k m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY ALL),
fin AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
e AS (SELECT k.depth, k.key, string_agg(CAST(k.conv_id AS VARCHAR), ',' ORDER BY k.conv_id) AS ids FROM fin JOIN k USING (conv_id, depth) GROUP BY ALL)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, up.parent AS parent_conv_id, v.n AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
       CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN sub USING (depth, key) LEFT JOIN up USING (depth, key) LEFT JOIN e USING (depth, key)"""


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_sentencepiece, op3_learned_ann, op4_suffix_dedup, op5_toxicity, op6_near_duplicates, op7_licences, op8_rule_quality, op9_kd_shards, op10_decontamination, op11_recompression, op12_ranked_search, op13_conversation_trie)}
