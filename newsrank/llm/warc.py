"""WARC archives without repeated payloads, and reading them back.

1. Headers only (id, payload digest, payload size) are grouped by digest with map-side combine; of equal payloads
   of at least ``least_bytes`` bytes the largest id is the original.
2. Each header meets the original of its digest. The thousand most frequent digests, the only ones that can hold more
   than a thousandth of the rows, come by broadcast (at most 1,000 rows of three numbers and a digest); the others
   by a shuffle on the digest.
3. Decisions meet the pages by id and digest: payloads travel once. Originals become response records, the others
   revisit records with a fresh header that names the original, and both are written as WARC 1.1 in gzip files.
4. ``read_archives`` walks the files by Content-Length, checks each stored payload against its digest and returns
   one row a record.

The text writer closes each record with the line feed that ends its last CRLF CRLF, so an unpacked part file is a WARC file
as it is (named .txt.gz; one gzip member a file). A file has at most about ``archive_bytes`` unpacked, or one record.

Null html is an empty payload; small and empty payloads are always responses. A null id is kept, and is never
an original. Rows that repeat the original's own id are responses too. Line breaks in a url become spaces; extra
columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

END = "\r\n"
HOT = 1000
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string, intact boolean"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of every page."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html).alias("payload_digest"), F.octet_length(html).cast("bigint").alias("payload_bytes"))


def resolve(heads: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the distinct headers that revisit another one."""
    large = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    originals = K.stored(large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"))
    hot = originals.orderBy(F.desc("n"), "payload_digest").limit(HOT)
    marked = heads.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest").distinct()
    marked = K.stored(marked.join(F.broadcast(hot.drop("n")), "payload_digest", "left"))
    cold = marked.where("refers_to is null").drop("refers_to").join(
        originals.drop("n").join(F.broadcast(hot.select("payload_digest")), "payload_digest", "left_anti"), "payload_digest")
    found = marked.where("refers_to is not null").select("page_id", "payload_digest", "refers_to").unionByName(cold.select("page_id", "payload_digest", "refers_to"))
    return found.where("page_id is null or page_id != refers_to")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One ``value`` a page: its WARC record up to the last carriage return."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("digest"))
    other = revisits.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "refers_to")
    rows = rows.join(other, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
             F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
             F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
             F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.when(again, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "), _record_id(F.col("refers_to")))),
             F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return rows.select(F.concat(F.concat_ws(END, *lines), F.lit(END + END), block, F.lit(END + "\r")).alias("value"))


#: Payload sizes that share files: records of up to so many bytes, and how many of them a file of 16 MB holds.
SIZE_CLASSES = [(16 << 10, 1000), (256 << 10, 64), (4 << 20, 4)]


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, archive_bytes: int = 16 << 20) -> None:
    """Write every page as a record to gzip files under ``path``, of about ``archive_bytes`` before compression at most.

    Records share files with records of like size, so one long page does not make all files short; a page above the last
    class has a file of its own.
    """
    heads = K.stored(headers(pages))
    revisits = resolve(heads, least_bytes)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    tops = [top for top, _ in SIZE_CLASSES]
    kind = F.lit(len(tops))
    for k in range(len(tops) - 1, -1, -1):
        kind = F.when(F.col("payload_bytes") <= tops[k], k).otherwise(kind)
    found = [r[0] for r in heads.select(kind.alias("k")).distinct().collect()] or [0]                 # at most four
    for k in found:
        per_file = max(1, SIZE_CLASSES[k][1] * archive_bytes >> 24) if k < len(tops) else 1
        low, high = (tops[k - 1] if k else -1), (tops[k] if k < len(tops) else 1 << 62)
        part = pages.where((size > low) & (size <= high))
        records(part, revisits).write.option("maxRecordsPerFile", per_file).option("lineSep", "\n").option("compression", "gzip").text(f"{path}/size={k}")


_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def split_records(data: bytes):
    """(header fields, block) of each record of a file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        fields = {k.lower(): v for k, v in _FIELD.findall(data[at:stop])}
        end = stop + int(fields[b"content-length"])
        if not data.startswith(b"WARC/1.1\r\n", at) or data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        yield fields, data[stop:end]
        at = end + 4


def _page(record_id: bytes | None) -> int | None:
    number = (record_id or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number not in (b"", b"none") else None


def _parse(keep_text: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in split_records(gzip.decompress(content.as_py())):
                    cut = block.index(b"\r\n\r\n") + 4
                    http = {k.lower(): v for k, v in _FIELD.findall(block[:cut])}
                    kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    payload = block[cut:]
                    stored = kind == "response"
                    intact = hashlib.sha1(payload).hexdigest() == digest and len(payload) == int(http[b"content-length"]) if stored else None
                    rows.append((_page(fields[b"warc-record-id"]), fields[b"warc-target-uri"].decode(), int(http[b"content-length"]), digest, kind,
                                 _page(fields.get(b"warc-refers-to")), payload.decode() if stored and keep_text else None, intact))
                    held += len(block)
                    if held > K.CHUNK_BYTES or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_archives(spark: SparkSession, path: str, keep_text: bool = True) -> DataFrame:
    """A row for each record: page_id, url, payload size and digest, type, the record it refers to, html and whether it is intact.

    ``html`` and ``intact`` are null for revisits.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    # one file a batch: what a task holds is one archive
    return files.select("content").mapInArrow(_parse(keep_text), RECORD)


def archive(pages: DataFrame, least_bytes: int = 1000, keep_text: bool = True) -> DataFrame:
    """Write the pages to a new folder in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = K.scratch(spark)
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path, keep_text)
