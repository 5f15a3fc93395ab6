"""Array kernels over the raw bytes of Arrow text columns, shared by the operators of this subpackage.

Texts are taken in chunks of a few megabytes, so that memory follows the chunk (or one text, where a
single text is longer) and never the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from newsrank.session import cut_lineage, new_folder

CHUNK_BYTES = 2 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def byte_codes(salt: int = 0, lower: bool = True) -> np.ndarray:
    """A random-looking 64-bit code per byte; with ``lower`` A-Z share the codes of a-z."""
    low = np.arange(256)
    if lower:
        low[65:91] += 32
    return mix((low + 1 + 1000 * salt).astype(_U) * _BASE)


class Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def __reduce__(self):
        """Travels without its tables, which each worker grows again: task code stays small."""
        return Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            full = np.full(size, _BASE, _U)
            full[0] = 1
            self.up = np.cumprod(full, dtype=_U)
            full[1:] = _BASE_INV
            self.down = np.cumprod(full, dtype=_U)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of code * base^k over bytes i..j-1."""
    out = np.zeros(len(data) + 1, _U)
    up, _ = POWERS.upto(len(data) + 1)
    np.cumsum(codes[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [a, b) of at most ``limit`` bytes, or one row where that row alone is longer."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES):
    """(row range, bytes, offsets) for each chunk of a batch."""
    data, offs = text_bytes(batch.column(batch.schema.get_field_index(name)))
    for a, b in chunks(offs, limit):
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]


# fixed values: the two word classes of the contracts, as byte classes of UTF-8
def _class(excluded) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo:hi + 1] = False
    return table


SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and, for each row, the number of words before it (one more entry than rows)."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, count), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, counts)


def scratch(spark) -> str:
    """A new folder name under the shared folder of the session."""
    return new_folder(spark, "llm")


def stored(df, path: str | None = None):
    """``df`` written to the shared folder and read back: lineage is cut, work is done once, and what the write shuffled is freed."""
    return cut_lineage(df, path or scratch(df.sparkSession))


HOT_SHARE = 1000


def spread_join(rows, table, key: str):
    """Left join of ``rows`` with ``table`` (one row a key, and its frequency in ``rows`` as ``n``), safe for hot keys.

    Keys that hold more than a thousandth of the rows, which are fewer than a thousand, come by broadcast; the other rows
    are joined by a shuffle. ``rows`` should be stored.
    """
    from pyspark.sql import functions as F

    total = F.broadcast(table.agg(F.sum("n").alias("__total")))
    hot = table.crossJoin(total).where(F.col("n") * HOT_SHARE > F.col("__total")).drop("__total")      # the total is one row
    is_hot = F.broadcast(hot.select(key))
    first = rows.join(F.broadcast(hot.drop("n")), key)
    rest = rows.join(is_hot, key, "left_anti").join(table.drop("n").join(is_hot, key, "left_anti"), key, "left")
    return first.unionByName(rest)
