"""Machinery shared by the operators: checkpoints, word and window hashing over
whole Arrow buffers, and a blocked exchange of hash sets between text chunks.

Text is dealt into chunks by a hash of the row. A chunk sends its sorted distinct
hashes to range buckets of the hash space as packed binary messages; a bucket sees
every chunk's hashes of its range, so it can count occurrences over the whole
corpus and answer each chunk with bitmaps in the order of the message. One
(chunk, bucket) pair is one row, so no row per word ever enters the JVM, and a hash
that is in a third of all rows reaches its bucket at most once per chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_C1, _C2, _C3 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64

#: Words of a chunk, and hashes of a bucket, at the least; see ``sizes``.
LOAD = 1_000_000


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in spark.checkpoint.dir.

    A session without that setting (tests, a notebook) gets a folder in the warehouse.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(where or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x *= _C1
    x ^= x >> U64(29)
    x *= _C2
    x ^= x >> U64(32)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, padded by 8 zero bytes, and n + 1 offsets. Null: empty.

    ``lower`` turns A-Z, and nothing else, into lower case.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # of no chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = _LOWER[raw] if lower else raw
    return buf, offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the words of each document."""
    n = int(offs[-1])
    ink = ~_WS[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last[:-1] &= ~ink[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = ends - starts
    h = mix((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(U64) * _C3)
    rest, done = np.flatnonzero(size > 8), 8
    while rest.size:
        part = eight[starts[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]
        h[rest] = mix(h[rest] * _C3 + part)
        done += 8
        rest = rest[size[rest] > done]
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, by doubling; kept by size."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(1, U64)
            while len(p) < size:
                p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
            both.append(p)
        _powers[size] = (both[0], both[1])
    return _powers[size]


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a word stream, for ``window_hash``."""
    out = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _power(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each of ``at``."""
    return mix((prefix[at + width] - prefix[at]) * _power(len(prefix))[1][at])


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions in the word stream from which ``width`` words lie in one document."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(int(counts.sum()))
    return np.flatnonzero(left >= width)


def sizes(words: int) -> int:
    """Number of chunks, and of buckets, for so many words.

    Both hold LOAD words until messages would fall below 64 hashes; from there (about
    16 billion words) both grow with the root of the corpus, to some 32 million words
    for 100 TB, so messages stay packed while a group still fits a worker.
    """
    return max(1, math.ceil(words / max(LOAD, math.isqrt(64 * max(words, 1)))))


def chunked(docs: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Rows dealt into ``n`` chunks by a hash of the row, whatever its source."""
    return docs.select(*columns, F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias("chunk"))


def total_words(docs: DataFrame, column: str = "text") -> int:
    """Words of the corpus, taken as one per six bytes; only sizes depend on it."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 6


def canonical(group: pa.Table, key: str, column: str = "text") -> pa.Table:
    """The group in an order that does not depend on how a shuffle delivered it."""
    buf, offs = text_buffer(group[column])
    import xxhash

    view = memoryview(buf)
    digest = pa.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.uint64())
    order = pa.compute.sort_indices(pa.table({"k": group[key], "d": digest}), [("k", "ascending"), ("d", "ascending")])
    return group.take(order)


def deal(u: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's share of the sorted hashes ``u``."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])


def packed_rows(rows: list[tuple], schema: str) -> pa.Table:
    """An Arrow table of a DDL schema from tuples."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table({n: pa.array(c, types[t]) for (n, t), c in zip(fields, columns, strict=True)})


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' component, by label propagation with jumps."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        new = np.minimum(new[new], new[low])
        if (new == low).all():
            return low
        low = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table by alternating large and small stars.

    Returns ``node, component`` (the smallest node reachable) for every node but the
    smallest of each component. Minima are combined before they are shuffled, and each
    round is checkpointed, so neither hubs nor long chains meet in one task or plan.
    """
    e = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("s"), "m")
        e = settle(small.select(F.col("s.x").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def slices(batches, column: int, most: int = 4 << 20):
    """Arrow batches cut into runs of rows of about ``most`` bytes of one text column, so a worker's
    arrays stay small whatever the batch size; one text longer than that is a run of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(run)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Give freed memory back to the system: a reused worker would hold it through later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
