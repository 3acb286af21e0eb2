"""Positional postings, ranking by minimal covers, and top-k that skips blocks.

A query is a disjunction of groups of terms: a chunk matches if it has all terms of a group. Its
score is the sum of 0.1 / (1 + noise) over its minimal covers, the shortest stretches of tokens
that hold a whole group; noise is how many tokens in a stretch the query doesn't name. Of single
terms every occurrence is a cover of its own.

An index is a table with a row for each term and block of chunks: the chunks that have the term, where
it stands in each, and the largest number of its occurrences in one. Every task writes what it read
as a segment of its own, sorted by bucket of terms, term and block, so nothing is shuffled; a block
whose chunks several tasks read, or one that a task read in several stretches, has several rows. A
query reads the block maxima of its terms, scores the most promising blocks, and then only those
whose bound reaches what the k-th hit has so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import groups_of, tokens

#: Blocks scored before any is skipped; blocks that are named to the scan, rather than joined, at the most.
FIRST, NAMED = 32, 4096
#: Tokens that are grouped at once; a chunk isn't split.
STRETCH = 1 << 19


def _all(columns: list[Column], pick) -> Column:
    """``pick`` of the columns, null where one of them is."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(known, pick(*columns) if len(columns) > 1 else columns[0])


def covers(entries: DataFrame, groups: list[list[str]], id_col: str = "chunk_id") -> DataFrame:
    """``id_col, score`` of chunks that match, from entries (id_col, pos, term) of the groups' terms.

    The shortest cover that ends at an entry begins at the earliest of the last occurrences of its
    group's terms; of covers that begin together the first to end is minimal. A window runs over
    one chunk's own entries.
    """
    terms = sorted({t for g in groups for t in g})
    row = Window.partitionBy(id_col).orderBy("pos", "term")
    at = entries.where(F.col("term").isin(terms)).withColumn("r", F.row_number().over(row))
    for i, t in enumerate(terms):
        at = at.withColumn(f"t{i}", F.last(F.when(F.col("term") == t, F.struct("pos", "r")), ignorenulls=True).over(row))
    begins = [_all([F.col(f"t{terms.index(t)}") for t in dict.fromkeys(g)], F.least) for g in groups]
    at = at.select(id_col, "pos", "r", (F.greatest(*begins) if len(begins) > 1 else begins[0]).alias("begin")).where("begin IS NOT NULL")
    found = at.groupBy(id_col, "begin").agg(F.min("pos").alias("pos"), F.min("r").alias("r"))
    noise = F.greatest(F.col("pos") - F.col("begin.pos") - (F.col("r") - F.col("begin.r")), F.lit(0))
    held = found.groupBy(id_col).agg(F.array_sort(F.collect_list(noise)).alias("noise"))  # summed in one order, so equal scores are equal
    return held.select(id_col, F.aggregate("noise", F.lit(0.0), lambda s, n: s + F.lit(0.1) / (n + 1)).alias("score"))


def _sizes(rows: pa.RecordBatch) -> np.ndarray:
    """How many tokens each chunk has."""
    return pc.fill_null(pc.list_value_length(rows.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _grouped(rows: pa.RecordBatch, id_col: str) -> pa.RecordBatch:
    """Chunks (id_col, block, tokens) by term and block, each group's chunks in the order in which they came."""
    sizes = _sizes(rows)
    chunk, total = np.repeat(np.arange(len(sizes)), sizes), int(sizes.sum())
    pos = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = rows.column("tokens").flatten().dictionary_encode()
    blocks, of = np.unique(rows.column("block").to_numpy(zero_copy_only=False), return_inverse=True)
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(blocks) + of[chunk]
    order = np.argsort(key, kind="stable")  # tokens come by chunk and position, and stay so within a key
    key, chunk = key[order], chunk[order]
    new = np.ones(total, bool)  # the first token of a group
    new[1:] = key[1:] != key[:-1]
    first = new.copy()  # the first one of a chunk in it
    first[1:] |= chunk[1:] != chunk[:-1]
    postings = np.flatnonzero(first)
    groups = np.flatnonzero(new[postings])
    n = np.diff(np.append(postings, total)).astype(np.int32)
    listed = lambda values, at, end: pa.ListArray.from_arrays(pa.array(np.append(at, end), pa.int32()), values)
    key = key[postings[groups]]
    columns = {
        "term": coded.dictionary.take(pa.array(key // len(blocks))), "block": pa.array(blocks[key % len(blocks)], pa.int64()), "most": pa.array(np.maximum.reduceat(n, groups)),
        "ids": listed(rows.column(id_col).take(pa.array(chunk[postings])), groups, len(n)), "n": listed(pa.array(n), groups, len(n)),
        "positions": listed(listed(pa.array(pos[order], pa.int32()), postings, total), groups, len(n)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def positional(chunks: DataFrame, block: Column, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``term, block, most, ids, n, positions``: by term and block the chunks that have it, how often, and where it stands in each.

    Chunks are grouped where they are read, a stretch of them at a time.
    """
    most = STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at, had = _sizes(batch).cumsum(), 0, 0
            while at < len(ends):
                end = max(int(np.searchsorted(ends, had + most, "right")), at + 1)
                if ends[end - 1] > had:
                    yield _grouped(batch.slice(at, end - at), id_col)
                at, had = end, int(ends[end - 1])

    rows = chunks.select(id_col, F.coalesce(block.cast("long"), F.lit(0)).alias("block"), tokens(F.col(text_col)).alias("tokens"))
    return rows.mapInArrow(run, f"term string, block long, most int, ids array<{dict(chunks.dtypes)[id_col]}>, n array<int>, positions array<array<int>>")


def write_postings(chunks: DataFrame, path: str, buckets: int = 256, block: Column | None = None, id_col: str = "chunk_id", text_col: str = "text") -> None:
    """Write an index of chunks, whose ids differ. ``block`` is a chunk's block number: a stretch of ids, or by
    default a hash in 1,024; the smaller the part of the blocks that a task reads, the fewer rows there are."""
    home = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    rows = positional(chunks, F.pmod(F.xxhash64(id_col), F.lit(1024)) if block is None else block, id_col, text_col)
    rows.select(home, "*").sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").parquet(f"{path}/postings")


class Postings:
    """An index on disk, of as many buckets as it was written with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, id_col: str = "chunk_id"):
        self.spark, self.buckets, self.id_col = spark, buckets, id_col
        self.rows = spark.read.parquet(f"{path}/postings")

    def _of(self, df: DataFrame, terms: list[str]) -> DataFrame:
        """A table's rows of some terms; bucket and term reach the scan."""
        named = self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int"))
        return df.where(F.col("bucket").isin(sorted({r[0] for r in named.collect()})) & F.col("term").isin(terms))

    def bounds(self, groups: list[list[str]]) -> DataFrame:
        """``block, bound``: what no chunk of a block that holds a whole group can exceed, in occurrences."""
        terms = sorted({t for g in groups for t in g})
        wide = self._of(self.rows, terms).groupBy("block").agg(*[F.max(F.when(F.col("term") == t, F.col("most"))).alias(f"m{i}") for i, t in enumerate(terms)])
        whole = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"m{terms.index(t)}").isNotNull() for t in g]) for g in groups])
        return wide.where(whole).select("block", sum((F.coalesce(F.col(f"m{i}"), F.lit(0)) for i in range(len(terms))), F.lit(0)).alias("bound"))

    def scores(self, groups: list[list[str]], rows: DataFrame) -> DataFrame:
        """``id_col, score`` of the chunks of some postings rows."""
        own = F.col("x.ids").alias(self.id_col)
        if all(len(g) == 1 for g in groups):
            return rows.select(F.explode(F.arrays_zip("ids", "n")).alias("x")).groupBy(own).agg((F.sum("x.n") * F.lit(0.1)).alias("score"))
        each = rows.select("term", F.explode(F.arrays_zip("ids", "positions")).alias("x"))
        return covers(each.select(own, "term", F.explode("x.positions").alias("pos")), groups, self.id_col)

    def topk(self, query: str, k: int) -> DataFrame:
        """``keyword_topk`` of the indexed chunks. Exact: a block is skipped only if none of its chunks can reach the k-th hit."""
        groups = groups_of(query)
        best = [F.desc("score"), F.col(self.id_col)]
        if not groups:
            return self.rows.select(F.explode("ids").alias(self.id_col), F.lit(0.0).alias("score")).limit(0)
        rows, bounds = self._of(self.rows, sorted({t for g in groups for t in g})), self.bounds(groups)
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        early = self.scores(groups, rows.where(F.col("block").isin(first))).orderBy(*best).limit(k).collect()
        least = min((r.score for r in early), default=0.0) if len(early) == k else 0.0
        left = bounds.where((F.col("bound") * F.lit(0.1) >= least - 1e-9) & ~F.col("block").isin(first))
        named = [r.block for r in left.select("block").limit(NAMED + 1).collect()]
        wanted = rows.where(F.col("block").isin(first + named)) if len(named) <= NAMED else rows.join(left.select("block"), "block", "left_semi").unionByName(rows.where(F.col("block").isin(first)))
        return self.scores(groups, wanted).orderBy(*best).limit(k)
