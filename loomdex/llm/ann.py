"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every row is indexed under
its nearest centroid with a byte for each part of its residual. A query probes the lists of
the centroids of largest inner product. In a list, its asymmetric tables (the query's parts
against each codeword) score all codes, and the best by code are ranked again by the exact
inner product of the original vectors in double precision.

Lists are dealt into cells of bounded size: short lists share one, a long one is cut, so a
vector that makes up a third of all rows fills many cells, not one task. A query is sent once to
each cell that it probes a list of, not once for each list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settle

#: Vectors that the centroids and codebooks are fitted on, in expectation.
SAMPLE = 20_000
#: Rows of a cell, about.
CELL = 16_384
#: Sample rows that a list is fitted on at the least; bounds the lists by the sample.
FIT = 5
#: Sample rows whose own neighbours, among the sample, tell how many lists must be probed.
TRIALS = 512


def _valid(vec: str, dim: int | None = None) -> str:
    """Not null, of finite components, and not zero."""
    test = f"{vec} IS NOT NULL AND size({vec}) > 0 AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vec}, x -> x <> 0)"
    return test if dim is None else f"{test} AND size({vec}) = {dim}"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from distinct sample rows; empty clusters take the farthest rows."""
    x = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    c = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * (x @ c.T)
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d[np.arange(len(x)), near])[: len(empty)]]
    return c


class Index:
    """Centroids and codebooks of a product quantiser with ``parts`` bytes a vector."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = 16):
        self.dim = sample.shape[1]
        self.parts = max(m for m in range(1, min(parts, self.dim) + 1) if self.dim % m == 0)
        self.centroids = kmeans(sample, lists)
        near = self.assign(sample)
        rest = (sample - self.centroids[near]).astype(np.float32).reshape(len(sample), self.parts, -1)
        self.books = []
        for m in range(self.parts):
            book = kmeans(rest[:, m], 256, 8, m)
            self.books.append(np.vstack([book, np.repeat(book[:1], 256 - len(book), 0)]))

    def assign(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return ((c * c).sum(1) - 2 * (x.astype(np.float32) @ c.T)).argmin(1)

    def probes(self, sample: np.ndarray, k: int, share: float) -> int:
        """Lists to probe, by inner product of the centroids, so that they hold ``share`` of the ``k`` nearest
        in the sample of TRIALS of its rows. Neighbours in all rows are nearer than those in a
        sample, so what is enough here is enough there."""
        trial = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(int))
        place = np.empty((len(trial), len(self.centroids)), np.int64)
        order = np.argsort(-(sample[trial].astype(np.float32) @ self.centroids.T), axis=1, kind="stable")
        np.put_along_axis(place, order, np.arange(len(self.centroids))[None, :], 1)
        score = sample[trial] @ sample.T
        score[np.arange(len(trial)), trial] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centroids)
        near = np.argpartition(-score, k - 1)[:, :k]
        needed = np.sort(np.take_along_axis(place, self.assign(sample)[near], 1).ravel())
        return int(needed[math.ceil(share * len(needed)) - 1]) + 1

    def codes(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        rest = (x - self.centroids[near]).astype(np.float32).reshape(len(x), self.parts, -1)
        return np.stack([((b * b).sum(1) - 2 * (rest[:, m] @ b.T)).argmin(1) for m, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric distance tables: each query's parts against each codeword."""
        parts = q.astype(np.float32).reshape(len(q), self.parts, -1)
        return [parts[:, m] @ b.T for m, b in enumerate(self.books)]

    @staticmethod
    def adc(near: np.ndarray, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Asymmetric scores: each query's with a list's centroid, and its tables' at each code of the list."""
        out = np.repeat(near[:, None], len(codes), 1)
        for m, t in enumerate(tables):
            out += t[:, codes[:, m]]
        return out


def _cells(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first cell and how many it has: long lists are cut, short ones share cells in order."""
    parts = np.maximum(1, -(-size // CELL))
    first, cell, held = np.zeros(len(size), np.int64), -1, CELL + 1
    for i, (n, k) in enumerate(zip(size.tolist(), parts.tolist())):
        if k > 1 or held + n > CELL:
            cell, held = cell + 1, 0
        first[i], held = cell, held + n if k == 1 else CELL + 1
        cell += k - 1
    return first, parts


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.95, shortlist: int = 400, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` (same columns), itself left out by id.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``: largest inner product first, ties
    to the smaller id; fewer rows where there are fewer candidates. Vectors that are null,
    zero, hold a null or non-finite component, or have another length than most take no part
    on either side, nor do null ids. Repeated rows are candidates each for itself. An empty
    table has no rows. The number of lists is the root of the rows, as far as the sample can
    fit them (a list to FIT of its rows). How many of them a query probes is measured on the
    sample, whatever the table's size: so many that they hold the share ``share`` of its rows'
    own neighbours; where vectors form clusters these are few, where they point everywhere most. In each
    cell the best ``shortlist`` by code of the probed lists are ranked again.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where("vec_id IS NOT NULL").where(_valid("v"))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths
    rows = rows.where(F.size("v") == dim)
    draw = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = np.array([r[0] for r in rows.where(draw).select("v").collect()] or [[0.0] * dim], np.float64)
    sample = sample[np.lexsort(sample.T)]  # a retried job draws the same rows in another order
    index = Index(sample, max(1, min(round(math.sqrt(n)), len(sample) // FIT)))
    lists = len(index.centroids)
    elements = dict(rows.dtypes)["v"]

    def put(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                near = index.assign(x)
                codes = [c.tobytes() for c in index.codes(x, near)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "v", "list", "code"])

    # written once: the sizes of the lists and the search both read it
    indexed = settle(rows.mapInArrow(put, f"vec_id long, v {elements}, list int, code binary"))
    held = dict(indexed.groupBy("list").count().collect())
    size = np.array([held.get(i, 0) for i in range(lists)])
    first, parts = _cells(size)
    probes = index.probes(sample, k, share)

    def ask(batches):
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column(1), dim)
                order = np.argsort(-(q.astype(np.float32) @ index.centroids.T), axis=1, kind="stable")
                # a query is owed k rows besides itself, so it goes on where its lists hold fewer
                need = np.minimum(lists, np.maximum(probes, (np.cumsum(size[order], 1) < k + 1).sum(1) + 1))
                of, cell, near = [], [], []
                for i, m in enumerate(need):
                    probed = np.sort(order[i, :m])
                    at = np.repeat(first[probed], parts[probed])  # a cut list is probed in all of its cells
                    at += np.arange(len(at)) - np.repeat(np.cumsum(parts[probed]) - parts[probed], parts[probed])
                    each = np.repeat(probed, parts[probed])
                    cut = np.flatnonzero(np.diff(at)) + 1
                    of += [i] * (len(cut) + 1)
                    cell += at[np.r_[0, cut]].tolist()
                    near += [x.astype(np.int32).tobytes() for x in np.split(each, cut)]
                take = pa.array(of, pa.int64())
                yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(cell, pa.int32()), pa.array(near, pa.binary())], names=["query_id", "q", "cell", "lists"])

    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("q")).where("query_id IS NOT NULL").where(_valid("q", dim))
    asked = asked.mapInArrow(ask, f"query_id long, q {elements}, cell int, lists binary")
    of_list = lambda x: F.element_at(F.array(*[F.lit(int(c)) for c in x]), F.col("list") + 1)
    left = indexed.withColumn("cell", (of_list(first) + F.pmod(F.xxhash64("vec_id"), of_list(parts))).cast("int"))

    def search(group: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, best, score = [], [], []
        if group.num_rows and wanted.num_rows:
            near, names = group["list"].to_numpy(), group["vec_id"].to_numpy()
            order = np.lexsort((names, near))
            near, names, x = near[order], names[order], _matrix(group["v"], dim)[order]
            codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(names), -1)[order]
            held, start = np.unique(near, return_index=True)
            bounds = np.append(start, len(near))
            q, who = _matrix(wanted["q"], dim), wanted["query_id"].to_numpy()
            probed = np.zeros((len(q), lists), bool)
            for i, y in enumerate(wanted["lists"].to_pylist()):
                probed[i, np.frombuffer(y, np.int32)] = True
            step = max(1, (1 << 22) // len(names))
            for a in range(0, len(q), step):
                some = q[a : a + step]
                tables, centre = index.tables(some), some.astype(np.float32) @ index.centroids[held].T
                rough = np.full((len(some), len(names)), -np.inf, np.float32)
                for j, (l, low, high) in enumerate(zip(held, bounds[:-1], bounds[1:])):
                    ask_it = np.flatnonzero(probed[a : a + step, l])
                    if len(ask_it):
                        rough[ask_it, low:high] = index.adc(centre[ask_it, j], [t[ask_it] for t in tables], codes[low:high])
                rough[names[None, :] == who[a : a + step, None]] = -np.inf
                for i in range(len(some)):
                    few = np.argpartition(-rough[i], shortlist - 1)[:shortlist] if len(names) > shortlist else np.arange(len(names))
                    few = few[rough[i, few] > -np.inf]
                    exact = (x[few] * some[i]).sum(1)
                    top = np.lexsort((names[few], -exact))[:k]
                    ids.append(int(who[a + i]))
                    best.append(names[few][top].tolist())
                    score.append(exact[top].tolist())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "ids": pa.array(best, pa.list_(pa.int64())), "scores": pa.array(score, pa.list_(pa.float64()))})

    found = left.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(search, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.expr("transform(ids, (x, i) -> struct(-scores[i] as far, x as id))").alias("near"))
    pairs = pairs.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = pairs.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
