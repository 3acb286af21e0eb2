"""Set-similarity self-join of documents on word shingles: size-aware, heavy and light.

Documents with equal sets form one class. Every shingle gets a rarity rank from its
document frequency in the whole corpus; a shingle that only one class holds can't be
shared and is left out of everything below.

* Light (small) sets enumerate their subsets of each size that a partner's size allows
  as overlap; two small sets that link hold a common subset of that size.
* Heavy (large) sets scan inverted lists: a set of n shingles that needs t in common is
  found in the lists of its n - t + 1 rarest.
* The boundary is the largest size for which the enumeration sends no more bytes than the
  lists would, see ``boundary``: 13 shingles at 85 %, 9 at 80 %.

All sets of a list or subset key are taken to the key's leader (its smallest class), where
overlaps are counted exactly, in blocks; only a spanning forest of the links leaves, so
a group of n near copies costs n rows, not n squared.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, chunked, components, deal, mix, packed_rows, prefix_hash, settle, sizes, text_buffer, total_words, trim, union_find, window_hash, window_starts, word_hashes, word_spans

#: Classes that are compared with one another in one task, and shingles of their sets; larger lists are split into pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
_TOKENS = "dest long, chunk int, payload binary, extra binary"
_SUM, _LIST, _NULL = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)


def _up(a: int, b: int) -> int:
    return -(-a // b)


def overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share to reach the similarity."""
    return _up(percent * (n + m), 100 + percent)


def overlaps(n: int, largest: int, percent: int) -> list[int]:
    """The overlaps that partners of at most ``largest`` shingles ask of a set of n."""
    return sorted({overlap(n, m, percent) for m in range(_up(percent * n, 100), min(largest, 100 * n // percent) + 1)})


def boundary(percent: int) -> int:
    """Largest size up to which every size's subsets cost no more than its lists, by what is sent.

    A subset or a list's entry is a row of 16 bytes. A list that others share also brings
    the whole set, of 8 bytes a shingle, to its leader, which a subset does only where
    there is almost surely a link. So a set of n costs one row for each subset, or 1 + n / 2
    for each of its n - t + 1 rarest shingles. (Shingles that no other set has are in neither.)
    """
    size = 0
    while True:
        n = size + 1
        if sum(math.comb(n, c) for c in overlaps(n, n, percent)) > (n - _up(percent * n, 100) + 1) * (1 + n / 2):
            return size
        size = n


def shingle_sets(group: pa.Table, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents end to end, their numbers, and class digests."""
    buf, offs = text_buffer(group[text_col], lower=True)
    starts, ends, counts = word_spans(buf, offs)
    prefix = prefix_hash(word_hashes(buf, starts, ends))
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    flat = np.empty(int(size.sum()), U64)
    whole = np.repeat(counts >= k, size)
    flat[whole] = window_hash(prefix, window_starts(counts, k), k)
    first = (np.cumsum(counts) - counts)[(counts > 0) & (counts < k)]
    short = np.empty(len(first), U64)
    for c in range(1, k):
        of = counts[(counts > 0) & (counts < k)] == c
        short[of] = window_hash(prefix, first[of], c)
    flat[~whole] = short
    bounds = np.cumsum([0, *size])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[bounds[:-1][size > 0]] = True
    of = np.repeat(np.arange(len(size)), size)[keep]
    flat = flat[keep]
    size = np.bincount(of, minlength=len(size))
    digest = mix(np.arange(len(size), dtype=U64))
    if len(flat):
        at = (np.cumsum(size) - size)[size > 0]
        digest[size > 0] = mix(np.add.reduceat(mix(flat ^ _SUM), at) ^ mix(np.add.reduceat(flat, at) + size[size > 0].astype(U64)))
    return flat, size, digest


def _keys(tokens: np.ndarray, rank: np.ndarray, percent: int, largest: int) -> np.ndarray:
    """Subset keys of a light set and list keys of a heavy one (or one that may link with a heavy one)."""
    n, alone = len(tokens), int((rank == 0).sum())
    keys = []
    if n <= largest:
        part = mix(tokens[rank > 0] ^ _SUM)
        for c in overlaps(n, largest, percent):
            if alone <= n - c:
                gone = list(combinations(range(len(part)), n - c - alone))
                sums = part.sum(dtype=U64) - (part[np.array(gone, int)].sum(axis=1, dtype=U64) if gone[0] else np.zeros(1, U64))
                keys.append(mix(sums + U64(c * int(_LIST) % 2**64)))
    if n > largest or 100 * n >= percent * (largest + 1):
        take = n - _up(percent * n, 100) + 1
        rarest = np.lexsort((tokens, rank))[:take]
        keys.append(mix(tokens[rarest[rank[rarest] > 0]] ^ _LIST))
    return np.concatenate(keys) if keys else np.zeros(0, U64)


def _linked(group: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links among the classes of one leader's block pair, counted exactly."""
    order = np.argsort(group["member"].to_numpy(), kind="stable")
    ids, block = group["member"].to_numpy()[order], group["block"].to_numpy()[order]
    payload = group["payload"].to_pylist()
    sets = [np.frombuffer(payload[i], U64) for i in order]
    n = np.array([len(x) for x in sets])
    token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, inverse, seen = np.unique(token, return_inverse=True, return_counts=True)
    shared = seen[inverse] > 1
    token, member = (np.cumsum(seen > 1) - 1)[inverse[shared]], member[shared]
    width = max(1, (1 << 23) // len(sets))
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(token.max(initial=-1)) + 1, width):
        here = (token >= low) & (token < low + width)
        m = np.zeros((len(sets), min(width, int(token.max()) + 1 - low)), np.float32)
        m[member[here], token[here] - low] = 1
        both += m @ m.T
    link = (100 + percent) * both >= percent * (n[:, None] + n[None, :])
    if group["lo"][0].as_py() != group["hi"][0].as_py():
        link &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(link, 1))
    low = union_find(len(sets), a, b)
    far = np.flatnonzero(low != np.arange(len(sets)))
    return pa.table({"a": ids[low[far]], "b": ids[far]})


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose distinct ``k``-word shingles reach a Jaccard similarity of ``percent`` / 100, as components.

    Returns ``id_col, n_shingles, component_id, class_id`` for each row: the set's size, the
    smallest id reachable by links, and the smallest id with the same set. A-Z count as
    lower case; a text of fewer than ``k`` words is one shingle. Null and empty texts link
    with nothing. Repeated rows fall in one class; rows that share an id but not a text
    link through it. A null id is kept with null class and component if its set is its own.
    Other columns don't pass through.

    A set is a set of 64-bit shingle hashes. Ids are integers.

    Shuffles: the text once, four bytes for each distinct shingle of a chunk, and the sets
    of documents that share a rare shingle or subset once for each leader.
    """
    spark = docs.sparkSession
    n = sizes(total_words(docs, text_col))
    largest = boundary(percent)
    text = chunked(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), [id_col, text_col], n)

    def classes(group: pa.Table):
        flat, size, digest = shingle_sets(group, text_col, k)
        ids = np.where(group[id_col].is_null(), _NULL, mix(group[id_col].fill_null(0).to_numpy().astype(U64) ^ _LIST))
        digest = np.where(size > 0, digest, ids)
        first = np.zeros(len(size), bool)
        first[np.unique(digest, return_index=True)[1]] = True
        first &= size > 0
        tokens = flat[np.repeat(first, size)]
        return tokens, size, digest, first

    def send_tokens(group: pa.Table) -> pa.Table:
        tokens, *_ = classes(group)
        u, c = np.unique(tokens, return_counts=True)
        cut, low = deal(u, n), u.astype(np.uint32)
        rows = []
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            if j > i:
                more = np.flatnonzero(c[i:j] > 1)
                rows.append((b, group["chunk"][0].as_py(), low[i:j].tobytes(), np.concatenate([more, c[i:j][more]]).astype(np.uint32).tobytes()))
        return packed_rows(rows, _TOKENS)

    def answer_ranks(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in group["payload"].to_pylist()]
        bounds = np.cumsum([0, *map(len, parts)])
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        held = np.ones(bounds[-1])
        for at, x in zip(bounds, group["extra"].to_pylist()):
            more, c = np.frombuffer(x, np.uint32).reshape(2, -1)
            held[at + more] = c
        rank = np.ceil(np.log2(np.bincount(inverse, held))).astype(np.uint8)[inverse]
        return packed_rows([(group["dest"][0].as_py(), c, b"", rank[i:j].tobytes()) for c, i, j in zip(group["chunk"].to_pylist(), bounds[:-1], bounds[1:])], _TOKENS)

    def index(group: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, size, digest, first = classes(group)
        u, inverse = np.unique(tokens, return_inverse=True)
        rank, cut = np.zeros(len(u), np.uint8), deal(u, n)
        for b, x in zip(answers["dest"].to_pylist(), answers["extra"].to_pylist()):
            rank[cut[b] : cut[b + 1]] = np.frombuffer(x, np.uint8)
        rank = rank[inverse]
        ids = group[id_col].to_pylist()
        names = digest.view(np.int64)
        rows = [(0, 0, i, m, d, b"", b"") for i, m, d in zip(ids, size.tolist(), names.tolist())]
        mine, bounds = np.flatnonzero(first), np.cumsum([0, *size[first]])
        alone = np.add.reduceat(rank == 0, bounds[:-1], dtype=np.int64) if len(mine) else bounds[:0]
        keys, of = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for d, a, b, lone in zip(mine, bounds[:-1], bounds[1:], alone):
            m = int(b - a)
            if lone < m - _up(percent * m, 100) + 1:
                x = _keys(tokens[a:b], rank[a:b], percent, largest)
                if len(x):
                    keys.append(x)
                    of.append(np.full(len(x), digest[d]))
                    rows.append((2, 0, None, m, names[d], tokens[a:b].tobytes(), b""))
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        cut = deal(keys, n)
        rows += [(1, b, None, int(j - i), 0, keys[i:j].tobytes(), of[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
        trim()
        return packed_rows(rows, "kind int, dest long, doc_id long, n long, class long, payload binary, extra binary")

    def lists(group: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, U64) for x in group["payload"].to_pylist()])
        of = np.concatenate([np.frombuffer(x, U64) for x in group["extra"].to_pylist()])
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        distinct = new.copy()
        distinct[1:] |= of[1:] != of[:-1]
        keep = distinct & (np.bincount(run, distinct)[run] > 1)
        leader = of[new][run]
        pairs = np.unique(np.stack([leader[keep], of[keep]], 1).view("V16"))
        both = pairs.view(np.int64).reshape(-1, 2)
        return pa.table({"leader": both[:, 0].copy(), "member": both[:, 1].copy()})

    tokens = text.groupBy("chunk").applyInArrow(send_tokens, _TOKENS)
    ranks = tokens.groupBy("dest").applyInArrow(answer_ranks, _TOKENS)
    indexed = settle(text.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(index, "kind int, dest long, doc_id long, n long, class long, payload binary, extra binary"))
    rows = indexed.where("kind = 0").select("doc_id", "n", "class")
    sets = indexed.where("kind = 2").groupBy("class").agg(F.first("n").alias("size"), F.first("payload").alias("payload"))
    pairs = settle(indexed.where("kind = 1").select("dest", "payload", "extra").groupBy("dest").applyInArrow(lists, "leader long, member long").distinct())
    led = pairs.join(sets.select(F.col("class").alias("member"), "size"), "member").groupBy("leader").agg(F.count("*").alias("count"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    work = pairs.join(led, "leader").withColumn("block", F.pmod(F.xxhash64("member"), blocks).cast("int"))
    work = work.select("leader", "member", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    work = work.select("leader", "member", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    work = work.join(sets, work.member == sets["class"]).select("leader", "member", "block", "lo", "hi", "payload")
    links = work.groupBy("leader", "lo", "hi").applyInArrow(lambda g: _linked(g, percent), "a long, b long").distinct()
    # a table of its own that isn't dealt by class, so that Spark can split a class with a third of all rows
    heads = settle(rows.groupBy("class").agg(F.min("doc_id").alias("class_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    edge = links.join(heads.select(F.col("class").alias("a"), F.col("class_id").alias("x")), "a").join(heads.select(F.col("class").alias("b"), F.col("class_id").alias("y")), "b")
    same = rows.join(heads, "class").where("doc_id != class_id").groupBy("doc_id").agg(F.min("class_id").alias("x"))
    twice = heads.select(F.col("class_id").alias("doc_id")).join(same, "doc_id").select(F.col("doc_id").alias("y"), "x")
    found = components(edge.select("x", "y").unionByName(twice.select("x", "y")), "x", "y")
    named = heads.join(found, heads.class_id == found.node, "left").select("class", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return rows.join(named, "class").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class_id")
