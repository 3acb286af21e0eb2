"""Spelling variants: words at one edit from each other, grouped under a far more frequent form.

Let m be the shorter word's length and e the length of the two words' common prefix, which
is where the edit is. If e lies in the second half (of m) the first half is intact, else the
second. So the dictionary is sorted twice: forward, where words that share their first half
are a range, and reversed, where words that share their second half are one. A range of too
many words is subdivided by the same argument: its window of e is halved, and one half of
what was free is intact, too; at a window of one position no more than an alphabet's power
is left. Words of a range are compared in its scan; nothing but verified pairs leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import settle, slices

#: Words of a range at the most; a longer one is subdivided.
RANGE = 256

#: Bytes of the words that a scan compares at once.
RUN = 4 << 20

#: What a range is: the shorter word's length, the window of edit positions, what is intact before and (reversed) behind.
KEY = ["m", "lo", "hi", "head", "tail"]

#: Code points of the words that documents are searched for.
LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def observed_words(docs: DataFrame, drop_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``: each run of letters of all texts, A-Z lower-cased, one row for each occurrence.

    Where ``drop_every`` divides the CRC-32 of ``<id>:<run>`` (a null id has no digits), the
    run loses the code point at that number modulo its length. Null texts have no runs.
    """
    run = F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(LETTERS.replace("A-Z", "")), 0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """``word, n`` of the words of ``shortest`` code points or more that occur ``least`` times or more."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _window(m: Column, lo: Column, hi: Column) -> Column:
    """The range of a word for edits at lo to hi of a pair whose shorter word has m code points."""
    tail = F.greatest(m - 1 - hi, F.lit(0))
    return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.substr("word", F.lit(1), lo).alias("head"), F.reverse(F.substr("word", F.length("word") - tail + 1, tail)).alias("tail"))


def _halves(m: Column, lo: Column, hi: Column) -> list[Column]:
    mid = F.floor((lo + hi) / 2).cast("int")
    return [_window(m, lo, mid), _window(m, mid + 1, hi)]


def ranges(words: DataFrame) -> DataFrame:
    """``m, lo, hi, head, tail, word, n``: each word's ranges in both dictionaries, none of more than RANGE words that can still be subdivided."""
    size = F.length("word")
    each = [half for m in (size, size - 1) for half in (_window(m, F.lit(0), F.floor(m / 2).cast("int") - 1), _window(m, F.floor(m / 2).cast("int"), m))]
    todo = words.select("word", "n", F.inline(F.array(*each))).where("lo <= hi")
    done = []
    while True:
        many = settle(todo.groupBy(*KEY).agg(F.count("*").alias("size")).where(f"size > {RANGE} AND lo < hi").drop("size"))
        if many.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(many, KEY, "left_anti"))
        todo = settle(todo.join(many, KEY, "left_semi").select("word", "n", F.inline(F.array(*_halves(F.col("m"), F.col("lo"), F.col("hi"))))))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("m", "lo", "hi", "head", "tail", "word", "n")


def _matrix(words: list[str], width: int, turned: bool) -> np.ndarray:
    """Words as rows of code points, filled up with zeros; ``turned``: from their ends."""
    return np.array([w[::-1] for w in words] if turned else words, f"U{width}").view(np.uint32).reshape(len(words), width)


def _scan(m: int, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one range at one edit in its window; all shorter words have m letters."""
    forward, turned = _matrix(words, m + 2, False), _matrix(words, m + 2, True)
    size = np.array([len(w) for w in words])
    here, step, found = np.arange(len(words)), 0, [(np.zeros(0, np.int64),) * 2]
    while len(here):
        step += 1
        here = here[here + step < len(words)]
        here = here[group[here] == group[here + step]]
        one = here[np.minimum(size[here], size[here + step]) == m]
        two = one + step
        head, tail = ((x[one] != x[two]).argmax(axis=1) for x in (forward, turned))  # distinct words differ within m + 1
        near = (head + tail >= m - (size[one] == size[two])) & (head >= lo[one]) & (head <= hi[one])
        found.append((one[near], two[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _verified(t: pa.Table) -> pa.RecordBatch:
    """Near pairs, in both directions, of sorted rows that hold whole ranges."""
    t = t.combine_chunks()
    m, lo, hi = (t[c].to_numpy() for c in KEY[:3])
    new = np.ones(len(m), bool)
    new[1:] = np.any([pa.compute.not_equal(t[c].slice(1), t[c].slice(0, len(m) - 1)).to_numpy() for c in KEY], axis=0)
    group, words = np.cumsum(new), t["word"].to_pylist()
    pairs = []
    edges = [0, *(np.flatnonzero(np.diff(m)) + 1), len(m)]
    for x, y in zip(edges[:-1], edges[1:]):
        one, two = _scan(int(m[x]), lo[x:y], hi[x:y], group[x:y], words[x:y])
        pairs += [(one + x, two + x), (two + x, one + x)]
    a, b = (pa.array(np.concatenate(c)) for c in zip(*pairs))
    return pa.table({"word": t["word"].take(a), "near": t["word"].take(b), "near_n": t["n"].take(b)})


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: each word of a ``word, n`` table of distinct words with each that differs by one inserted, deleted or replaced code point.

    A pair has one edit position, so one range finds it. Null words are near to none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, KEY.index("tail") + 1, RUN):
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held else new
            if held.nbytes < RUN:
                continue
            same = np.all([pa.compute.equal(held[c], held[c][-1]).to_numpy() for c in KEY], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # where the last range starts
            if cut:
                yield from _verified(held.slice(0, cut)).to_batches()
                held = held.slice(cut)
        if held:
            yield from _verified(held).to_batches()

    dealt = ranges(words.where("word IS NOT NULL")).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "word")
    return dealt.select(*KEY, "word", "n").mapInArrow(scan, "word string, near string, near_n long")


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Group the words of a ``word, n`` table (distinct words and their counts) under their forms.

    Returns ``word, form, root, n, n_near, form_n``: the near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` times the word's own, else
    null; the word that forms lead to; the number of near words; the form's n. n grows by
    ``ratio`` at each step, so forms have no cycle and chains are short; roots come by
    doubling. An empty table gives none.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    found = settle(found)
    up = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        then = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = settle(up.join(then, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return found.join(up.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
