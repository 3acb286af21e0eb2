"""Token counts from a dictionary of pre-tokens.

A byte-level vocabulary never merges across pre-tokens, so a text has as many tokens as its
pre-tokens have together. A first pass over the texts gathers the distinct pre-tokens with
their frequency; each is encoded once, and only the number of its pieces is kept. A second
pass takes each text's pre-token frequencies and joins them to the dictionary: the most
frequent entries, bounded in number and bytes, are broadcast; what is left of a text is
joined by a shuffle on the pre-token. No id is ever kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_buffer, word_hashes
from .token_files import scratch

#: Entries of the dictionary that are broadcast at the most, and the bytes of each: some 10 MB.
FREQUENT, SHORT = 200_000, 48

#: Pieces that a worker remembers, and the characters of their pre-tokens; at more it starts afresh.
REMEMBER, CHARACTERS = 400_000, 16_000_000

#: Bytes of texts that are split at once.
RUN = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_workers: dict[str, Splitter] = {}


class _Numbers(dict):
    """Numbers pre-tokens in the order in which they are first asked for."""

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        return number


class Splitter:
    """The pre-tokens of texts, by a tokenizer file's own pre-tokeniser.

    No byte-level pre-token holds a space but as its first character, so a text may be cut
    before every space that ink follows; a piece between such cuts is split once per worker, and
    found again by its hash. A tokenizer with a normaliser or another pre-tokeniser gets whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        kind = json.loads(self.tool.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.cuts = kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = list(self.tool.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) or not pre:
            raise ValueError("a tokenizer with a pre-tokeniser and plain added tokens is needed")
        self.marks = sorted((t.content for t in added), key=len, reverse=True)
        self.forget()

    @classmethod
    def at(cls, path: str) -> Splitter:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def forget(self) -> None:
        self.names: list[str] = []  # pre-tokens met
        self.index = _Numbers()
        self.characters = 0
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of pieces; each has ``size`` pre-tokens in ``flat`` from ``first``
        self.first, self.size, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def full(self) -> bool:
        return len(self.keys) > REMEMBER or self.characters > CHARACTERS

    def _tokens(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        text = self.tool.normalizer.normalize_str(text) if self.tool.normalizer else text
        return self.tool.pre_tokenizer.pre_tokenize_str(text) if text else []

    def split(self, text: str) -> list[str]:
        """Pre-tokens of one text, an added token's string apart from the rest."""
        if not any(m in text for m in self.marks):
            return [t for t, _ in self._tokens(text)]
        import re

        mark = "|".join(map(re.escape, self.marks))
        parts, found = re.split(mark, text), re.findall(mark, text)
        return [t for i, part in enumerate(parts) for t in (*(t for t, _ in self._tokens(part)), *found[i : i + 1])]

    def pieces(self, token: str) -> int:
        """Tokens of a pre-token: one for an added token, else as the model merges it."""
        return 1 if token in self.marks else len(self.tool.model.tokenize(token))

    def _learn(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray, view: bytes, chars: np.ndarray) -> None:
        """Split new pieces, whose hashes are sorted. Those of ``joined``, which begin at a cut, are split as one text: they part there."""
        letters = np.concatenate([[0], np.cumsum(_LETTER[np.frombuffer(view, np.uint8)])])
        plain = joined & (letters[ends] - letters[starts] == ends - starts - 1)  # a space and ASCII letters are one pre-token
        size = plain.astype(np.int64)
        simple, which = np.flatnonzero(plain), np.flatnonzero(joined & ~plain)
        flat = ["\u0120" + w for w in b"".join([view[a:b] for a, b in zip(starts[simple].tolist(), ends[simple].tolist())]).decode().split(" ")[1:]]
        for part in (which[a : a + 8192] for a in range(0, len(which), 8192)):
            text = b"".join([view[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]).decode()
            tokens, spans = zip(*self._tokens(text))
            stops = np.cumsum(chars[ends[part]] - chars[starts[part]])
            of = np.searchsorted(stops, np.fromiter((s for s, _ in spans), np.int64, len(spans)), side="right")
            size[part] = np.bincount(of, minlength=len(part))
            flat += tokens
        rest = np.flatnonzero(~joined)
        for i in rest.tolist():
            own = self.split(view[starts[i] : ends[i]].decode())
            size[i] = len(own)
            flat += own
        order = np.concatenate([simple, which, rest])
        stop = np.cumsum(size[order])
        first = np.empty(len(keys), np.int64)
        first[order] = len(self.flat) + stop - size[order]
        self.flat = np.concatenate([self.flat, np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))])
        new = list(islice(self.index, len(self.names), None))
        self.names += new
        self.characters += sum(map(len, new))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def frequencies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pre-token as a number in ``names``, frequency) of all pre-tokens that occur in each text."""
        buf, offs = text_buffer(column)
        n, view = int(offs[-1]), buf.tobytes()
        whole = np.full(len(offs) - 1, not self.cuts)
        for mark in self.marks:
            at = view.find(mark.encode())
            while at >= 0:
                whole[np.searchsorted(offs, at, side="right") - 1] = True
                at = view.find(mark.encode(), at + 1)
        cut = np.zeros(n + 1, bool)
        following = buf[1 : n + 1]
        ink = ((following > 0x20) & (following < 0x7F)) | ((following >= 0xC4) & ~((following >= 0xE1) & (following <= 0xE3))) | (following == 0xC3)
        cut[:n] = (buf[:n] == 0x20) & ink
        cut[:n][np.repeat(whole, np.diff(offs))] = False
        cut[offs[1:]] = False
        cut[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)[: len(starts)]
        text = np.searchsorted(offs, starts, side="right") - 1
        u, example, inverse = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == u[inside]
        if not known.all():
            i = example[~known]
            chars = np.concatenate([[0], np.cumsum(buf[:n] & 0xC0 != 0x80)])
            self._learn(u[~known], starts[i], ends[i], (buf[starts[i]] == 0x20) & ink[starts[i]] & ~whole[text[i]], view, chars)
            at = np.searchsorted(self.keys, u)
        size, first = self.size[at][inverse], self.first[at][inverse]
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        token = self.flat[np.repeat(first, size) + nth]
        pair, times = np.unique(np.repeat(text, size) * max(1, len(self.names)) + token, return_counts=True)
        return pair // max(1, len(self.names)), pair % max(1, len(self.names)), times


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that executors share: compressed, and with columns to choose from."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dictionary(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``token, n, pieces``: the distinct pre-tokens of all texts, their frequency and number of tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, total = Splitter.at(tokenizer), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            met = np.flatnonzero(total)
            return pa.record_batch([pa.array([splitter.names[i] for i in met.tolist()], pa.string()), pa.array(total[met], pa.int64())], names=["token", "n"])

        for batch in slices(batches, 0, RUN):
            if splitter.full:
                yield rows()
                splitter.forget()
                total = total[:0]
            _, token, times = splitter.frequencies(batch.column(0))
            total = np.pad(total, (0, len(splitter.names) - len(total))) + np.bincount(token, times, len(splitter.names)).astype(np.int64)
        yield rows()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([Splitter.at(tokenizer).pieces(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["token", "n", "pieces"])

    distinct = docs.select(text_col).mapInArrow(gather, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return written(distinct.mapInArrow(encode, "token string, n long, pieces long"))


def _frequent(words: DataFrame, most: int) -> dict[str, int]:
    """The most frequent short entries, ``most`` at most: those above a frequency that a histogram of powers gives."""
    short = words.where(F.octet_length("token") <= SHORT)
    power = F.floor(F.log2("n") * 16).cast("int").alias("power")
    held, least = 0, None
    for row in short.groupBy(power).count().orderBy(F.desc("power")).collect():  # some 16 * 63 rows at the most
        held += row["count"]
        if held > most:
            break
        least = row.power
    return {} if least is None else {r.token: r.pieces for r in short.where(power >= least).select("token", "pieces").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of every whole text, as the library gives it by default.

    Returns ``id_col, n_bytes`` (UTF-8), ``n_tokens, over_limit`` (more than ``limit``). A
    null or empty text has none. Repeated rows and null ids are rows of their own; other
    columns don't pass through. An added token's string is one token. Two passes read the
    texts, without a shuffle of them; ``frequent`` bounds the broadcast.
    """
    words = dictionary(docs, tokenizer, text_col)
    common = docs.sparkSession.sparkContext.broadcast(_frequent(words, frequent))
    id_type = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, pieces, row = Splitter.at(tokenizer), np.zeros(0, np.int64), TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1, RUN):
            if splitter.full:
                splitter.forget()
                pieces = pieces[:0]
            column = batch.column(1)
            text, token, times = splitter.frequencies(column)
            pieces = np.concatenate([pieces, np.array([common.value.get(t, -1) for t in splitter.names[len(pieces) :]], np.int64)])
            met = pieces[token] >= 0
            n = np.bincount(text[met], (times * pieces[token])[met], batch.num_rows).astype(np.int64)
            # what isn't broadcast, as lists: rows come in the order of texts
            ends = np.searchsorted(text[~met], np.arange(batch.num_rows + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array([splitter.names[i] for i in token[~met].tolist()], pa.string()), pa.array(times[~met], pa.int64())], ["token", "k"]))
            size = pa.compute.binary_length(column).cast(pa.int64()).fill_null(0)
            yield pa.record_batch([batch.column(0), size, pa.array(n), rest, pa.array(np.arange(row, row + batch.num_rows))], names=[id_col, "n_bytes", "met", "rest", "row"])
            row += batch.num_rows

    counted = written(docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, met long, rest array<struct<token: string, k: long>>, row long"))
    left = counted.where(F.size("rest") > 0).select("row", F.inline("rest"))
    more = left.join(words.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("more"))
    part = counted.where(F.size("rest") > 0).join(more, "row").withColumn("met", F.col("met") + F.col("more"))
    both = counted.where(F.size("rest") == 0).select(id_col, "n_bytes", "met").unionByName(part.select(id_col, "n_bytes", "met"))
    return both.select(id_col, "n_bytes", F.col("met").alias("n_tokens"), (F.col("met") > limit).alias("over_limit"))
