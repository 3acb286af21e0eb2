"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over the bytes of its words: a byte's
context is up to ``ORDER`` bytes before it, back to the space before its word. A context
that has seen the byte codes it by its count, one that hasn't pays for an escape (method C)
and asks the next shorter; below order 0 all 256 bytes are alike. Once the statistics are
frozen, a word's code length in every language is a sum of table rows, so a document's is
a sum over its words, and each distinct word of a batch is coded once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_buffer, word_hashes, word_spans

ORDER = 4
#: Bytes of all languages' samples together, in expectation.
SAMPLE_BYTES = 64_000_000
UNDECIDED = "und"
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _padded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with a space before and behind, end to end; the coded positions (all but the first
    space), how far each is from its word's space, and the positions of each word."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) + 8 if len(stop) else 8, 0x20, np.uint8)
    inner = size - 2
    total = int(inner.sum())
    step = np.arange(total) - np.repeat(np.cumsum(inner) - inner, inner)
    out[np.repeat(stop - size + 1, inner) + step] = buf[np.repeat(starts, inner) + step]
    coded = size - 1
    depth = np.arange(int(coded.sum())) - np.repeat(np.cumsum(coded) - coded, coded) + 1
    at = np.repeat(stop - size, coded) + depth
    return out, at, depth, np.cumsum(coded) - coded


def _grams(out: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before each position and its own, as integers (first byte lowest)."""
    return np.ndarray((len(out) - 7,), "<u8", out, strides=(1,))[at - k] & _MASK[k + 1]


#: Code lengths that a worker remembers, in bytes; and what it remembers, by the trees' name.
REMEMBER = 16 << 20
_memory: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class Trees:
    """Frozen statistics of all languages: by order, each gram's code length and each context's escape."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order, self.name = sorted(samples), order, uuid.uuid4().hex
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        streams = []
        for lang in self.langs:
            buf, offs = text_buffer(pa.array(samples[lang], pa.string()))
            starts, ends, _ = word_spans(buf, offs)
            streams.append(_padded(buf, starts, ends)[:3])
        for k in range(order + 1):
            seen = [np.unique(_grams(out, at[depth >= k], k), return_counts=True) for out, at, depth in streams]
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(u for u, _ in seen)]))
            contexts = np.unique(keys & _MASK[k])
            below = self.lookup(keys >> np.uint64(8), k - 1)
            bits, escape = below.copy(), np.zeros((len(contexts), len(self.langs)))
            for l, (u, c) in enumerate(seen):
                of = np.searchsorted(contexts, u & _MASK[k])
                total, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, minlength=len(contexts))
                met = total > 0
                escape[met, l] = np.log2((total[met] + kinds[met]) / kinds[met])
                bits[:, l] += escape[np.searchsorted(contexts, keys & _MASK[k]), l]
                bits[np.searchsorted(keys, u), l] = np.log2((total + kinds)[of] / c)
            self.grams.append((keys, bits))
            self.escapes.append((contexts, escape))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def lookup(self, wanted: np.ndarray, k: int) -> np.ndarray:
        """Code length in each language of grams of order k."""
        if k < 0:
            return np.full((len(wanted), len(self.langs)), 8.0)
        at, found = self._find(self.grams[k][0], wanted)
        out = np.zeros((len(wanted), len(self.langs)))
        out[found] = self.grams[k][1][at[found]]
        rest = np.flatnonzero(~found)
        if len(rest):
            out[rest] = self.lookup(wanted[rest] >> np.uint64(8), k - 1)
            at, found = self._find(self.escapes[k][0], wanted[rest] & _MASK[k])
            out[rest[found]] += self.escapes[k][1][at[found]]
        return out

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each word in each language."""
        out, at, depth, first = _padded(buf, starts, ends)
        bits = np.empty((len(at), len(self.langs)))
        for k in range(1, self.order + 1):
            here = depth == k if k < self.order else depth >= k
            bits[here] = self.lookup(_grams(out, at[here], k), k)
        return np.add.reduceat(bits, first) if len(first) else bits[:0]


    def remembered(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``words`` of distinct words with sorted hashes ``keys``, each coded once by a worker."""
        if self.name not in _memory or _memory[self.name][1].nbytes > REMEMBER:
            _memory.clear()
            _memory[self.name] = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))
        known, bits = _memory[self.name]
        _, found = self._find(known, keys)
        new = np.flatnonzero(~found)
        if len(new):
            at = np.searchsorted(known, keys[new])
            bits = np.insert(bits, at, self.words(buf, starts[new], ends[new]), axis=0)
            known = np.insert(known, at, keys[new])
            _memory[self.name] = known, bits
        return bits[np.searchsorted(known, keys)]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = 1_000_000, order: int = ORDER) -> Trees:
    """Trees from whole labelled texts, about ``sample_bytes`` of each language.

    The sample is bounded by that parameter, by SAMPLE_BYTES in all (both in expectation)
    and by 1,000 languages; each
    language keeps the rows whose hash falls below the share that the bound allows, so it
    doesn't depend on partitions. Rows with null text, label or id are left out.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    held = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.sum(F.octet_length(text_col))).limit(1001).collect()}
    if len(held) > 1000:
        raise ValueError("more than 1,000 languages")
    if not held:
        return Trees({}, order)
    sample_bytes = min(sample_bytes, SAMPLE_BYTES // len(held))
    share = F.create_map(*(F.lit(x) for lang, n in held.items() for x in (lang, min(1.0, sample_bytes / max(1, n)))))
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.where(draw < F.element_at(share, F.col(lang_col))).select(lang_col, text_col).collect()
    samples: dict[str, list[str]] = {lang: [] for lang in held}
    for lang, text in found:
        samples[lang].append(text)
    return Trees({lang: sorted(x) for lang, x in samples.items() if x}, order)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row's fold, the CRC-32 of its id as text, is the one kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(False))


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` behind the columns of ``docs``; columns of those names are replaced.

    The language with the shortest code of the whole text, ties to the first by name; the
    score is its share of the languages' probabilities, each taken per word. ``und`` and 0
    for null texts, texts without a letter, and where there is nothing learned.
    """
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*trees.langs, UNDECIDED], pa.string())
        for batch in slices(batches, at):
            text = batch.column(at)
            buf, offs = text_buffer(text)
            starts, ends, counts = word_spans(buf, offs)
            n = len(counts)
            ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[buf[: int(offs[-1])]])])
            letters = ascii_letters[offs[1:]] > ascii_letters[offs[:-1]]
            for i in np.flatnonzero(~letters & (offs[1:] > offs[:-1])):
                letters[i] = any(map(str.isalpha, text[i].as_py()))
            best, share = np.full(n, len(trees.langs)), np.zeros(n)
            if trees.langs and len(starts):
                keys, first, inverse = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
                bits = trees.remembered(keys, buf, starts[first], ends[first])
                of = np.repeat(np.arange(n), counts)
                total = np.stack([np.bincount(of, bits[:, l][inverse], n) for l in range(len(trees.langs))], 1)
                ok = letters & (counts > 0)
                low = total.argmin(1)
                weight = np.exp2(-(total - total.min(1, keepdims=True)) / np.maximum(counts, 1)[:, None])
                best[ok], share[ok] = low[ok], (1 / weight.sum(1))[ok]
            columns = [*batch.columns, names.take(pa.array(best)), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rest.mapInArrow(score, schema)
