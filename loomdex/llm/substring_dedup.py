"""Exact substring deduplication by difference-cover anchors.

A set D is a difference cover modulo v if every residue is a difference of two of its
members. Then for any two word positions i and j there is a shift k < v that puts both
i + k and j + k on positions whose residue is in D. Hashes of ``width - v + 1`` words
are therefore taken at cover positions only, and any two equal windows of ``width``
words still share an aligned anchor. Windows that hold a repeated anchor are extended
to their full width and counted over the whole corpus; those that occur more than once
are marked and every word under a marked window goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import canonical, chunked, deal, packed_rows, prefix_hash, sizes, text_buffer, total_words, window_hash, window_starts, word_hashes, word_spans

# Perfect and near-perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

_MESSAGE = "dest long, chunk int, payload binary, extra binary"


def cover_for(width: int) -> tuple[int, np.ndarray]:
    """Largest known period that leaves anchors of two fifths of the window, and its cover as flags."""
    period = max(v for v in COVERS if v == 1 or width - v + 1 >= 2 * width / 5)
    flags = np.zeros(period, bool)
    flags[list(COVERS[period])] = True
    return period, flags


def _stream(group: pa.Table, text_col: str):
    buf, offs = text_buffer(group[text_col])
    starts, ends, counts = word_spans(buf, offs)
    return buf, offs, starts, ends, counts, prefix_hash(word_hashes(buf, starts, ends))


def _anchors(counts: np.ndarray, prefix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of documents that have a whole window."""
    period, cover = cover_for(width)
    at = window_starts(np.where(counts >= width, counts, 0), 1)  # positions among those documents
    first = np.cumsum(counts) - counts
    long = counts >= width
    within = np.arange(int(counts[long].sum())) - np.repeat(np.cumsum(counts[long]) - counts[long], counts[long])
    left = np.repeat(counts[long], counts[long]) - within
    take = at[cover[within % period] & (left >= width - period + 1)]
    here = np.repeat(first[long], counts[long])[take] + within[take]
    return here, window_hash(prefix, here, width - period + 1)


def dedup_substrings(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word under a window of ``width`` words that also starts elsewhere.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows lie in one document and are
    judged on the input. Returns ``id_col, n_words, n_removed, text`` with the kept words
    joined by one space, a row for each input row. Null and empty texts have no words and
    come back empty; texts shorter than a window come back whole; repeated rows count as
    documents of their own, so their windows are repeats; other columns don't pass through.

    Shuffles: the text once (the exchange is reused by the three passes), a quarter of the
    words as packed anchor hashes, and 12 bytes for each window that holds a repeated anchor.
    """
    n = sizes(total_words(docs, text_col))
    id_type = dict(docs.dtypes)[id_col]
    text = chunked(docs.select(id_col, text_col), [id_col, text_col], n)

    def send_anchors(group: pa.Table) -> pa.Table:
        *_, counts, prefix = _stream(group, text_col)
        u, c = np.unique(_anchors(counts, prefix, width)[1], return_counts=True)
        cut = deal(u, n)
        chunk = group["chunk"][0].as_py()
        return packed_rows([(b, chunk, u[i:j].tobytes(), np.packbits(c[i:j] > 1).tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i], _MESSAGE)

    def repeated(group: pa.Table) -> list[np.ndarray]:
        """For each message, which of its hashes occur more than once in the corpus."""
        parts = [np.frombuffer(x, np.uint64) for x in group["payload"].to_pylist()]
        _, inverse, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = seen > 1
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(group["flags"].to_pylist(), parts)]
        again[inverse[np.concatenate(flags)]] = True
        bounds = np.cumsum([0, *map(len, parts)])
        return [again[inverse[i:j]] for i, j in zip(bounds[:-1], bounds[1:])]

    def answer_anchors(group: pa.Table) -> pa.Table:
        bits = repeated(group.rename_columns(["dest", "chunk", "payload", "flags"]))
        return packed_rows([(group["dest"][0].as_py(), c, b"", np.packbits(x).tobytes()) for c, x in zip(group["chunk"].to_pylist(), bits)], _MESSAGE)

    def send_windows(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = canonical(group, id_col, text_col)
        *_, counts, prefix = _stream(group, text_col)
        at, h = _anchors(counts, prefix, width)
        u, inverse = np.unique(h, return_inverse=True)
        cut = deal(u, n)
        again = np.zeros(len(u), bool)
        for b, bits in zip(answers["dest"].to_pylist(), answers["extra"].to_pylist()):
            again[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cut[b + 1] - cut[b])
        hit = at[again[inverse]]
        period, _ = cover_for(width)
        near = np.zeros(int(counts.sum()) + 1, np.int32)
        np.add.at(near, np.maximum(hit - period + 1, 0), 1)
        np.add.at(near, hit + 1, -1)
        start = window_starts(counts, width)
        start = start[np.cumsum(near)[start] > 0]
        chunk = group["chunk"][0].as_py() if group.num_rows else 0
        u, first, inverse, seen = np.unique(window_hash(prefix, start, width), return_index=True, return_inverse=True, return_counts=True)
        cut = deal(u, n)
        rows = [(b, chunk, u[i:j].tobytes(), start[first[i:j]].astype(np.uint32).tobytes(), np.packbits(seen[i:j] > 1).tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
        here = start[seen[inverse] > 1]  # known without asking
        rows += [(n + chunk, chunk, b"", here.astype(np.uint32).tobytes(), b"")] if len(here) else []
        return packed_rows(rows, _MESSAGE + ", flags binary")

    def answer_windows(group: pa.Table) -> pa.Table:
        if group["dest"][0].as_py() >= n:
            return group.select(["dest", "chunk", "payload", "extra"])
        out = []
        for c, at, bits in zip(group["chunk"].to_pylist(), group["extra"].to_pylist(), repeated(group)):
            if bits.any():
                out.append((0, c, b"", np.frombuffer(at, np.uint32)[bits].tobytes()))
        return packed_rows(out, _MESSAGE)

    def strip(group: pa.Table, marks: pa.Table) -> pa.Table:
        group = canonical(group, id_col, text_col)
        buf, offs = text_buffer(group[text_col])
        starts, ends, counts = word_spans(buf, offs)
        cover = np.zeros(len(starts) + 1, np.int32)
        for x in marks["extra"].to_pylist():
            at = np.frombuffer(x, np.uint32).astype(np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
        kept = np.cumsum(cover)[:-1] == 0
        of = np.repeat(np.arange(len(counts)), counts)
        gone = np.bincount(of, ~kept, len(counts)).astype(np.int64)
        # bytes of kept words, and one space after each but a document's last
        s, e, d = starts[kept], ends[kept], of[kept]
        spaced = np.append(d[1:] == d[:-1], False)[: len(d)]
        cover = np.zeros(len(buf) + 1, np.int8)
        cover[s] += 1
        np.subtract.at(cover, e + spaced, 1)
        take = np.cumsum(cover, dtype=np.int8)[:-1].astype(bool)
        buf[e[spaced]] = 0x20
        out = buf[take]
        size = np.bincount(d, e - s + spaced, len(counts)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        texts = pa.StringArray.from_buffers(len(counts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
        return pa.table({id_col: group[id_col], "n_words": counts.astype(np.int64), "n_removed": gone, "text": texts})

    anchors = text.groupBy("chunk").applyInArrow(send_anchors, _MESSAGE)
    answers = anchors.groupBy("dest").applyInArrow(answer_anchors, _MESSAGE)
    windows = text.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send_windows, _MESSAGE + ", flags binary")
    marks = windows.groupBy("dest").applyInArrow(answer_windows, _MESSAGE)
    return text.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(strip, f"{id_col} {id_type}, n_words long, n_removed long, text string")
