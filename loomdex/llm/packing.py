"""Hierarchical packing of token streams into windows of several context sizes.

Documents are routed by what is left of them after whole long windows are cut off: to the
smallest tier that holds the rest. From the longest tier down, each routed rest opens a
window and shorter tiers fill its gap exactly, the last filler cut where the window ends.
What no filler is left for runs on as a stream through long windows, and the last such
window of a batch is cut into windows of powers of two. So no window is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import slices

TIERS = (1024, 512, 256, 128)


def _pour(gap: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pour pieces of ``size``, in order, into the first windows that they fill entirely.

    Returns for each part its piece, its start there, its length, its window and its offset
    in the gap; and the number of windows filled.
    """
    g, p = np.cumsum(gap), np.cumsum(size)
    full = int(np.searchsorted(g, p[-1] if len(p) else 0, side="right"))
    end = int(g[full - 1]) if full else 0
    edge = np.unique(np.concatenate([[0], g[:full], p[p < end], [end]]))
    x, length = edge[:-1], np.diff(edge)
    piece, window = np.searchsorted(p, x, side="right"), np.searchsorted(g, x, side="right")
    return piece, x - (p - size)[piece], length, window, x - (g - gap)[window], full


def pack_lengths(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> dict[str, np.ndarray]:
    """Pieces (doc, start, length, sequence, offset) of documents of so many tokens, and each sequence's tier."""
    longest = tiers[0]
    whole = lengths // longest
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [(doc, nth * longest, np.full(len(doc), longest), np.arange(len(doc)), np.zeros(len(doc), int))]
    tier_of = [np.full(len(doc), longest)]
    made = len(doc)
    # what is left of each document, shortest first
    rest = np.flatnonzero(lengths % longest)
    rest = rest[np.argsort(lengths[rest] % longest, kind="stable")]
    start, size = whole[rest] * longest, lengths[rest] % longest
    spare = (rest[:0], start[:0], size[:0])
    for tier, below in zip(tiers, [*tiers[1:], 0]):
        own = (size > below) & (size <= tier)
        d, s, n = rest[own], start[own], size[own]
        rest, start, size = rest[~own], start[~own], size[~own]
        order = np.argsort(tier - n, kind="stable")
        d, s, n = d[order], s[order], n[order]
        piece, at, length, window, offset, full = _pour(tier - n, size)
        out.append((d[:full], s[:full], n[:full], made + np.arange(full), np.zeros(full, int)))
        out.append((rest[piece], start[piece] + at, length, made + window, n[window] + offset))
        tier_of.append(np.full(full, tier))
        made += full
        spare = tuple(np.concatenate(x) for x in zip(spare, (d[full:], s[full:], n[full:])))
        used = np.bincount(piece, length, len(rest)).astype(np.int64) if len(rest) else size
        rest, start, size = rest[size > used], (start + used)[size > used], (size - used)[size > used]
        order = np.argsort(size, kind="stable")
        rest, start, size = rest[order], start[order], size[order]
    d, s, n = (np.concatenate(x) for x in zip(spare, (rest, start, size)))
    total = int(n.sum())
    gap = np.array([longest] * (total // longest) + [1 << b for b in reversed(range(longest.bit_length())) if total % longest >> b & 1], np.int64)
    piece, at, length, window, offset, _ = _pour(gap, n)
    out.append((d[piece], s[piece] + at, length, made + window, offset))
    tier_of.append(gap)
    names = ("doc", "start", "length", "sequence", "offset")
    return {k: np.concatenate(x).astype(np.int64) for k, x in zip(names, zip(*out))} | {"tier": np.concatenate(tier_of).astype(np.int64)}


def step_groups(cost: np.ndarray, tier: np.ndarray, size: int) -> np.ndarray:
    """Groups of about ``size`` sequences of one tier with like sums of cost, dealt back and forth by falling cost."""
    out, made = np.zeros(len(cost), np.int64), 0
    for t in np.unique(tier)[::-1]:
        of = np.flatnonzero(tier == t)
        of = of[np.argsort(-cost[of], kind="stable")]
        groups = -(-len(of) // size)
        turn = np.arange(len(of)) % (2 * groups)
        out[of] = made + np.minimum(turn, 2 * groups - 1 - turn)
        made += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack whole texts; a row for each piece of a document.

    Returns ``id_col, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset, tier, step_group``. A null or empty text is its end id alone;
    repeated rows are packed each for itself; other columns don't pass through. ``tiers``
    are falling powers of two; every sequence is either as long as the first or a power of
    two, so none is padded. Sequences of one step group have one tier's window (or are
    remainders) and balanced sums of squared piece lengths, the cost of attention.

    No shuffle: each run of about 4 MB of text is packed by itself, and ids carry the partition's number.
    """
    id_type = dict(docs.dtypes)[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import Encoder, with_end

        coder, sequences, groups = Encoder.at(tokenizer), TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        for batch in slices(batches, 1):
            ids, counts = with_end(*coder.encode(batch.column(1)), end_id)
            p = pack_lengths(counts, tiers)
            order = np.lexsort((p["start"], p["doc"]))
            doc, start, length, sequence, offset = (p[k][order] for k in ("doc", "start", "length", "sequence", "offset"))
            group = step_groups(np.bincount(sequence, length.astype(float) ** 2, len(p["tier"])), p["tier"], step)
            # pieces in this order are the ids in their order
            bounds = (np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
            yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(counts[doc]), pa.array(sequences + sequence), pa.array(offset), pa.array(p["tier"][sequence]), pa.array(groups + group[sequence])], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])
            sequences += len(p["tier"])
            groups += int(group.max()) + 1

    return docs.select(id_col, text_col).mapInArrow(pack, f"{id_col} {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long")
