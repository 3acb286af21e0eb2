"""Fill-in-the-middle examples by ropes.

A text is a rope: a balanced binary tree whose leaves are runs of units (a word with the
white space before it, or white space at the end) and cache their number of units and of
code points, as every inner node does. Prefix, middle and suffix are the trees that two
splits by unit rank leave; the output is their concatenation with sentinels between, and
only written out at the end. Restoring builds the rope of an output, splits it at the
sentinels' code-point ranks and concatenates the parts in their first order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_buffer, word_spans

#: Units of a leaf.
LEAF = 256

# The sentinels before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"


class Rope(NamedTuple):
    """A leaf holds UTF-8 bytes and the ends of its units in them; an inner node holds two ropes."""

    units: int
    chars: int
    data: bytes = b""
    ends: np.ndarray | None = None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(data: bytes, ends: np.ndarray | None = None) -> Rope:
    chars = int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))
    return Rope(1 if ends is None else len(ends), chars, data, ends)


def concat(a: Rope, b: Rope) -> Rope:
    if not (a.chars and b.chars):
        return a if a.chars else b
    return Rope(a.units + b.units, a.chars + b.chars, left=a, right=b)


def build(data: bytes, ends: np.ndarray) -> Rope:
    """A balanced rope over text whose units end at ``ends``."""
    level = [leaf(data[a:b], of - a) for a, b, of in zip([0, *ends[LEAF - 1 : -1 : LEAF]], [*ends[LEAF - 1 : -1 : LEAF], len(data)], np.split(ends, range(LEAF, len(ends), LEAF))) if b > a]
    while len(level) > 1:
        level = [concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def _cut(rope: Rope, rank: int, by_chars: bool) -> int:
    """Byte at which a leaf is cut."""
    if by_chars:
        return int(np.flatnonzero(np.frombuffer(rope.data, np.uint8) & 0xC0 != 0x80)[rank])
    return int(rope.ends[rank - 1])


def split(rope: Rope, rank: int, by_chars: bool = False) -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points) and the rest: one way down the tree."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= (rope.chars if by_chars else rope.units):
        return rope, EMPTY
    if rope.left is None:
        at = _cut(rope, rank, by_chars)
        if rope.ends is None:
            return leaf(rope.data[:at]), leaf(rope.data[at:])
        own = int(np.searchsorted(rope.ends, at, side="right"))
        head = rope.ends[:own] if own and rope.ends[own - 1] == at else np.append(rope.ends[:own], at)
        return leaf(rope.data[:at], head), leaf(rope.data[at:], rope.ends[own:] - at)
    held = rope.left.chars if by_chars else rope.left.units
    if rank <= held:
        a, b = split(rope.left, rank, by_chars)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - held, by_chars)
    return concat(rope.left, a), b


def write(rope: Rope) -> bytes:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if r.left is None:
            out.append(r.data)
        else:
            todo += [r.right, r.left]
    return b"".join(out)


def rearrange(rope: Rope, first: int, second: int, form: str) -> tuple[Rope, Rope, Rope]:
    """The output's rope, and those of prefix and middle."""
    prefix, rest = split(rope, first)
    middle, suffix = split(rest, second - first)
    marked = {k: concat(leaf(k.encode()), part) for k, part in ((P, prefix), (S, suffix), (M, middle))}
    order = (P, S, M) if form == "psm" else (S, P, M)
    return concat(concat(marked[order[0]], marked[order[1]]), marked[order[2]]), prefix, middle


def restored(rope: Rope, ranks: list[int], form: str) -> Rope:
    """The text's rope from an output's whose sentinels start at these code-point ranks, in their order there."""
    parts = []
    for start in reversed(ranks):
        rope, part = split(rope, start, by_chars=True)
        parts.append(split(part, len(P), by_chars=True)[1])
    middle, second, first = parts
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return concat(concat(prefix, middle), suffix)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of all texts, the ends of their units, and the number of each."""
    buf, offs = text_buffer(column)
    starts, ends, counts = word_spans(buf, offs)
    last = np.full(len(counts), 0)
    stop = np.cumsum(counts)
    last[counts > 0] = ends[stop[counts > 0] - 1]
    trailing = np.where(counts > 0, last < offs[1:], offs[1:] > offs[:-1])  # white space behind the last word
    ends = np.insert(ends, stop[trailing], offs[1:][trailing])
    return buf, offs, ends, counts + trailing


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rearrange ``rate`` % of the texts, of these ``spm`` % suffix first.

    Cuts and forms follow from the SHA-256 of seed and id. Returns ``id_col, n`` (units),
    ``form`` (plain, psm or spm), ``prefix_chars, middle_chars`` (null if plain) and ``output``.
    A null text is empty, and an empty text is plain; so is one that holds a sentinel. A null
    id hashes as no digits. Repeated rows give repeated rows; other columns don't pass through.
    No shuffle; a task holds one run of about 4 MB of text, or one longer text.
    """
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            buf, offs, ends, counts = _units(batch.column(1))
            h1, h2, h3, h4 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
            first, second = np.minimum(h1 % (counts + 1), h2 % (counts + 1)), np.maximum(h1 % (counts + 1), h2 % (counts + 1))
            stop = np.cumsum(counts)
            forms, sizes, outputs = [], [], []
            for i in range(batch.num_rows):
                text = buf[offs[i] : offs[i + 1]].tobytes()
                if not text or h3[i] % 100 >= rate or any(k.encode() in text for k in (P, S, M)):
                    forms.append("plain")
                    sizes.append((None, None))
                    outputs.append(text)
                    continue
                forms.append("spm" if h4[i] % 100 < spm else "psm")
                rope, prefix, middle = rearrange(build(text, ends[stop[i] - counts[i] : stop[i]] - offs[i]), int(first[i]), int(second[i]), forms[-1])
                sizes.append((prefix.chars, middle.chars))
                outputs.append(write(rope))
            chars = [pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(forms), *chars, pa.array(outputs, pa.binary()).cast(pa.string())], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col, *h).mapInArrow(run, f"`{id_col}` {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(examples: DataFrame) -> DataFrame:
    """Add ``restored``, the text that ``output`` was made of, from ``form`` and ``output`` alone.

    A null output is empty; every other column, ``restored`` excepted, passes through.
    """
    kept = [c for c in examples.columns if c != "restored"]
    at, how = kept.index("output"), kept.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            buf, offs, ends, counts = _units(batch.column(at))
            stop, out = np.cumsum(counts), []
            for i, form in enumerate(batch.column(how).to_pylist()):
                text = buf[offs[i] : offs[i + 1]].tobytes()
                if form in ("psm", "spm"):
                    ranks = [len(text[: text.index(k.encode())].decode()) for k in (P, S, M)]
                    text = write(restored(build(text, ends[stop[i] - counts[i] : stop[i]] - offs[i]), sorted(ranks), form))
                out.append(text)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*kept, "restored"])

    own = examples.select(*kept)
    return own.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in own.dtypes), "restored string"]))
