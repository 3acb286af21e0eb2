"""Benchmark decontamination on canonical templates.

Words of items and documents are canonicalised: outer punctuation and case go, numbers,
names (capitals) and units behind a number become typed placeholders; a capital that begins
a sentence is read both ways, as a word and as a name.
Windows of template words are hash-joined with those of the items, by their exact words where
more than half are slots (such a passage is found as a copy, not re-parameterised). Matches are gathered
on diagonals (document position minus item position), and the slots under a diagonal, or
under a long stretch of it, must map consistently, so a question that was only
re-parameterised is caught and text that merely has the same shape is not.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prefix_hash, slices, text_buffer, window_hash, window_starts, word_hashes, word_spans

WINDOW = 8
#: Template words that one diagonal must cover, or the whole item if it is shorter.
ENOUGH = 13
#: Items below this many template words never match; they would match everywhere.
LEAST = 4
#: Benchmark words held by a task at once; a larger benchmark is joined in blocks.
HELD = 2_000_000

# Units of measure.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs ms hz khz mhz ghz w kw mw kwh v a b kb mb gb tb meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent dollar dollars euro euros cent cents".split())
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
_QUANTITY = re.compile(r"([+\-]?\d[\d.,]*)([^\W\d]+)$")
_OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$%+-") + "«»“”‘’„…–—¿¡"
_LITERAL, _NUM, _NAME, _UNIT, _NOTHING = range(5)
_TYPED = np.array([0, 0x5E3F1B7A9C2D4E61, 0x7A1C9E5B3D2F4861, 0x1D4F7C2A6B9E8351, 0], np.uint64)


@dataclass
class Template:
    """Words of many texts end to end: hashes of their cores, and template words with whether they are slots.

    ``tokens`` reads a capital that begins a sentence as a literal, ``named`` as a name.
    """

    core: np.ndarray
    tokens: np.ndarray
    typed: np.ndarray
    named: np.ndarray
    named_typed: np.ndarray
    counts: np.ndarray


def _look(word: str) -> tuple[int, str, bool]:
    """A word's kind, its canonical core, and whether it ends a sentence."""
    if word.isalpha() and word.islower():
        return (_UNIT if word in UNITS else _LITERAL), word, False
    ends = word.rstrip("\"'»”’)]}")[-1:] in (".", "!", "?", ":")
    core = word.strip(_OUTER)
    if not core:
        return _NOTHING, core, ends
    if _NUMBER.match(core):
        return _NUM, core.replace(",", ""), ends
    if (m := _QUANTITY.match(core)) and m[2].lower() in UNITS:
        return _NUM, core, ends
    low = core.lower()
    if low in UNITS:
        return _UNIT, low, ends
    return (_NAME if core[0].isupper() and any(map(str.islower, core)) else _LITERAL), low, ends


def template(column: pa.Array | pa.ChunkedArray) -> Template:
    """Canonical templates of texts; null: empty."""
    buf, offs = text_buffer(column)
    starts, ends, counts = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    view = buf.tobytes()
    looks = [_look(view[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    kind = np.array([x[0] for x in looks], np.int8)[inverse]
    stop = np.array([x[2] for x in looks], bool)[inverse]
    cores = [x[1].encode() for x in looks]
    size = np.array([len(c) for c in cores], np.int64)
    flat = np.frombuffer(b"".join(cores) + bytes(8), np.uint8)
    edge = np.cumsum(size)
    core = word_hashes(flat, edge - size, edge)[inverse]
    # where a sentence, a line or the text starts, a capital may be a name or not
    begins = np.ones(len(h), bool)
    begins[1:] = stop[:-1]
    begins[(np.cumsum(counts) - counts)[counts > 0]] = True
    begins |= buf[np.maximum(starts - 1, 0)] == 0x0A
    after = np.zeros(len(h), bool)
    after[1:] = kind[:-1] == _NUM
    after[(np.cumsum(counts) - counts)[counts > 0]] = False  # a number that ends the text before is none of this one's
    kind = np.where((kind == _UNIT) & ~after, _LITERAL, kind)
    keep = kind != _NOTHING
    of = np.repeat(np.arange(len(counts)), counts)[keep]
    named, core = kind[keep], core[keep]
    kind = np.where((named == _NAME) & begins[keep], _LITERAL, named)
    tokens = [np.where(k == _LITERAL, core, _TYPED[k]) for k in (kind, named)]
    return Template(core, tokens[0], kind != _LITERAL, tokens[1], named != _LITERAL, np.bincount(of, minlength=len(counts)))


class Items:
    """A benchmark's windows, by reading and width (short items have one window, themselves).

    Windows are template words in both readings where at least half are literal, and exact
    words where the rest would say too little.
    """

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW):
        t = template(pa.array(texts, pa.string()))
        self.ids, self.counts, self.first = ids, t.counts, np.cumsum(t.counts) - t.counts
        self.core, self.tables = t.core, {}
        for width in sorted({min(window, int(c)) for c in t.counts if c >= LEAST}):
            every = window_starts(t.counts, width) if width == window else self.first[t.counts == width]
            enough, named_enough = (_literals(x, every, width) * 2 >= width for x in (t.typed, t.named_typed))
            for reading, at in (("tokens", every[enough]), ("named", every[named_enough]), ("core", every[~enough])):
                if not len(at):
                    continue
                h = window_hash(prefix_hash(getattr(t, reading)), at, width)
                order = np.argsort(h, kind="stable")
                item = np.searchsorted(self.first + t.counts, at, side="right")
                sieve = np.zeros(1 << 20, bool)
                sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.tables[reading, width] = (h[order], item[order], (at - self.first[item])[order], sieve)

    def _slots(self, t: Template, typed: np.ndarray, tokens: np.ndarray, words: list[int], shift: int) -> list[tuple[int, int, int, int]]:
        """(place in ``words``, kind, the item's value, the document's value) of each slot."""
        return [(k, int(tokens[q]), int(self.core[q + shift]), int(t.core[q])) for k, q in enumerate(words) if typed[q]]

    def matches(self, column: pa.Array, runs: bool = False) -> list[tuple[int, int, int, bool]]:
        """(row, item, template words covered, whether the slots are equal) for each contaminated pair."""
        t = template(column)
        prefix = {reading: prefix_hash(getattr(t, reading)) for reading, _ in self.tables}
        ends = np.cumsum(t.counts)
        first: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        every: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for (reading, width), (keys, item, within, sieve) in self.tables.items():
            at = window_starts(t.counts, width)
            h = window_hash(prefix[reading], at, width)
            maybe = sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            row = np.searchsorted(ends, at, side="right")
            for p, r, a, b in zip(at.tolist(), row.tolist(), low.tolist(), high.tolist()):
                for k in range(a, b):
                    key = r, int(item[k]), p - int(within[k])
                    every[key].append((p, width))
                    if reading == "tokens":
                        first[key].append((p, width))
        found: dict[tuple[int, int], tuple[int, bool]] = {}
        # the first reading by itself, and all windows together with sentence-initial capitals as slots
        for covered, typed, tokens in ((first, t.typed, t.tokens), (every, t.named_typed, t.named)):
            for (r, i, diagonal), windows in covered.items():
                words = sorted({q for p, w in windows for q in range(p, p + w)})
                need = min(ENOUGH, int(self.counts[i]))
                if len(words) < need:
                    continue
                slots = self._slots(t, typed, tokens, words, int(self.first[i]) - diagonal)
                best = _longest_stretch(len(words), slots) if runs else _whole(len(words), slots)
                if best[0] >= need:
                    found[r, i] = max(found.get((r, i), best), best)
        return [(r, i, n, same) for (r, i), (n, same) in sorted(found.items())]


def _whole(n: int, slots: list[tuple[int, int, int, int]]) -> tuple[int, bool]:
    """``n`` words if all slots map one to one, else none; and whether all are equal."""
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    fits = all(there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a for _, kind, a, b in slots)
    return (n if fits else 0), all(a == b for _, _, a, b in slots)


def _longest_stretch(n: int, slots: list[tuple[int, int, int, int]]) -> tuple[int, bool]:
    """The length of the longest stretch of ``n`` words in which each item value has one value, and whether all are equal there.

    Two item values may share one: copies draw theirs at random. A verbatim stretch is such a stretch.
    """
    last: dict[tuple[int, int], tuple[int, int]] = {}
    begin, changed, best = 0, -1, (0, True)  # the place of the last slot with another value
    since: dict[tuple[int, int], int] = {}  # the last place at which an item value had another value than now
    for nth, (k, kind, a, b) in enumerate(slots):
        if (kind, a) in last and last[kind, a][1] != b:
            since[kind, a] = last[kind, a][0]
        last[kind, a] = (k, b)
        stop = since.get((kind, a), -1) + 1
        if stop > begin:
            best, begin = max(best, (k - begin, changed < begin)), stop
        if a != b:
            changed = k
    return max(best, (n - begin, changed < begin))


def _literals(typed: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(~typed)])
    return seen[at + width] - seen[at]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of about HELD words, each small enough for every task to hold."""
    rows = benchmark.select(id_col, text_col)
    size = int(rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 4
    n = max(1, -(-size // HELD))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == b).collect()
        yield Items([r[0] for r in part], [r[1] for r in part])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", runs: bool = False) -> DataFrame:
    """Contaminated pairs: ``id_col, item_col, n_matched, n_item, kind``.

    ``n_matched`` of the item's ``n_item`` template words lie on one diagonal, at least 13
    or all; ``kind`` is ``exact`` if every slot has the item's value, else ``template``.
    With ``runs``, as the queries ask, the longest consistent stretch of a diagonal decides,
    and two of the item's values may become one: a copy with one value edited is found by what
    stands before or behind. Without, one inconsistent slot clears the whole diagonal.
    Null and empty texts on either side match nothing, nor do items of fewer than four
    template words; repeated rows match each for itself. No shuffle: a benchmark block is
    bounded and goes to every task, a larger benchmark is joined block by block. Ids are of any type.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items in _blocks(benchmark, item_col, item_text):

        def match(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                found = items.matches(batch.column(1), runs)
                if found:
                    rows, which, n, same = zip(*found)
                    kinds = pa.array(["exact" if s else "template" for s in same])
                    yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([items.ids[i] for i in which], item_arrow), pa.array(n, pa.int64()), pa.array([int(items.counts[i]) for i in which], pa.int64()), kinds], names=["id", "item", "n_matched", "n_item", "kind"])

        part = docs.select(id_col, text_col).mapInArrow(match, f"id {id_type}, item {item_type}, n_matched long, n_item long, kind string")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_item", "kind")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", runs: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates; ``runs`` as above."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text):

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in items.matches(batch.column(at), runs)]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
