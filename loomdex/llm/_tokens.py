"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

Both vocabularies split at white space before they merge: no pre-token of the byte-level
kind has a space other than as its first character, and the word kind drops white space.
So a text may be cut before every single space or newline that stands between two
characters that are not white space, and between an ASCII letter and a punctuation mark,
without changing an id; pieces are looked up by their
bytes' hash among those met before by this worker, and only new ones go to the library.
Texts with other white space around a cut keep that stretch in one piece, and texts that hold
an added token's string, such as ``<|endoftext|>``, go to the library whole: it splits them there first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import text_buffer, word_hashes

#: Pieces a worker remembers; at more it starts afresh. Bounds its memory.
REMEMBER = 3_000_000

#: Pieces that may stand between separators: no white space but one in front, no control character.
_PLAIN = re.compile(r" ?[^\s\x00-\x1f\x7f-\xa0]+\Z")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ",.;:!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F]] = True
_workers: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer file with the memory of one Python worker."""

    def __init__(self, path: str, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = special_as_text  # their strings in a text are ordinary text
        added = [t for t in self.tool.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.marks = [t.content for t in added]
        self.every = any(t.normalized for t in added)  # these are looked for in the normal form, so any text may hold them
        self.between, self.mark = self._separator()
        self.forget()

    def _separator(self) -> tuple[str | None, int]:
        """A string between pieces that becomes one id of its own and leaves theirs alone, if there is one."""
        ids = lambda x: self.tool.encode(x, add_special_tokens=False).ids
        for between in ("\n", " \x01 "):
            mark = ids("ab" + between + "ab")[len(ids("ab")) : -len(ids("ab"))]
            probes = ["ab", " ab", "ab,", " ,", "é", " 12", "x'", " İ", "。"]
            if len(mark) == 1 and not any(between in x for x in self.marks) and all(ids(a + between + b) == ids(a) + mark + ids(b) for a in probes for b in probes):
                return between, mark[0]
        return None, -1

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The worker's own, with the library's defaults: an added token's string is that token."""
        if path not in _workers:
            _workers[path] = cls(path, special_as_text=False)
        return _workers[path]

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces, whose hashes are sorted, and merge them into the sorted memory."""
        size, found = np.zeros(len(pieces), np.int32), []
        plain = [] if self.between is None else [i for i, p in enumerate(pieces) if _PLAIN.match(p)]
        for a in range(0, len(plain), 1024):  # many pieces as one text, cut apart at the separator's id
            part = plain[a : a + 1024]
            ids = np.array(self.tool.encode_batch_fast([self.between.join(pieces[i] for i in part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(part) - 1:
                size[part] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                found.append((part, np.delete(ids, cut)))
        done = {i for part, _ in found for i in part}
        rest = [i for i in range(len(pieces)) if i not in done]
        for a in range(0, len(rest), 1024):
            part = rest[a : a + 1024]
            each = [e.ids for e in self.tool.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)]
            size[part] = [len(x) for x in each]
            found.append((part, np.array([y for x in each for y in x], np.uint32)))
        order = np.array([i for part, _ in found for i in part], np.int64)
        stop = np.cumsum(size[order])
        first = np.zeros(len(pieces), np.int64)
        first[order] = len(self.ids) + stop - size[order]
        ids = np.concatenate([self.ids, *(x for _, x in found)])
        self.ids = ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids.astype(np.uint32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text. Null: none."""
        marked = np.full(len(column), self.every)
        for mark in self.marks:
            marked |= pc.match_substring(column, mark).fill_null(False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_pieces(column)
        ids, counts = self._encode_pieces(pc.if_else(pa.array(marked), pa.scalar(None, column.type), column))
        whole = [e.ids for e in self.tool.encode_batch_fast([x or "" for x in column.filter(pa.array(marked)).to_pylist()], add_special_tokens=False)]
        counts = counts.copy()
        counts[marked] = [len(x) for x in whole]
        out, here = np.empty(int(counts.sum()), np.uint32), np.repeat(marked, counts)
        out[here], out[~here] = [y for x in whole for y in x], ids
        return out, counts

    def _encode_pieces(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = text_buffer(column)
        n = int(offs[-1])
        raw = buf[:n]
        space = _SPACE[raw]
        # a cut before a lone space or newline, and behind a newline, between ink
        lone = np.zeros(n, bool)
        if n > 2:
            lone[1:-1] = ((raw[1:-1] == 0x20) | (raw[1:-1] == 0x0A)) & ~space[:-2] & ~space[2:]
            odd = np.flatnonzero(raw >= 0xC2)  # white space beyond ASCII starts with C2, E1, E2 or E3 and ends below C0
            wide = odd[np.isin(raw[odd], (0xC2, 0xE1, 0xE2, 0xE3))]
            lone[np.maximum(wide - 1, 0)] = False
            for back in (2, 3):
                after = wide + back
                lone[after[after < n]] = False
        lone[offs[:-1][offs[:-1] < n]] = False
        lone[offs[1:][offs[1:] > 0] - 1] = False
        cut = lone.copy()
        cut[1:] |= lone[:-1] & (raw[:-1] == 0x0A)
        cut[1:] |= _STOP[raw[1:]] & _LETTER[raw[:-1]]  # a run of letters ends before punctuation
        cut[offs[:-1][offs[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)[: len(starts)]
        per = np.diff(np.searchsorted(starts, offs))
        h = word_hashes(buf, starts, ends)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBER:
            self.forget()
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == u[inside]
        if not known.all():
            view = buf.tobytes()
            new = np.flatnonzero(~known)
            self.learn(u[new], [view[starts[i] : ends[i]].decode() for i in first[new]])
            at = np.searchsorted(self.keys, u)
        size, begin = self.size[at][inverse].astype(np.int64), self.first[at][inverse]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.arange(total) + np.repeat(begin - (stop - size), size)]
        held = np.concatenate([[0], stop])
        edge = np.concatenate([[0], np.cumsum(per)])
        return ids, held[edge[1:]] - held[edge[:-1]]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` behind each text."""
    stop = np.cumsum(counts + 1)
    out = np.empty(len(ids) + len(counts), ids.dtype)
    last = np.zeros(len(out), bool)
    last[stop - 1] = True
    out[last] = end
    out[~last] = ids
    return out, counts + 1
