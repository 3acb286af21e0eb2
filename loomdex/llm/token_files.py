"""Token files: an adaptive context-mixing range coder for token ids.

A block holds up to ``BLOCK`` ids and is coded by models that start empty, so a block decodes
by itself, without any other block or table. Its ids are numbered as they first appear. The
order-2 and the order-1 context each predict one number, with a confidence that rises when it
comes true. The order-0 prediction is a distribution over the numbers that neither foresaw, by
their counts in the block so far, recent ones weighing more; a number that isn't in it yet is
an escape to the next id of the block's list. The joint confidence of the contexts picks
adaptive weights, and an id's share of the mixture

    P(id) = w2 [id = predicted by order 2] + w1 [id = predicted by order 1] + w0 P0(id)

is its share of a coder's range. Which of the three it was, and the numbers that are left to
order 0, have range coders of their own, so that order 0 decodes before the contexts do. The
distribution is renewed every ``RENEW`` of its numbers, contexts and weights every ``LEARN``
positions: all that was met in between is learned in a few array operations, lane by lane. The
blocks of a file are coded side by side, one lane a block, a numpy step for each position; a
lane's bytes don't depend on the other lanes.

File: magic, a JSON header's length and the header (counts, block size, bits of an id), then
the document ids and lengths, a block index (bytes, and CRC-32 of the bytes and of the ids of
each block), the CRC-32 of all that, and the blocks. Files are rows of a Parquet table with
one binary column, so that any store Spark writes to holds them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import slices, total_words

MAGIC = b"LDXTOK3\n"
BLOCK = 16_384
#: Order-0 numbers between two renewals of their distribution, fewer at first; positions between two of the contexts.
RENEW = 96
LEARN = 64
_SLOTS = 4096  # of the order-2 context, in a block
MOST_BROADCAST = 500_000
_LANES = 2048  # blocks coded side by side at most: more than a file of write_token_files has, as a rule
_ONE = 64  # what an occurrence adds to an id's order-0 share; an eighth goes at each renewal
_FADE = 3  # that eighth, as a shift
_TOTAL = 15  # bits of a lane's order-0 total: more than a block has ids
_WAYS = 4  # coders of a lane's order-0 numbers
_GROUP = 512  # lanes whose order-0 numbers are coded side by side
_COARSE = 10  # bits of the steps in which the decoder looks a place up
_WORD, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)
_12, _BITS, _LAST = map(np.uint64, (12, _TOTAL, (1 << _TOTAL) - 1))
_FINE, _ROUND = np.uint16(_TOTAL - _COARSE), np.uint16((1 << _TOTAL - _COARSE) - 1)
_MOST = 16_384  # a mixture's counts are halved beyond this sum; an id counts 64
_M1, _M2, _SHIFT = map(np.uint32, (0x9E3779B1, 0x85EBCA6B, 32 - 12))
_0, _1, _2, _3, _4096 = map(np.uint16, (0, 1, 2, 3, 4096))


class _Contexts:
    """Orders 2 and 1 (rows 0 and 1) and the weights, of all lanes. A context's slot holds its predicted
    number and, in the low two bits, the confidence; order 1 has a slot for each number of the block.

    Slots and weights are renewed every ``LEARN`` positions. ``bounds`` holds each mixture's running sums
    out of 4096: nothing, order 2, order 1 too, all. There are 32 mixtures a lane, by both confidences and
    whether the predictions agree, each with the counts of what came true.
    """

    def __init__(self, kinds: np.ndarray):
        self.lanes = lanes = len(kinds)
        self.table = np.zeros(lanes * _SLOTS + int(kinds.sum()), np.uint16)
        self.base2, self.base1 = np.arange(lanes) * _SLOTS, lanes * _SLOTS + np.cumsum(kinds) - kinds
        self.wbase = np.arange(lanes) * 32
        self.counts = np.repeat(np.array([[640], [128], [256]], np.int32), lanes * 32, axis=1)
        self.bounds = np.zeros((4, lanes * 32), np.uint16)
        self.bounds[3] = 4096
        self.last = np.zeros((lanes, 2), np.uint16)
        self.weigh(lanes)

    def weigh(self, n: int) -> None:
        none, one, two = counts = self.counts[:, : n * 32]
        both = one + two
        total = both + none
        scale = np.float32(4093) / total.astype(np.float32)
        self.bounds[1, : n * 32] = two * scale + np.float32(1)
        self.bounds[2, : n * 32] = both * scale + np.float32(2)
        many = (total > _MOST).nonzero()[0]
        counts[:, many] -= counts[:, many] >> 1

    def learn(self, y: np.ndarray, first: bool, judge: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers that follow in the first lanes, a row a lane; ``first``: they begin the block. What came true
        (2 or 3: order 2, 1: order 1, 0: neither) and its bounds in the mixture if ``judge`` asks for them."""
        n, q = y.shape
        came = np.empty((n, q), np.uint8)
        begin, end = np.empty((2, n, q) if judge else (2, 0, 0), np.uint16)
        for a in range(0, n, 64):  # lanes whose slots stay in the processor's cache
            b = min(a + 64, n)
            x = y[a:b]
            met = np.concatenate([self.last[a:b], x], axis=1)
            key = met * _M1
            slot = np.empty((2, b - a, q), np.int64)
            np.add((key[:, 1:-1] ^ (key[:, :-2] * _M2)) >> _SHIFT, self.base2[a:b, None], out=slot[0])
            np.add(met[:, 1:-1], self.base1[a:b, None], out=slot[1])
            held = self.table.take(slot)
            number, sure = held >> _2, held & _3
            hit = number == x
            if first:
                hit[:, :, 0] = False  # an empty slot holds number 0, which is the first id's
            case = hit.view(np.uint8)
            came[a:b] = e = (case[0] << 1) | case[1]
            at = ((sure[0] << _3) | (sure[1] << _1) | (number[0] == number[1])) + (self.wbase[a:b, None] - a * 32)
            if judge:
                mixtures = self.bounds[:, a * 32 : b * 32]
                first_two, both = mixtures[1].take(at), mixtures[2].take(at)
                begin[a:b] = np.where(hit[0], _0, np.where(hit[1], first_two, both))
                end[a:b] = np.where(hit[0], first_two, np.where(hit[1], both, _4096))
            width = (b - a) * 32
            k = e * np.int64(width)
            k += at
            found = np.bincount(k.ravel(), minlength=4 * width).reshape(4, width)
            found[2] += found[3]
            self.counts[:, a * 32 : b * 32] += (found[:3] << 6).astype(np.int32)
            # true: more confident; false: less, and replaced once confidence is gone
            new = (x << _2) | _1
            new = np.where(sure > _1, held - _1, new)
            np.copyto(new, held + (sure < _3), where=hit)
            self.table[slot] = new
            self.last[a:b] = met[:, -2:]
        self.weigh(n)
        return came, begin, end


class _Order0:
    """Each lane's distribution over the numbers that escaped so far, from place 1 on; place 0 is the escape.

    ``starts`` holds a lane's running sums out of ``1 << _TOTAL``; each place in use has one at least.
    """

    def __init__(self, kinds: np.ndarray):
        self.width = int(kinds.max(initial=0)) + 2
        lanes = len(kinds)
        self.share = np.zeros((lanes, self.width), np.int32)
        self.starts = np.zeros((lanes, self.width), np.uint16)
        self.row = np.arange(lanes) * self.width
        self.used, self.listed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.total = np.zeros(lanes, np.int64)
        self.places = np.arange(self.width, dtype=np.uint16)

    def renew(self, t: int, n: int) -> int:
        """Distributions of the first n lanes at position t; they hold up to the position returned."""
        for a in range(0, n, 64):  # lanes whose rows stay in the processor's cache
            b = min(a + 64, n)
            wide = int(self.used[a:b].max()) + 2
            share, used = self.share[a:b, :wide], self.used[a:b]
            # an escape is as likely as new ids were so far
            share[:, 0] = np.maximum(1, self.total[a:b] * self.listed[a:b] // max(1, t))
            sums = np.cumsum(share[:, :-1], axis=1, dtype=np.int32)
            scale = ((1 << _TOTAL) - used - 1).astype(np.float32) / sums[:, -1].astype(np.float32)
            part = sums.astype(np.float32)
            part *= scale[:, None]
            starts = part.astype(np.int32).astype(np.uint16)
            starts += np.minimum(self.places[1:wide], (used + 1).astype(np.uint16)[:, None])
            self.starts[a:b, 1:wide] = starts
        return t + min(RENEW, max(8, t // 8)) // _WAYS * _WAYS

    def learn(self, numbers: np.ndarray, listed: np.ndarray) -> None:
        """The numbers met since the last renewal (steps, lanes that go on, ways) and how many of them were escapes."""
        n = numbers.shape[1]
        for a in range(0, n, 64):
            b = min(a + 64, n)
            met = numbers[:, a:b]
            self.used[a:b] = np.maximum(self.used[a:b], met.max(axis=(0, 2)) + np.int64(1))
            share = self.share[a:b, : int(self.used[a:b].max()) + 2]
            share -= share >> _FADE
            np.add.at(self.share.reshape(-1), (met + (self.row[a:b, None] + 1)).ravel(), np.int32(_ONE))
        self.total[:n] += len(numbers) * _WAYS * _ONE - (self.total[:n] >> _FADE)
        self.listed[:n] += listed


class _Writer:
    """Range coders side by side, one a lane."""

    def __init__(self, lanes: int, words: int):
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
        self.out, self.used = np.zeros((lanes, words), np.uint32), np.zeros(lanes, np.int64)
        self.flat, self.row = self.out.reshape(-1), np.arange(lanes) * words

    def put(self, begin: np.ndarray, span: np.ndarray, full: bool = True) -> None:
        """Narrow the first lanes' ranges to ``span`` from ``begin`` on; ``full``: write what is settled."""
        n = len(begin)
        low = self.low[:n]
        low += begin
        over = low < begin
        if over.any():
            over = over.nonzero()[0]
            k = self.row[over] + self.used[over] - 1
            while len(k):
                self.flat[k] += np.uint32(1)  # 0xFFFFFFFF becomes 0 and carries on
                k = k[self.flat[k] == 0] - 1
        self.span[:n] = span
        if full:
            small = (span <= _LOW).nonzero()[0]
            if len(small):
                self.emit(small)

    def emit(self, which: np.ndarray) -> None:
        x, k = self.low[which], self.used[which]
        self.flat[self.row[which] + k] = x >> _WORD
        self.used[which] = k + 1
        self.low[which] = x << _WORD
        self.span[which] <<= _WORD

    def done(self) -> list[np.ndarray]:
        every = np.arange(len(self.low))
        self.emit(every[self.span <= _LOW])
        self.put(np.full(len(every), _LOW), self.span, False)  # one word more tells a number in the range
        self.emit(every)
        return [x[:k].astype("<u4") for x, k in zip(self.out, self.used)]


class _Reader:
    """The inverse of ``_Writer``."""

    def __init__(self, words: list[np.ndarray]):
        lanes = len(words)
        given = np.zeros((lanes, max(map(len, words), default=0) + 3), np.uint32)
        for lane, w in enumerate(words):
            given[lane, : len(w)] = w
        self.code = (given[:, 0].astype(np.uint64) << _WORD) | given[:, 1]
        self.flat, self.next = given.reshape(-1), np.arange(lanes) * given.shape[1] + 2
        self.span = np.full(lanes, ~np.uint64(0))

    def took(self, begin: np.ndarray, span: np.ndarray, full: bool = True) -> None:
        n = len(begin)
        self.code[:n] -= begin
        self.span[:n] = span
        small = (span <= _LOW).nonzero()[0] if full else ()
        if len(small):
            k = self.next[small]
            self.code[small] = (self.code[small] << _WORD) | self.flat[k]
            self.next[small] = k + 1
            self.span[small] <<= _WORD


def _lanes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the lanes by falling size, and how many are on at each step."""
    order = np.argsort(-size, kind="stable")
    steps = int(size.max(initial=0))
    return order, np.searchsorted(-size[order], -np.arange(steps), side="left")


def _numbered(block: np.ndarray, memory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids numbered in the order in which they first appear: numbers, and the ids by number."""
    at = np.arange(len(block), dtype=np.int32)
    memory[block[::-1]] = at[::-1]
    names = block[memory[block] == at]
    memory[names] = at[: len(names)]
    return memory[block].astype(np.uint16), names


def _code_order0(runs: list[np.ndarray], kinds: np.ndarray) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Each run of numbers, of a lane of so many kinds: its words, way by way, and the numbers that were escapes.

    A lane's positions go to its ways in turn, so that a step codes one for each; the last step is filled up
    with number 0.
    """
    size = np.array([-(-len(x) // _WAYS) for x in runs])
    order, on = _lanes(size)
    lanes, steps = len(runs), len(on)
    x = np.zeros((steps, lanes, _WAYS), np.uint16)
    for lane, b in enumerate(order):
        x[: size[b], lane] = np.append(runs[b], np.zeros(-len(runs[b]) % _WAYS, np.uint16)).reshape(-1, _WAYS)
    zero, coder, fresh = _Order0(kinds[order]), _Writer(lanes * _WAYS, steps // 2 + 24), np.zeros(x.shape, bool)
    t = 0
    while t < steps:
        n = int(on[t])
        due = min(zero.renew(t * _WAYS, n) // _WAYS, steps)
        y = x[t:due, :n]
        fresh[t:due, :n] = new = y >= zero.used[:n, None]
        place = np.where(new, 0, y + np.int64(1)) + zero.row[:n, None]
        start = zero.starts.take(place)
        place += 1
        share = (zero.starts.take(place) - start).reshape(due - t, -1)
        start = start.reshape(due - t, -1)
        for j in range(due - t):
            m = int(on[t + j]) * _WAYS
            r = coder.span[:m] >> _BITS
            coder.put(start[j, :m] * r, share[j, :m] * r, (t + j) % 2 == 1)
        if due < steps:
            m = int(on[due])
            zero.learn(y[:, :m], new[:, :m].sum(axis=(0, 2)))
        t = due
    coded = coder.done()
    words: list[list[np.ndarray]] = [[]] * lanes
    listed = [x[:0, 0, 0]] * lanes
    for lane, b in enumerate(order):
        words[b], listed[b] = coded[lane * _WAYS : (lane + 1) * _WAYS], x[: size[b], lane][fresh[: size[b], lane]]
    return words, listed


def _decode_order0(words: list[list[np.ndarray]], size: np.ndarray, listed: list[np.ndarray], kinds: np.ndarray) -> list[np.ndarray]:
    """The runs, of ``size`` numbers."""
    order, on = _lanes(-(-size // _WAYS))
    lanes, steps = len(words), len(on)
    zero, coder = _Order0(kinds[order]), _Reader([w for b in order for w in words[b]])
    x = np.zeros((steps, lanes, _WAYS), np.uint16)
    names = np.concatenate([np.zeros(0, np.uint16), *(listed[b] for b in order), np.zeros(1, np.uint16)])
    count = np.array([len(listed[b]) for b in order])
    first = np.cumsum(count) - count
    upto, t = first.copy(), 0
    # the place in which a coarse step of a lane's range begins
    cells = (1 << _COARSE) + 1
    find, frow, row = np.zeros((lanes, cells), np.uint16), np.repeat(np.arange(lanes) * cells, _WAYS), np.repeat(zero.row, _WAYS)
    ends = zero.starts.reshape(-1)
    while t < steps:
        n = int(on[t])
        due = min(zero.renew(t * _WAYS, n) // _WAYS, steps)
        for a in range(0, n, 64):
            b = min(a + 64, n)
            wide = int(zero.used[a:b].max()) + 1
            cell = ((zero.starts[a:b, :wide] + _ROUND) >> _FINE) + (np.arange(b - a) * cells)[:, None]
            part = find[a:b]
            part[...] = 0
            part.reshape(-1)[cell.ravel()] = np.broadcast_to(zero.places[:wide], cell.shape).ravel()
            np.maximum.accumulate(part, axis=1, out=part)
        for j in range(t, due):
            m = int(on[j]) * _WAYS
            r = coder.span[:m] >> _BITS
            want = np.minimum(coder.code[:m] // r, _LAST).astype(np.uint16)
            at = find.take((want >> _FINE) + frow[:m]) + row[:m]
            stop = ends.take(at + 1)
            go = (stop <= want).nonzero()[0]
            k, w = at[go] + 1, want[go]
            while len(go):
                e = ends.take(k + 1)
                here = e > w
                at[go[here]], stop[go[here]] = k[here], e[here]
                on_ = (~here).nonzero()[0]
                k, w, go = k[on_] + 1, w[on_], go[on_]
            start = ends.take(at)
            coder.took(start * r, (stop - start) * r, j % 2 == 1)
            at -= row[:m] + 1
            new = (at < 0).nonzero()[0]
            if len(new):
                lane = new // _WAYS
                at[new] = names.take(upto[lane] + (np.arange(len(lane)) - np.searchsorted(lane, lane)))
                upto[: m // _WAYS] += np.bincount(lane, minlength=m // _WAYS)
            x[j, : m // _WAYS] = at.reshape(-1, _WAYS)
        if due < steps:
            m = int(on[due])
            zero.learn(x[t:due, :m], (upto - first)[:m] - zero.listed[:m])
        t = due
    found = [x[:0, 0, 0]] * lanes
    for lane, b in enumerate(order):
        found[b] = x[:, lane].reshape(-1)[: size[b]]
    return found


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Each block's bytes; no id needs more than ``bits`` (24 at most), no block has more than ``BLOCK`` ids."""
    size = np.array([len(b) for b in blocks])
    order, on = _lanes(size)
    lanes, steps = len(blocks), len(on)
    memory = np.zeros(1 << bits, np.int32)
    x, names = np.zeros((lanes, steps), np.uint16), []
    for lane, b in enumerate(order):
        x[lane, : size[b]], found = _numbered(blocks[b], memory)
        names.append(found)
    kinds = np.array([len(found) for found in names])
    missed = np.zeros((lanes, steps), bool)
    ctx, coder = _Contexts(kinds), _Writer(lanes, steps // 2 + 4)
    t = 0
    while t < steps:
        n, due = int(on[t]), min(t + LEARN, steps)
        came, begin, end = ctx.learn(x[:n, t:due], t == 0, judge=True)
        missed[:n, t:due] = came == 0
        begin, share = np.ascontiguousarray(begin.T), np.ascontiguousarray((end - begin).T)
        for j in range(due - t):
            m = int(on[t + j])
            r = coder.span[:m] >> _12
            coder.put(begin[j, :m] * r, share[j, :m] * r, j % 2 == 1)  # two steps take 24 bits at most
        t = due
    runs = [x[lane, : size[b]][missed[lane, : size[b]]] for lane, b in enumerate(order)]
    words, listed = [], []
    for a in range(0, lanes, _GROUP):
        both = _code_order0(runs[a : a + _GROUP], kinds[a : a + _GROUP])
        words += both[0]
        listed += both[1]
    coded: list[bytes] = [b""] * lanes
    for b, events, run, w, found, new in zip(order, coder.done(), runs, words, names, listed):
        ids = found[new].astype("<u4").view(np.uint8).reshape(-1, 4)
        deflate = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
        high = deflate.compress(ids[:, 1:3].T.tobytes() if bits > 16 else ids[:, 1].tobytes()) + deflate.flush()
        head = np.array([len(run), len(new), len(high), len(events), *map(len, w[1:])], "<u2").tobytes()
        coded[b] = b"".join([head, high, ids[:, 0].tobytes(), events.tobytes(), *(v.tobytes() for v in w)])
    return coded


def decode_blocks(coded: list[bytes], size: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of blocks of ``size`` ids each."""
    order, on = _lanes(size)
    lanes, steps = len(coded), len(on)
    memory = np.zeros(1 << bits, np.int32)
    met, listed, names, events, words = [], [], [], [], []
    for b in order:
        n, new, high, k, *more = np.frombuffer(coded[b], "<u2", 3 + _WAYS).tolist()
        ids, at = np.zeros((4, new), np.uint8), 6 + 2 * _WAYS + high
        planes = np.frombuffer(zlib.decompress(coded[b][6 + 2 * _WAYS : at], -15), np.uint8).reshape(-1, new) if new else ids[:1]
        ids[1 : 1 + len(planes)] = planes
        ids[0] = np.frombuffer(coded[b], np.uint8, new, at)
        numbers, found = _numbered(np.ascontiguousarray(ids.T).view("<u4").reshape(-1).astype(np.uint32), memory)
        rest = np.frombuffer(coded[b][at + new :], "<u4")
        met.append(n), listed.append(numbers), names.append(found), events.append(rest[:k])
        cut = np.cumsum([len(rest) - sum(more), *more])
        words.append(np.split(rest[k:], cut[:-1] - k))
    kinds = np.array([len(found) for found in names], np.int64)
    size0 = np.array(met, np.int64)
    run = np.zeros((lanes, int(size0.max(initial=0)) + LEARN + 40), np.uint16)
    for a in range(0, lanes, _GROUP):
        b = a + _GROUP
        for lane, found in enumerate(_decode_order0(words[a:b], size0[a:b], listed[a:b], kinds[a:b]), a):
            run[lane, : len(found)] = found
    run, place = run.reshape(-1), np.arange(lanes) * run.shape[1]
    x = np.zeros((lanes, steps), np.uint16)
    ctx, coder = _Contexts(kinds), _Reader(events)
    met, t = np.zeros((lanes, LEARN + 2), np.uint16), 0
    while t < steps:
        n, due = int(on[t]), min(t + LEARN, steps)
        met[:, :2] = ctx.last
        near = np.ascontiguousarray(run.take(place[:n, None] + np.arange(due - t)).T).reshape(-1)  # that neither order may foresee
        nth = np.arange(n)
        two_back, back = met[:, 0] * _M1 * _M2, met[:, 1].copy()
        for j in range(t, due):
            m = int(on[j])
            key = back[:m] * _M1
            slot = np.empty((2, m), np.int64)
            np.add((key ^ two_back[:m]) >> _SHIFT, ctx.base2[:m], out=slot[0])
            np.add(back[:m], ctx.base1[:m], out=slot[1])
            held = ctx.table.take(slot)
            number, sure = held >> _2, held & _3
            at = ((sure[0] << _3) | (sure[1] << _1) | (number[0] == number[1])) + ctx.wbase[:m]
            r = coder.span[:m] >> _12
            code = coder.code[:m]
            a, b = ctx.bounds[1].take(at) * r, ctx.bounds[2].take(at) * r
            two, none = code < a, code >= b
            begin = np.where(none, b, a)
            begin[two] = 0
            end = np.where(two, a, b)
            np.copyto(end, r << _12, where=none)
            coder.took(begin, end - begin, (j - t) % 2 == 1)
            y = np.where(two, number[0], number[1])
            np.copyto(y, near.take(nth[:m]), where=none)
            nth[:m] += none * n
            met[:m, j - t + 2] = y
            two_back[:m] = key * _M2
            back[:m] = y
        place[:n] += nth // n
        x[:n, t:due] = met[:n, 2 : due - t + 2]
        if due < steps:
            ctx.learn(x[: int(on[due]), t:due], t == 0)
        t = due
    ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, b in enumerate(order):
        ids[b] = names[lane][x[lane, : size[b]]]
    return ids


def pack_file(names: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One file of documents (integer names, null flags, token counts) and their ids end to end."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    blocks = [ids[i : i + block] for i in range(0, len(ids), block)]
    coded = [x for i in range(0, len(blocks), _LANES) for x in encode_blocks(blocks[i : i + _LANES], bits)]
    index = np.array([(len(c), zlib.crc32(c), zlib.crc32(b.astype("<u4").tobytes())) for c, b in zip(coded, blocks)], "<u4").reshape(-1, 3)
    documents = zlib.compress(names.astype("<i8").tobytes() + null.astype("u1").tobytes() + counts.astype("<i8").tobytes())
    head = json.dumps({"documents": len(counts), "bytes": len(documents), "ids": len(ids), "block": block, "bits": bits}).encode()
    front = b"".join([MAGIC, len(head).to_bytes(4, "little"), head, documents, index.tobytes()])
    return b"".join([front, zlib.crc32(front).to_bytes(4, "little"), *coded])


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of ``pack_file``; raises if the magic or a checksum is wrong."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 12 + int.from_bytes(data[8:12], "little")
    head = json.loads(data[12:at])
    n, size = head["documents"], head["block"]
    k = -(-head["ids"] // size)
    first = at + head["bytes"]
    end = first + 12 * k
    if zlib.crc32(data[:end]) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError("the tables' checksum is wrong")
    documents = zlib.decompress(data[at:first])
    names, null, counts = np.frombuffer(documents, "<i8", n), np.frombuffer(documents, "u1", n, 8 * n), np.frombuffer(documents, "<i8", n, 9 * n)
    index = np.frombuffer(data, "<u4", 3 * k, first).reshape(-1, 3)
    ends = end + 4 + np.cumsum(index[:, 0], dtype=np.int64)
    coded = [data[e - w : e] for e, w in zip(ends.tolist(), index[:, 0].tolist())]
    if any(zlib.crc32(c) != want for c, want in zip(coded, index[:, 1].tolist())):
        raise ValueError("a block's checksum is wrong")
    sizes = np.full(k, size)
    sizes[-1:] = head["ids"] - size * (k - 1)
    blocks = []
    for i in range(0, k, _LANES):
        blocks += decode_blocks(coded[i : i + _LANES], sizes[i : i + _LANES], head["bits"])
    for b, want in zip(blocks, index[:, 2].tolist()):
        if zlib.crc32(b.astype("<u4").tobytes()) != want:
            raise ValueError("a block's checksum is wrong")
    return names, null.astype(bool), counts, np.concatenate([np.zeros(0, np.uint32), *blocks])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_words: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole texts' ids, each followed by ``end_id``, as token files in ascending id order.

    Each file holds a range of ids and, within an id, of text hashes, so that an id with many
    rows fills several files. Null ids come first, null and empty texts have their end id
    alone. One shuffle of the text.
    """
    n = max(1, -(-total_words(docs, text_col) // file_words))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "id", "hash").sortWithinPartitions("id", "hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import Encoder, with_end

        coder = Encoder.at(tokenizer)
        names, null, counts, ids, first = [], [], [], [], None
        for batch in slices(batches, 2):
            first = first or (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            i, c = with_end(*coder.encode(batch.column(2)), end_id)
            names.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            counts.append(c)
            ids.append(i.astype(np.uint32))
        if sum(map(len, names)):
            names, null, counts, ids = (np.concatenate(x) for x in (names, null, counts, ids))
            data = pack_file(names, null, counts, ids)
            yield pa.record_batch([pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["first_id", "first_hash", "n_ids", "data"])

    rows.mapInArrow(write, "first_id long, first_hash long, n_ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids`` (little-endian unsigned 32-bit).

    Every block's checksum is tested. Starts are running sums over the files' totals, one
    narrow row a file, joined back to the documents: sent to every task up to
    ``MOST_BROADCAST`` files, by a shuffle of the documents beyond.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, nth, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                names, null, counts, ids = unpack_file(data.as_py())
                ends = np.concatenate([[0], np.cumsum(counts)])
                for i in range(0, len(counts), 2048):
                    j = min(i + 2048, len(counts))
                    part = ids[ends[i] : ends[j]].astype("<u4")
                    held = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((ends[i : j + 1] - ends[i]) * 4).astype(np.int32)), pa.py_buffer(part)])
                    yield pa.record_batch([pa.array([first] * (j - i), pa.int64()), pa.array([nth] * (j - i), pa.int64()), pa.array(names[i:j], pa.int64(), mask=null[i:j]), pa.array(ends[i:j]), pa.array(counts[i:j]), held], names=["first_id", "first_hash", "doc_id", "within", "n_tokens", "ids"])

    files = spark.read.parquet(path)
    before = Window.orderBy(F.asc_nulls_first("first_id"), "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("first_id").alias("file"), F.col("first_hash").alias("nth"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    if files.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    rows = files.select("first_id", "first_hash", "data").mapInArrow(read, "first_id long, first_hash long, doc_id long, within long, n_tokens long, ids binary")
    return rows.join(starts, rows.first_id.eqNullSafe(starts.file) & (rows.first_hash == starts.nth)).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names (the warehouse where it is unset)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/token-files-{uuid.uuid4().hex}"
