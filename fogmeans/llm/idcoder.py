"""Adaptive context-mixing range coder of token ids, in blocks that are reset, checked and coded side by side.

Each block is a lane of numpy arrays: step t codes the t-th id of every block at once. Order 2 (where its context is new:
order 1) predicts the id that last followed the context. A lane mixes three adaptive estimates (of order 2's confidence, of
order 1's and whether the two agree, of the predicted id's count in the block, order 0) into the odds that the prediction
holds, on a log-odds scale with weights that learn. An id that is not predicted is coded by its order-0 share, which the blocks
of one section have in common (Shares). Both decisions narrow the range before it is widened once. All arithmetic is of
integers, so files read the same on any machine.
"""

from __future__ import annotations

import zlib
from decimal import Decimal, getcontext
from functools import lru_cache

import numpy as np

#: Ids of a block at most, and blocks coded side by side.
BLOCK = 4096
LEAST_BLOCK = 256
LANES = 4096
#: Slots a block has for order 1, order 2 and the counts of order 0 (powers of two).
SLOTS_1, SLOTS_2, SLOTS_0 = 256, 512, 256
#: Bits of a probability, of the log-odds on either side, and of one in a weight.
P_BITS, ODDS, ONE = 12, 2047, 16
#: Bits of the order-0 shares; ids below LISTED, SHARED of them at most, have a share of their own, the others are written out.
SHARE_BITS, SHARED, LISTED = 20, 1 << 18, 1 << 20
#: Bits of the range at most, and the width below which a word of 32 bits leaves it.
RANGE_BITS, LEAST_BITS = 62, 30
LEAST = 1 << LEAST_BITS
#: Steps between two looks at the weights, which have at most WEIGHT then.
SPARE, WEIGHT = 16, 1 << 17
#: First context of each of the three estimates among a block's 32: by order 2's confidence, by order 1's and whether they agree, by the predicted id's count.
PLACES = (0, 8, 24)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each log-odds, log-odds of each probability, and the bucket of each count.

    Decimal arithmetic rounds the same everywhere, so that coders on different machines agree.
    """
    getcontext().prec = 28
    squash = [int((1 << P_BITS) / (1 + (Decimal(-x) / 256).exp())) for x in range(-ODDS, ODDS + 1)]
    squash = np.clip(np.array(squash, dtype=np.int32), 4, (1 << P_BITS) - 4)  # 10 bits, and SHARE_BITS, fit in the least width
    stretch = (np.searchsorted(squash, np.arange(1 << P_BITS), side="left").clip(0, 2 * ODDS) - ODDS).astype(np.int32)
    bucket = np.array([min(7, n.bit_length()) for n in range(BLOCK + 1)], dtype=np.int64)
    return squash, stretch, bucket


class Shares:
    """Order 0: of the most frequent ids their shares of 2 ** SHARE_BITS, and one share for all others, which follow in 16-bit halves."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.ids, self.shares = ids.astype(np.int64), shares.astype(np.int64)
        self.first = np.cumsum(self.shares) - self.shares
        self.symbol = np.repeat(np.arange(len(self.shares), dtype=np.int32), self.shares)  # of each number below 2 ** SHARE_BITS
        #: place among the shares of each id up to the largest listed one; ids beyond and ids not listed have the last
        self.rank = np.full(int(self.ids.max(initial=-1)) + 2, len(self.ids), dtype=np.int32)
        self.rank[self.ids] = np.arange(len(self.ids))

    @classmethod
    def of(cls, flat: np.ndarray) -> Shares:
        """From the counts of ``flat``; each listed id, and the rest, has at least 1."""
        n = np.bincount(flat[flat < LISTED])
        ids = np.flatnonzero(n)
        if len(ids) > SHARED:
            ids = np.sort(ids[np.argsort(-n[ids], kind="stable")[:SHARED]])
        n = n[ids]
        room = (1 << SHARE_BITS) - len(ids) - 1
        shares = 1 + n * room // max(1, len(flat))
        return cls(ids, np.append(shares, (1 << SHARE_BITS) - shares.sum()))


class _Writer:
    """Range encoder of each lane."""

    def __init__(self, lanes: int, steps: int, shares: Shares):
        self.shares = shares
        self.low, self.width = np.zeros(lanes, np.int64), np.full(lanes, 1 << RANGE_BITS, dtype=np.int64)
        # an id takes three words at most: a hit or a miss with its share, and two halves
        self.start = np.arange(lanes) * (3 * steps + 3)
        self.at, self.words = self.start.copy(), np.zeros(lanes * (3 * steps + 3), "<u4")

    def code(self, p: np.ndarray, guess: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write ``ids`` of the first lanes; whether the guess holds, and the ids."""
        n = len(ids)
        low, width = self.low[:n], self.width[:n]
        hit = ids == guess
        bound = (width >> P_BITS) * p
        missed = np.flatnonzero(~hit)
        below = bound.take(missed)
        unit = width.take(missed) - below >> SHARE_BITS
        missing = ids.take(missed)
        s = self.shares.rank.take(missing, mode="clip").astype(np.int64)
        low[missed] += below + unit * self.shares.first.take(s)
        width[:] = bound
        width[missed] = unit * self.shares.shares.take(s)
        self._settle(low, width)
        odd = np.flatnonzero(s == len(self.shares.ids))
        if len(odd):
            who = missed[odd]
            for shift in (16, 0):
                unit = width[who] >> 16
                low[who] += unit * (missing[odd] >> shift & 0xFFFF)
                width[who] = unit
                self._settle(low, width)
        return hit, ids

    def _settle(self, low: np.ndarray, width: np.ndarray) -> None:
        """Add carries to the words before, and write a word where the range is too narrow."""
        over = np.flatnonzero(low >> RANGE_BITS)
        if len(over):
            low[over] &= (1 << RANGE_BITS) - 1
            at = self.at[over] - 1
            while len(at):
                self.words[at] += np.uint32(1)
                at = at[self.words[at] == 0] - 1
        short = np.flatnonzero(width < LEAST)
        if len(short):
            out, at = low.take(short), self.at.take(short)
            self.words[at] = out >> LEAST_BITS
            self.at[short] = at + 1
            low[short] = (out & LEAST - 1) << 32
            width[short] = width.take(short) << 32

    def finish(self) -> list[np.ndarray]:
        """The words of each lane, as 16-bit numbers."""
        for value in (self.low >> LEAST_BITS, (self.low & LEAST - 1) << 32 - LEAST_BITS):
            self.words[self.at] = value
            self.at += 1
        return [self.words[a:z].view("<u2") for a, z in zip(self.start.tolist(), self.at.tolist(), strict=True)]


class _Reader:
    """Range decoder of each lane over the words of all."""

    def __init__(self, words: list[np.ndarray], shares: Shares):
        self.shares = shares
        sizes = np.array([len(w) for w in words]) // 2
        raw = np.concatenate([*(w[: 2 * n] for w, n in zip(words, sizes.tolist(), strict=True)), np.zeros(6, "<u2")]).view("<u4").astype(np.int64)
        at = np.cumsum(sizes) - sizes
        self.low = raw[at] << LEAST_BITS | raw[at + 1] >> 32 - LEAST_BITS
        # a word stands across two: the range begins with RANGE_BITS, which are no whole words
        self.words = (raw[:-1] << LEAST_BITS | raw[1:] >> 32 - LEAST_BITS) & (1 << 32) - 1
        self.at = at + 1
        self.width = np.full(len(words), 1 << RANGE_BITS, dtype=np.int64)

    def code(self, p: np.ndarray, guess: np.ndarray, ids: None) -> tuple[np.ndarray, np.ndarray]:
        """As the writer's; the ids are read. Numbers stay within bounds in damaged blocks too."""
        n = len(p)
        low, width = self.low[:n], self.width[:n]
        bound = (width >> P_BITS) * p
        hit = low < bound
        missed = np.flatnonzero(~hit)
        below = bound.take(missed)
        unit = width.take(missed) - below >> SHARE_BITS
        inside = np.minimum(low.take(missed) - below, (unit << SHARE_BITS) - 1)
        s = self.shares.symbol.take(inside // unit)
        low[missed] = inside - unit * self.shares.first.take(s)
        width[:] = bound
        width[missed] = unit * self.shares.shares.take(s)
        self._settle(low, width)
        rest = len(self.shares.ids)
        found = self.shares.ids.take(s, mode="clip") if rest else np.zeros(len(s), np.int64)
        odd = np.flatnonzero(s == rest)
        if len(odd):
            who, value = missed[odd], 0
            for _ in range(2):
                unit = width[who] >> 16
                part = np.minimum(low[who] // unit, 0xFFFF)
                low[who] -= unit * part
                width[who] = unit
                self._settle(low, width)
                value = value << 16 | part
            found[odd] = value & (1 << 28) - 1
        ids = guess.astype(np.int64)
        ids[missed] = found
        return hit, ids

    def _settle(self, low: np.ndarray, width: np.ndarray) -> None:
        short = np.flatnonzero(width < LEAST)
        if len(short):
            at = self.at.take(short)
            low[short] = low.take(short) << 32 | self.words.take(at, mode="clip")
            self.at[short] = at + 1
            width[short] = width.take(short) << 32


class _Model:
    """What each lane has learnt; the same for writing and reading."""

    def __init__(self, lanes: int):
        self.squash, self.stretch, self.bucket = _tables()
        lane = np.arange(lanes)
        self.off1, self.off2, self.off0 = lane * SLOTS_1, lane * SLOTS_2, lane * SLOTS_0
        #: id and confidence (3 bits) that each context has; 0 for none
        self.t1, self.t2 = np.zeros(lanes * SLOTS_1, np.int32), np.zeros(lanes * SLOTS_2, np.int32)
        self.count = np.zeros(lanes * SLOTS_0, np.uint16)
        start = np.full(32, 1 << 15, dtype=np.int32)
        for c in range(8):
            sure = (c + 1 << 16) // (c + 3)
            start[c] = sure
            start[8 + 2 * c : 10 + 2 * c] = ((1 << 15) - (c << 11), sure)
        start[9] = 0  # neither order knows the context
        self.odds = np.tile(start, lanes)
        self.places = lane * 32 + np.array(PLACES)[:, None]
        self.weights = np.full((3, lanes), int(0.4 * (1 << ONE)), dtype=np.int32)
        self.last, self.last2, self.steps = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), 0

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        self.off1, self.off2, self.off0, self.last, self.last2 = (a[:n] for a in (self.off1, self.off2, self.off0, self.last, self.last2))
        self.places, self.weights = self.places[:, :n], self.weights[:, :n].copy()

    def step(self, code, ids: np.ndarray | None) -> np.ndarray:
        """Code one id of every lane: ``ids``, or what the reader ``code`` finds."""
        h1 = self.last * 40503
        i1 = self.off1 + (h1 >> 4 & SLOTS_1 - 1)
        i2 = self.off2 + (h1 + self.last2 * 30011 >> 3 & SLOTS_2 - 1)
        a1, a2 = self.t1.take(i1), self.t2.take(i2)
        c1, c2 = a1 & 7, a2 & 7
        guess = np.where(a2 > 0, a2, a1) >> 3
        ctx = self.places.copy()
        ctx[0] += c2
        ctx[1] += 2 * c1 + (a1 ^ a2 < 8)
        ctx[2] += self.bucket.take(self.count.take(self.off0 + (guess & SLOTS_0 - 1)))
        odds = self.odds.take(ctx)
        st = self.stretch.take(odds >> 16 - P_BITS)
        each = self.weights * st
        p = self.squash.take((each[0] + each[1] + each[2] >> ONE) + ODDS, mode="clip")
        hit, ids = code.code(p, guess, ids)
        # learn
        right = hit.astype(np.int32)
        self.weights += st * (((right << P_BITS) - p) * 7) >> 14
        self.steps += 1
        if self.steps % SPARE == 0:  # so often that no product overflows
            np.clip(self.weights, -WEIGHT, WEIGHT, out=self.weights)
        self.odds[ctx] = odds + (right * 65535 - odds >> 4)
        new = (ids << 3).astype(np.int32)
        for table, i, a, c in ((self.t1, i1, a1, c1), (self.t2, i2, a2, c2)):
            table[i] = new + 1 + (a ^ new < 8) * np.minimum(c, 6)
        i0 = self.off0 + (ids & SLOTS_0 - 1)
        self.count[i0] = self.count.take(i0) + np.uint16(1)
        self.last, self.last2 = ids, self.last
        return ids


def encode(ids: np.ndarray, shares: Shares, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sizes, checksums (crc32 of the ids as little-endian uint32) and 16-bit words of each block of ``ids``.

    Ids must be below 2 ** 28. LANES blocks are coded side by side; no ids give no blocks.
    """
    cuts = np.arange(0, len(ids), block)
    sizes = np.diff(np.append(cuts, len(ids))).astype("<u4")
    sums = np.array([zlib.crc32(ids[a : a + block].astype("<u4").tobytes()) for a in cuts], dtype="<u4")
    words: list[np.ndarray] = []
    for a in range(0, len(cuts), LANES):
        some = sizes[a : a + LANES].astype(int)
        n, top = len(some), int(some[0])
        grid = np.zeros((n, top), np.int64)
        flat = ids[cuts[a] : cuts[a] + some.sum()]
        grid.ravel()[: len(flat)] = flat
        grid = np.ascontiguousarray(grid.T)
        model, out = _Model(n), _Writer(n, top, shares)
        for t in range(top):
            if t == some[-1]:  # the last block may be shorter
                n -= 1
                model.shrink(n)
            model.step(out, grid[t, :n])
        words += out.finish()
    return sizes, sums, words


def decode(sizes: np.ndarray, sums: np.ndarray, words: list[np.ndarray], shares: Shares) -> list[np.ndarray]:
    """The ids of each block. Blocks may be any of a file's; a checksum that does not hold is an error."""
    out: list = [None] * len(sizes)
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        lengths = np.asarray(sizes, dtype=np.int64)[some]
        top, n = int(lengths[0]), len(some)
        grid = np.zeros((top, n), "<u4")
        model, code = _Model(n), _Reader([words[i] for i in some], shares)
        for t in range(top):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            if live < n:
                n = live
                model.shrink(n)
            grid[t, :n] = model.step(code, None)
        grid = np.ascontiguousarray(grid.T)
        for j, i in enumerate(some):
            out[i] = grid[j, : lengths[j]]
            if zlib.crc32(out[i].tobytes()) != int(sums[i]):
                raise ValueError(f"block {i} does not match its checksum")
    return out
