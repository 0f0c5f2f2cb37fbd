"""Compressed FM-index over integer sequences: suffix order, Burrows-Wheeler transform in a wavelet matrix, batched backward search."""

from __future__ import annotations

import numpy as np


#: Words of 64 bits in a block of a plane; bits of a block as a shift; the bits of a block before each position.
BLOCK, SHIFT = 4, np.int64(8)
_BEFORE = np.zeros((64 * BLOCK, BLOCK), np.uint64)
for _i in range(64 * BLOCK):
    for _k in range(BLOCK):
        _BEFORE[_i, _k] = (1 << min(64, max(0, _i - 64 * _k))) - 1


class Plane:
    """Bits in blocks, of which those of one kind of bit, as runs of a Burrows-Wheeler transform make them, are not stored: a block has a rank and the number of its words (0: no bit is set, 1: all are)."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        words = np.zeros((len(bit) // (64 * BLOCK) + 1) * BLOCK, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        blocks = words.reshape(-1, BLOCK)
        set_ = np.bitwise_count(blocks).sum(1, dtype=np.int64)
        mixed = (set_ > 0) & (set_ < 64 * BLOCK)
        self.rank = np.zeros(len(blocks), np.int32)
        np.cumsum(set_[:-1], out=self.rank[1:])
        self.number = np.where(set_ == 64 * BLOCK, 1, 0).astype(np.int32)
        self.number[mixed] = np.arange(2, 2 + int(mixed.sum()))
        self.words = np.concatenate([np.zeros((1, BLOCK), np.uint64), np.full((1, BLOCK), ~np.uint64(0)), blocks[mixed]]).T.copy()

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        block = at >> SHIFT
        number, inside, out = self.number[block], at & np.int64(64 * BLOCK - 1), self.rank[block].astype(np.int64)
        for k in range(BLOCK):
            out += np.bitwise_count(self.words[k][number] & _BEFORE[:, k][inside])
        return out

    @property
    def nbytes(self) -> int:
        return self.rank.nbytes + self.number.nbytes + self.words.nbytes


class WaveletMatrix:
    """Compressed bit planes of a sequence: log(sigma) bits a symbol at most, and eight bytes a block."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.levels):
            bit = (values >> (self.levels - 1 - level)) & 1 == 1
            self.planes.append(Plane(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.base = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length `at` of the sequence ends among the symbol's run in the last plane."""
        for level in range(self.levels):
            ones = self.planes[level].ones(at)
            at = np.where((symbols >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.descend(symbols, at) - self.base[symbols]


def suffix_order(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` symbols at least, by prefix doubling."""
    n, rank, span = len(sequence), sequence.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        key = rank * np.int64(int(rank.max()) + 2)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        rank, span = fresh, span * 2
        if int(rank[order[-1]]) == n - 1:
            break
    return order


class FMIndex:
    """Index of texts (symbols from 1), each ended by 0. Every text has a weight; an interval's count is the sum of the weights of its suffixes. Patterns may be up to `depth` long."""

    def __init__(self, sequence: np.ndarray, sigma: int, weights: np.ndarray, depth: int):
        order = suffix_order(sequence, depth)
        self.wavelet = WaveletMatrix(sequence[order - 1], sigma)
        self.first = np.searchsorted(sequence[order], np.arange(sigma + 1))
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        n = len(symbols)
        return self.first[symbols] + both[:n], self.first[symbols] + both[n:]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_spans(index: FMIndex, sequence: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each text, given by its first symbol and its number of windows, the first and last window whose count is `least` or more; -1 where none is.

    Matching statistics come from backward search and are cut off at `width`: a search that ends early after j symbols says
    that no window over those j symbols repeats, so the search from the left goes on behind them. All texts advance together.
    """
    n = len(begin)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for forward in (True, False):
        live = np.arange(n) if forward else np.flatnonzero(first >= 0)
        start = np.zeros(len(live), np.int64) if forward else windows[live] - 1
        at = start + width - 1
        symbol = sequence[begin[live] + at]
        low, high = index.first[symbol], index.first[symbol + 1]
        while len(live):
            failed = index.count(low, high) < least
            found = ~failed & (at == start)
            (first if forward else last)[live[found]] = start[found]
            start = np.where(failed, at + 1 if forward else start - 1, start)
            going = ~found & (start < windows[live] if forward else start >= first[live])
            live, start, at, low, high, failed = live[going], start[going], at[going], low[going], high[going], failed[going]
            at = np.where(failed, start + width - 1, at - 1)
            symbol = sequence[begin[live] + at]
            low, high = index.extend(symbol, np.where(failed, 0, low), np.where(failed, index.first[-1], high))
    return first, last
