"""A compressed FM-index over sequences of integers, held by one shard.

The suffixes are sorted to DEPTH symbols, or a given number, by prefix doubling. Patterns no longer than that have whole,
contiguous intervals, whatever the order of suffixes that agree so far, and backward search finds them.
The Burrows-Wheeler transform is stored as a wavelet matrix: one bit vector a level, packed into 64-bit
words with a running count for each word, so a symbol's rank costs one look-up a level.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = n - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first at bits are set."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Over sequences of symbols 1 .. sigma, given as one array with offsets."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, depth: int = DEPTH):
        lengths = np.diff(offsets)
        self.text = np.zeros(len(symbols) + len(lengths), np.int64)
        at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        self.text[at] = symbols
        n = len(self.text)
        rank, step = self.text.copy(), 1
        while step < depth and n:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
            step *= 2
            if len(rank) and rank.max() == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        last = self.text[order - 1]
        sigma = int(self.text.max(initial=0)) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))]).astype(np.int64)
        self.levels: list[BitVector] = []
        for level in range(max(1, sigma.bit_length()) - 1, -1, -1):
            bits = (last >> level & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            last = np.concatenate([last[bits == 0], last[bits == 1]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol among the first low and the first high symbols of the transform."""
        start = np.zeros_like(low)
        for k, bits in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - k) & 1).astype(bool)
            out = []
            for at in (start, low, high):
                ones = bits.ones(at)
                out.append(np.where(one, bits.zeros + ones, at - ones))
            start, low, high = out
        return low - start, high - start

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + P from that of P."""
        a, b = self.ranks(symbol, low, high)
        return self.starts[symbol] + a, self.starts[symbol] + b

    def matching_statistics(self, symbols: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """For each position in ends (exclusive) of a streamed array, the length, up to most, of the longest
        sequence that ends there and occurs at least least times in the index. The caller sees to it that
        most symbols before each end belong to one document."""
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        for k in range(most):
            low, high = self.extend(symbols[ends[active] - 1 - k], low, high)
            alive = high - low >= least
            active, low, high = active[alive], low[alive], high[alive]
            length[active] = k + 1
            if not len(active):
                break
        return length
