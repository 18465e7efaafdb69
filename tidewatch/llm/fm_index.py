"""A full-text index of symbol sequences: suffixes sorted, ranks by a wavelet matrix.

Symbol 0 separates sequences and takes part in no search. All operations work on
arrays: many patterns are searched, and many rows located, at once.
"""

import numpy as np

SAMPLE = 16


class Bits:
    """A bit vector with ranks: a running count for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Symbols by their bits, highest first; at each level those with a 0 go before those with a 1."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.depth = max(1, int(kinds - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            self.levels.append((Bits(ones), int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        first = np.arange(kinds)
        self.first = self._down(first, np.zeros(kinds, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, i) - self.first[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.first[symbol]


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Where the suffixes begin, in order; separators are all different, by place.

    Ranks of twice as many symbols come from pairs of ranks, until all differ:
    as many rounds as the longest repeated stretch has bits.
    """
    n = len(symbols)
    separators = symbols == 0
    keys = np.where(separators, np.cumsum(separators) - 1, symbols.astype(np.int64) + separators.sum())
    width = 1
    while True:
        order = np.argsort(keys, kind="stable")
        ahead = keys[order]
        new = np.concatenate([[True], ahead[1:] != ahead[:-1]])
        if new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        later = np.zeros(n, np.int64)
        later[:-width] = rank[width:] + 1
        keys = rank * (n + 1) + later
        width *= 2


class FmIndex:
    """Built over symbols 0 to kinds - 1 that end in a separator. The symbols themselves are not kept."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        suffixes = sorted_suffixes(symbols)
        last = symbols[suffixes - 1].astype(np.int64)
        self.wavelet = Wavelet(last, kinds)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])
        sampled = (suffixes % SAMPLE == 0) | (last == 0)
        self.sampled, self.places, self.size = Bits(sampled), suffixes[sampled], len(symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows, of one length) that occur: their numbers and their rows' first and end."""
        found = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[found, k]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
            alive = low < high
            found, low, high = found[alive], low[alive], high[alive]
        return found, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows begin: steps back to the next sampled one."""
        places = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            there = self.sampled.get(rows)
            places[left[there]] = self.places[self.sampled.rank(rows[there])] + steps
            left, rows = left[~there], rows[~there]
            symbol, before = self.wavelet.access(rows)
            rows = self.before[symbol] + before
            steps += 1
        return places
