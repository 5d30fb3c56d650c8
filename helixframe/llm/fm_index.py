"""A compressed full-text index of many short sequences of symbols, for use inside one task.

What stays after the build: the Burrows-Wheeler transform in a wavelet matrix, how many smaller symbols there are of each, two bit
vectors over the suffixes in order and a number for each distinct window.  Text, suffix array and ranks are let go of.
"""

from __future__ import annotations

import numpy as np

#: Words of 64 bits to a block of the directory.
BLOCK = 16


class BitVector:
    """Bits with rank and select, and a directory of a fifth of their size on top."""

    def __init__(self, bits: np.ndarray):
        self.length = len(bits)
        count = -(-(len(bits) // 64 + 1) // BLOCK) * BLOCK
        self.words = np.zeros(count, np.uint64)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK)
        inside = np.cumsum(ones, axis=1) - ones
        self.inside = inside.astype(np.uint16).ravel()
        blocks = ones.sum(axis=1)
        self.before = (np.cumsum(blocks) - blocks).astype(np.uint32)
        self.ones = int(blocks.sum())

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.inside.nbytes + self.before.nbytes

    def rank(self, end: np.ndarray) -> np.ndarray:
        """How many bits before each end are set."""
        word = end >> 6
        rest = self.words[word] & ((np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word // BLOCK].astype(np.int64) + self.inside[word] + np.bitwise_count(rest)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of set bit k, from 0; the length where there are not so many."""
        missing = k >= self.ones
        k = np.where(missing, 0, k)
        block = np.searchsorted(self.before, k, side="right") - 1
        rest = k - self.before[block]
        word = block * BLOCK
        step = BLOCK // 2
        while step:
            word = np.where(self.inside[word + step] <= rest, word + step, word)
            step //= 2
        rest = rest - self.inside[word]
        bits, place = self.words[word], np.zeros(len(word), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = bits & ((np.uint64(1) << np.uint64(width)) - np.uint64(1))
            ones = np.bitwise_count(low).astype(np.int64)
            above = rest >= ones
            rest = rest - ones * above
            bits = np.where(above, bits >> np.uint64(width), low)
            place += width * above
        return np.where(missing, self.length, word * 64 + place)


class WaveletMatrix:
    """Rank of a symbol in a sequence, in a bit vector for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            vector = BitVector(bit)
            self.levels.append((vector, len(sequence) - vector.ones))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.base = np.zeros(symbols, np.int32)
        self.base = self.rank(np.arange(symbols), np.zeros(symbols, np.int64)).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v, _ in self.levels) + self.base.nbytes

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        at = end
        for k, (vector, zeros) in enumerate(self.levels):
            ones = vector.rank(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at - self.base[symbol]


class FmIndex:
    """sequences: symbols 1, 2, ... one after another; first: where each begins; owner: a number for each sequence.

    Every sequence is followed by a separator of its own, so no match runs over its end.  The index answers for
    windows of `size` symbols: which of its suffixes begin with one, and the least owner among them.
    """

    def __init__(self, sequences: np.ndarray, first: np.ndarray, owner: np.ndarray, size: int):
        self.size, count = size, len(first)
        length = np.diff(np.append(first, len(sequences)))
        text = np.zeros(len(sequences) + count, np.int64)
        text[np.arange(len(sequences)) + np.repeat(np.arange(count), length)] = sequences
        self.length = len(text)
        symbols = int(sequences.max(initial=0)) + 1
        sa, ranks = _suffixes(text, count, symbols, size)
        self.wavelet = WaveletMatrix(text[sa - 1], symbols)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int32)
        #: Suffixes that share size - 1 symbols stand together; where such a group begins.
        self.shorter = BitVector(_heads(sa, ranks, size - 1))
        ends = np.repeat(first + np.arange(count) + length, length + 1)[sa]
        heads = _heads(sa, ranks, size)
        whole = ends - sa >= size  # suffixes that begin with a window
        owners = np.where(whole, np.repeat(owner, length + 1)[sa], np.iinfo(np.int64).max)
        groups = np.flatnonzero(heads)
        least = np.minimum.reduceat(owners, groups) if len(groups) else owners
        self.windows = BitVector(heads & whole)
        least = least[whole[groups]]
        #: The least owner of each distinct window, in order.
        self.least = least.astype(np.uint16 if least.max(initial=0) < 1 << 16 else np.uint32)

    @property
    def nbytes(self) -> int:
        return self.wavelet.nbytes + self.starts.nbytes + self.shorter.nbytes + self.windows.nbytes + self.least.nbytes

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with a symbol and then with what the given intervals begin with."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.starts[symbol] + both[: len(symbol)], self.starts[symbol] + both[len(symbol) :]

    def matches(self, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Streams sequences (symbols, 0 for those that the index lacks) through the index, each right to left and all in step;
        for each place the least owner of the window that begins there, or -1 if the index has none.

        A match grows by a symbol at a time up to the window's size; then it gives up its last symbol for the next one.
        Where it can't grow, it begins again with one symbol less on the right.
        """
        out = np.full(len(text), -1, np.int64)
        begin, at, end = first, first + length, first + length  # at .. end is matched
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.length)
        while True:
            live = (end - begin >= self.size) & (at > begin)
            if not live.all():
                begin, at, end, low, high = (x[live] for x in (begin, at, end, low, high))
            if not len(at):
                return out
            symbol = text[at - 1]
            new_low, new_high = self.extend(symbol, low, high)
            grown = (symbol > 0) & (new_low < new_high)
            low, high = np.where(grown, new_low, 0), np.where(grown, new_high, self.length)
            at = at - grown
            lost = np.flatnonzero(~grown)
            end[lost] = np.where(symbol[lost] > 0, end[lost] - 1, at[lost] - 1)
            at[lost] = end[lost]
            full = np.flatnonzero(end - at == self.size)
            if len(full):
                out[at[full]] = self.least[self.windows.rank(low[full])]
                group = self.shorter.rank(low[full] + 1) - 1
                low[full], high[full] = self.shorter.select(group), self.shorter.select(group + 1)
                end[full] -= 1


def _suffixes(text: np.ndarray, separators: int, symbols: int, size: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The suffixes in order, by prefix doubling, and their ranks by their first 1, 2, 4, ... symbols. Separators (0) are told apart by place."""
    n = len(text)
    rank = np.where(text > 0, text + separators - 1, 0)
    rank[text == 0] = np.arange(separators)
    ranks, reach = {1: rank}, 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (n + symbols + 1) + after
        sa = np.argsort(key, kind="stable")
        step = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(np.append(False, step[1:] != step[:-1]))
        reach *= 2
        if reach <= size:
            ranks[reach] = rank
        if n == 0 or rank[sa[-1]] == n - 1:
            return sa, ranks


def _heads(sa: np.ndarray, ranks: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Which suffixes differ from the one before in their first `size` symbols."""
    new = np.zeros(len(sa), bool)
    new[:1] = True
    at = sa
    for power in sorted(ranks, reverse=True):
        if size >= power:
            value = np.where(at < len(sa), ranks[power][np.minimum(at, len(sa) - 1)], -1 - at)
            new[1:] |= value[1:] != value[:-1]
            at, size = at + power, size - power
    return new if not size else np.ones(len(sa), bool)  # everything was told apart sooner
