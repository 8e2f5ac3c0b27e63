"""A compressed full-text index over sequences of words: wavelet matrix, backward search, matching statistics.

Everything works on numpy arrays: a search takes many patterns one step to the left at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class BitRank:
    """A bit vector, packed, with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view("<u8")
        before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], before[:-1]]).astype(np.int32 if n < 2**31 else np.int64)
        self.ones = int(before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        at = i >> 6
        low = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at] + np.bitwise_count(low)


class WaveletMatrix:
    """rank of symbols over a sequence of n symbols, in n * bits bits and a quarter more for counts."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.levels.append(BitRank(bit.astype(np.uint8)))
            self.zeros.append(len(now) - self.levels[-1].ones)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # Where a symbol begins after the last level.
        places = np.arange(n_symbols)
        self.begin = self._down(places, np.zeros(n_symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(i)
            i = np.where((c >> (self.bits - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c before each place i."""
        return self._down(c, i) - self.begin[c]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; symbols must end in a unique one."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    step = 0
    key = symbols.astype(np.int64)
    while True:
        sorted_key = key[order]
        new = np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if int(new.sum()) == n - 1:
            return order
        step = step * 2 or 1
        key = rank * n + np.concatenate([rank[step:], rank[:step]])
        order = np.argsort(key)


class FMIndex:
    """An index over texts given as one array of words (ids from 1) and the words' number in each text.

    weights: how often each text counts. Texts are closed by separators, so no match crosses from one into another.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        p, n = len(lengths), len(words) + len(lengths)
        text = np.repeat(np.arange(p), lengths)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        self.stop = self.start + lengths
        sym = np.zeros(n, np.int64)
        sym[np.arange(len(words)) + text] = words
        self.sym, self.n_symbols = sym, int(words.max(initial=0)) + 1
        # For the order each separator is a symbol of its own, smaller than all words.
        apart = sym + p
        apart[self.stop] = np.arange(p)
        order = suffix_array(apart)
        self.matrix = WaveletMatrix(sym[order - 1], self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=self.n_symbols))])[:-1]
        of = np.repeat(np.arange(p), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[of[order]])])

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of patterns c + X, of the ranges of patterns X."""
        m = len(c)
        both = self.first[np.concatenate([c, c])] + self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return both[:m], both[m:]

    def matching_statistics(self, least: int, times: int = 2) -> np.ndarray:
        """For each place of the index's own texts the length, if it is ``least`` or more, of the longest match that begins there
        and occurs ``times`` times by weight; shorter ones may be given shorter, or as 0.

        Backward search from the end of each text. Where a match can't be made longer to the left, its last word goes, until
        less than ``least`` words of the text are left. The words that all stretches of ``least`` words of a text have in common
        are asked first: if they are not there ``times`` times, no such stretch is.
        """
        found = np.zeros(len(self.sym), np.int64)
        live = np.flatnonzero(self.stop - self.start >= least)
        live = live[self._hold(np.maximum(self.stop[live] - least, self.start[live]), self.start[live] + least, times)]
        start, end = self.start[live], self.stop[live]
        at, lo, hi = end - 1, np.zeros(len(live), np.int64), np.full(len(live), len(self.sym))
        # After a text's first failure at a place, the shortest stretch that still counts is asked from its end to that place: if that
        # fails too, so does all that is left. asks: 0 not yet, 1 being asked, 2 done.
        asks, place, kept = np.zeros(len(live), np.int8), at, end
        while len(at):
            a, b = self.extend(self.sym[at], lo, hi)
            fits = self.weight[b] - self.weight[a] >= times
            own = fits & (asks != 1)
            found[at[own]] = np.maximum(found[at[own]], end[own] - at[own])
            shorter, answered = ~fits & (asks != 1), fits & (asks == 1) & (at <= place)
            shortest = start + least
            ask = shorter & (asks == 0) & (at < shortest) & (end > shortest)
            place, kept = np.where(ask, at, place), np.where(ask, end - 1, kept)
            on = (fits | shorter) & np.where(shorter, end > shortest, answered | (at > start))
            end = np.where(ask, shortest, np.where(shorter, end - 1, np.where(answered, kept, end)))
            asks = np.where(ask, 1, np.where(answered | (shorter & (at < shortest)), 2, asks)).astype(np.int8)
            again = shorter | answered
            at = np.where(again, end - 1, at - 1)
            lo, hi = np.where(again, 0, a), np.where(again, len(self.sym), b)
            start, end, at, lo, hi, asks, place, kept = (v[on] for v in (start, end, at, lo, hi, asks, place, kept))
        return found

    def _hold(self, first: np.ndarray, end: np.ndarray, times: int) -> np.ndarray:
        """Whether the words from each first to before its end occur ``times`` times by weight; true of no words."""
        held = np.ones(len(first), bool)
        who = np.flatnonzero(end > first)
        at, lo, hi = end[who] - 1, np.zeros(len(who), np.int64), np.full(len(who), len(self.sym))
        while len(who):
            lo, hi = self.extend(self.sym[at], lo, hi)
            fits = self.weight[hi] - self.weight[lo] >= times
            held[who[~fits]] = False
            on = fits & (at > first[who])
            who, at, lo, hi = who[on], at[on] - 1, lo[on], hi[on]
        return held


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids from 1 of all words of texts whose words stand one space apart, and the words' number in each text."""
    data = b" ".join(texts) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    return ids, np.array([t.count(b" ") + 1 for t in texts], np.int64)
