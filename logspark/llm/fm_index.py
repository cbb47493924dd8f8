"""A compressed full-text index over sequences of words (FM-index).

The sequences are laid out one after the other, sorted by their first
``depth`` words behind every place, and only the Burrows-Wheeler transform
is kept, as a wavelet matrix: one bit vector for each bit of the word
numbers, with counts for every 64 bits.  Backward search extends an interval
of places by one word to the left; ``parent`` drops the last word.  All
steps work on arrays of intervals at once.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_LOW6 = np.uint64(63)


class WaveletMatrix:
    """Rank of any symbol before any place, for symbols from 0."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.bits = max(1, int(count - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(symbols)
        for bit in range(self.bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(n - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = self._walk(np.arange(count, dtype=np.int64), np.zeros(count, np.int64))

    def _walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            block = places >> 6
            mask = (_ONE << (places.astype(np.uint64) & _LOW6)) - _ONE
            ones = self.before[level][block] + np.bitwise_count(self.words[level][block] & mask)
            bit = symbols >> (self.bits - 1 - level) & 1
            places = np.where(bit, ones + self.zeros[level], places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._walk(symbols, places) - self.first[symbols]


class FMIndex:
    """Index of word sequences in a given order.

    ``words``: all words one after the other (any 64-bit values);
    ``lengths``: the length of each sequence; ``depth``: the longest pattern.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int):
        self.depth = depth
        self.alphabet, numbers = np.unique(words, return_inverse=True)
        n = len(words) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1                  # places of the separators, number 0
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = numbers + 1
        self.starts = ends - lengths
        order, same, shorter = self._sorted(text, depth)
        groups = np.flatnonzero(~same)                     # rows that begin another first depth words
        self.group = np.cumsum(~same) - 1
        self.earliest = np.minimum.reduceat(order, groups) if n else order
        begins = ~shorter                                  # ... and another first depth - 1 words
        bounds = np.append(np.flatnonzero(begins), n)
        nr = np.cumsum(begins) - 1
        self.parent_lo, self.parent_hi = bounds[nr], bounds[nr + 1]
        self.bwt = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.before = np.cumsum(counts) - counts
        self.n = n

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places sorted by their next ``depth`` words (then by place); for
        each row whether it has the same depth, and depth - 1, first words
        as the row before."""
        n = len(text)

        def behind(ranks: np.ndarray, step: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[:n - step] = ranks[step:] if step < n else out[:0]
            return out

        def ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key = first * (int(second.max()) + 1) + second
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = np.zeros(n, bool)
            same[1:] = key[1:] == key[:-1]
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(~same)
            return ranks, order, same

        ranks, known, before, step = text + 1, 1, text + 1, 1
        order = same = None
        while known < depth:
            before, width = ranks, known
            step = min(known, depth - known)
            ranks, order, same = ranked(ranks, behind(ranks, step))
            known += step
        # ``before`` ranks the first ``width`` words: two looks cover depth - 1
        shift = depth - 1 - width
        tail = behind(before, shift) if shift > 0 else before
        shorter = np.zeros(n, bool)
        shorter[1:] = (before[order][1:] == before[order][:-1]) & (tail[order][1:] == tail[order][:-1])
        return order, same, shorter

    def extend(self, lo: np.ndarray, hi: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with one more word on the left (numbers as in ``number``)."""
        both = self.bwt.rank(np.concatenate([numbers, numbers]), np.concatenate([lo, hi]))
        both += np.concatenate([self.before[numbers]] * 2)
        return both[:len(lo)], both[len(lo):]

    def parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of depth-word patterns without their last word."""
        return self.parent_lo[lo], self.parent_hi[lo]

    def number(self, words: np.ndarray) -> np.ndarray:
        """The index's numbers of words; 0 for unknown ones."""
        at = np.minimum(np.searchsorted(self.alphabet, words), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == words, at + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)

    def stream(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences, cut at ``depth``.

        Goes through all sequences at once, from their ends.  A word that
        does not extend the match ends it: it begins anew with that word.
        Returns for every place of ``words`` the length of the match that
        begins there, and the earliest place of the indexed layout where a
        match of full length stands (else -1).
        """
        ends = np.cumsum(lengths)
        numbers = self.number(words)
        length = np.zeros(len(words), np.int64)
        found = np.full(len(words), -1, np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        ends, sizes = ends[by_length], lengths[by_length]
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        size = np.zeros(len(ends), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -back, "right"))
            at = ends[:live] - back
            word, l, h, s = numbers[at], lo[:live], hi[:live], size[:live]  # noqa: E741
            full = s == self.depth
            if full.any():
                up, down = self.parent(np.where(full, l, 0))
                l, h, s = np.where(full, up, l), np.where(full, down, h), np.where(full, self.depth - 1, s)  # noqa: E741
            l, h = self.extend(l, h, word)  # noqa: E741
            lost = (l >= h) | (word == 0)
            if lost.any():
                one_lo, one_hi = self.before[word], self.before[word] + np.where(
                    word > 0, self.extend(np.zeros(live, np.int64), np.full(live, self.n, np.int64), word)[1]
                    - self.before[word], 0)
                l, h = np.where(lost, one_lo, l), np.where(lost, one_hi, h)  # noqa: E741
                s = np.where(lost, 0, s)
                l, h = np.where(word == 0, 0, l), np.where(word == 0, self.n, h)  # noqa: E741
            s = np.where(word == 0, 0, s + 1)
            lo[:live], hi[:live], size[:live] = l, h, s
            length[at] = s
            whole = s == self.depth
            found[at[whole]] = self.earliest[self.group[l[whole]]]
        return length, found
