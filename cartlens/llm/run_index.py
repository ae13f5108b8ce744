"""A run-length index of a small text: run-compressed Burrows-Wheeler transform
with samples at the run ends, and the matching statistics streamed from them."""

from __future__ import annotations

import numpy as np


class Suffixes:
    """The suffixes of a byte array in order, by prefix doubling.

    First by as many symbols as fit 63 bits (the end sorts below any symbol),
    then again and again by twice as many, but only those suffixes that still
    share a rank. A rank is the first place of its group; the ranks of every
    round are kept, for they tell how far two suffixes agree.
    """

    def __init__(self, text: np.ndarray):
        n = self.size = len(text)
        symbols = np.flatnonzero(np.bincount(text, minlength=256))
        self.bits = int(len(symbols)).bit_length()
        code = np.zeros(256, np.int64)
        code[symbols] = np.arange(1, len(symbols) + 1)
        self.reach = reach = 63 // self.bits
        padded = np.concatenate((code[text], np.zeros(reach, np.int64)))
        key = np.zeros(n, np.int64)
        for i in range(reach):
            key = key << self.bits | padded[i:i + n]
        self.start = np.append(key, 0)  # the first symbols of each suffix
        self.rounds: list[tuple[int, np.ndarray]] = []
        place = np.arange(n)  # suffixes that share a rank, and the ranks of all
        rank = np.zeros(n, np.int64)
        while True:
            order = np.argsort(key)
            place, key = place[order], key[order]
            old = rank[place]
            slots = np.arange(len(place))
            group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, slots, 0))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])))
            first = np.maximum.accumulate(np.where(new, slots, 0))
            rank[place] = old + first - group
            shared = ~(new & np.append(new[1:], True))
            place = place[shared]
            if not len(place):
                break
            self.rounds.append((reach, np.append(rank, -1)))
            behind = place + reach
            after = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
            key = rank[place] * (n + 1) + after
            reach *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of different suffixes."""
        out, end = np.zeros(len(a), np.int64), self.size
        for reach, rank in reversed(self.rounds):
            same = rank[np.minimum(a + out, end)] == rank[np.minimum(b + out, end)]
            out += np.where(same, reach, 0)
        x = self.start[np.minimum(a + out, end)] ^ self.start[np.minimum(b + out, end)]
        high = x >> 32  # a float holds either half exactly
        length = np.where(high > 0, 32 + np.frexp(high.astype(float))[1],
                          np.frexp((x & 0xFFFFFFFF).astype(float))[1])
        out += (self.bits * self.reach - length) // self.bits
        return np.minimum(out, end - np.maximum(a, b))


class RunLengthIndex:
    """``symbols`` and ``lengths``: the runs of the transform. ``heads`` and
    ``tails``: text positions of the first and last suffix of each run, with the
    common prefix they share with the suffix before or after."""

    def __init__(self, text: np.ndarray):
        sorted_ = Suffixes(text)
        order = sorted_.order
        last = np.where(order == 0, -1, text[order - 1].astype(np.int16))  # -1: nothing before it
        change = np.flatnonzero(last[1:] != last[:-1]) + 1
        first = np.concatenate(([0], change))
        end = np.concatenate((change - 1, [len(text) - 1]))
        self.size, self.symbols, self.lengths = len(text), last[first], end - first + 1
        self.heads, self.head_match = self._sample(sorted_, first, -1)
        self.tails, self.tail_match = self._sample(sorted_, end, 1)

    @staticmethod
    def _sample(sorted_: Suffixes, at: np.ndarray, side: int):
        """The suffixes at places ``at``, in text order, and their match with the
        suffix on that side."""
        order, other = sorted_.order, at + side
        inside = (other >= 0) & (other < len(order))
        match = np.zeros(len(at), np.int64)
        match[inside] = sorted_.common_prefix(order[at[inside]], order[other[inside]])
        by = np.argsort(order[at])
        return order[at][by], match[by]

    def transform(self) -> np.ndarray:
        return np.repeat(self.symbols, self.lengths)

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match with any other position.

        Inside a run neighbours stay neighbours one position earlier in the
        text, so going on in the text a match only gets shorter by one, until
        the next sampled position gives a new one.
        """
        best = np.zeros(self.size, np.int64)
        place = np.arange(self.size)
        for position, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            last = np.searchsorted(position, place, "right") - 1
            best = np.maximum(best, match[last] - (place - position[last]))
        return best
