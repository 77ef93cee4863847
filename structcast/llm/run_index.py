"""Run-length index of a repetitive text, and the matches that it streams.

The Burrows-Wheeler transform of a repetitive text has few runs of equal letters. The index holds, for each run, the text
places of its first and last row. At the first row of a run, the longest match with the row above is found by comparing
the text; at any place that isn't such a sample, the match is one shorter than at the place before, as both rows moved on
by one letter together. The same holds for last rows and the row below. So the samples alone give the matching
statistics of the text against all its other suffixes in one pass.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Index of several pieces of bytes; matches never reach from one piece into another."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int((sizes + 1).sum())
        letters = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        ends = self.starts + sizes
        inside[ends] = False
        self.data = np.zeros(n + 8, np.uint8)
        self.data[np.flatnonzero(inside)] = np.frombuffer(b"".join(pieces), np.uint8)
        letters[inside] = self.data[:n][inside].astype(np.int64) + len(pieces)
        letters[ends] = np.arange(len(pieces))  # every end is a letter of its own
        self.left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes to the end of the piece
        rows = _suffix_order(letters, int(sizes.max(initial=0)) + 1)
        above = letters[rows - 1]  # the letter before each suffix
        first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        last = np.append(first[1:], n) - 1
        self.runs = len(first)
        self.head, self.tail = rows[first], rows[last]  # the sampled run ends
        self.head_match = self._common(self.head[1:], rows[first[1:] - 1])
        self.tail_match = self._common(self.tail[:-1], rows[last[:-1] + 1])
        self.head_match = np.append(0, self.head_match)
        self.tail_match = np.append(self.tail_match, 0)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b, eight bytes a step."""
        eight = np.ndarray(len(self.data) - 7, "<u8", buffer=self.data, strides=(1,))
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            differ = eight[a[open_] + out[open_]] ^ eight[b[open_] + out[open_]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) >> 3)
            out[open_] += same
            open_ = open_[(same == 8) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def matches(self) -> np.ndarray:
        """For each place the length of the longest match that begins there and also begins at another place."""
        n = len(self.left)
        best = np.zeros(n, np.int64)
        for place, match in ((self.head, self.head_match), (self.tail, self.tail_match)):
            reach = np.full(n, -1, np.int64)
            reach[place] = place + match
            sample = np.zeros(n, np.int64)
            sample[place] = place
            at = np.maximum.accumulate(sample)
            np.maximum(best, reach[at] - np.arange(n), out=best)
        return best

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, first and end byte of each maximal run of places where a repeated string of the length begins, with its bytes."""
        long = np.flatnonzero(self.matches() >= length)
        if not len(long):
            return (np.zeros(0, np.int64),) * 3
        edge = np.flatnonzero(np.concatenate([[True], np.diff(long) > 1]))
        a, b = long[edge], long[np.append(edge[1:], len(long)) - 1] + length
        piece = np.searchsorted(self.starts, a, "right") - 1
        return piece, a - self.starts[piece], b - self.starts[piece]


def _suffix_order(letters: np.ndarray, longest: int) -> np.ndarray:
    """All suffixes in order, by doubling the length that ranks compare; no suffix equals another beyond `longest` letters."""
    n = len(letters)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(letters.max() + 1).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([letters + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        rank = np.zeros(n + 1, np.int64)
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]]))
        if h >= longest or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - h, 0)] = rank[h:n]
        key = rank[:n] * (n + 1) + after
        h *= 2
