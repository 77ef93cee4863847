"""Token ids of pieces of text, kept by piece, so that a piece is encoded once by each worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._text import first_bytes, ragged


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceTable:
    """Ids of the pieces seen so far; encode(pieces) gives the pieces in any order, all their ids, and how many each has.

    It holds about `most` pieces: when it is full, the half that was used most stays.
    """

    def __init__(self, encode: Callable[[list], tuple[list, list, list]], most: int = 240_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        uses = self.uses[: len(self.index)]
        least = max(2, int(np.partition(uses, len(uses) // 2)[len(uses) // 2]) + 1)
        keep = np.flatnonzero(uses >= least)
        flat, lengths = self.flat[ragged(self.starts[keep], self.lengths[keep])], self.lengths[keep]
        pieces = list(self.index)
        pieces = [pieces[k] for k in keep]
        self.clear()
        if pieces:
            self._put(pieces, flat, lengths)

    def add(self, pieces: set) -> None:
        """Encodes those pieces that are new."""
        new = pieces.difference(self.index)
        if len(self.index) + len(new) > self.most and self.index:
            self._shrink()
            new = pieces.difference(self.index)
        if new:
            self._put(*self.encode(list(new)))

    def _put(self, new: list, flat: list, lengths: list) -> None:
        lengths = np.asarray(lengths, np.int64)
        first, more = len(self.index), len(flat)
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        while first + len(new) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        self.flat[self.used : self.used + more] = flat
        self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(new)] = lengths
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        self.used += more

    def ids(self, pieces: list) -> np.ndarray:
        """The ids of the pieces, one after the other; every piece must have been added."""
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self.uses[at] += 1
        return self.flat[ragged(self.starts[at], self.lengths[at])]


class SpanTable:
    """Ids of spans of bytes by their 64-bit hash, checked by length and first eight bytes; a span whose hash another has is encoded each time.

    It holds about `most` spans: when it is full, those used more than once since the last time stay. encode(pieces) is
    as for PieceTable.
    """

    def __init__(self, encode: Callable[[list], tuple[list, list, list]], most: int = 700_000):
        self.encode, self.most = encode, most
        self.keys = np.zeros(0, np.uint64)  # ascending, with the place of each
        self.at = np.zeros(0, np.int64)
        self.checks, self.starts, self.lengths, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each span; new ones are encoded. hashes: ascending, each once."""
        checks = first_bytes(data, starts, ends)
        if len(self.keys) + len(hashes) > self.most and len(self.keys):
            self._shrink()
        k = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        out = self.at[k].copy() if len(self.keys) else np.zeros(len(hashes), np.int64)
        known = self.keys[k] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        other = known.copy()
        other[known] = self.checks[out[known]] != checks[known]  # another span has this hash
        new = np.flatnonzero(~known | other)
        if len(new):
            pieces = [data[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            done, flat, lengths = self.encode(pieces)
            order = {p: i for i, p in enumerate(done)}
            source = np.fromiter(map(order.__getitem__, pieces), np.int64, len(pieces))
            own = np.asarray(lengths, np.int64)
            begin = (np.cumsum(own) - own)[source] + self.used
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            out[new] = len(self.starts) + np.arange(len(new))
            self.starts, self.lengths = np.concatenate([self.starts, begin]), np.concatenate([self.lengths, own[source]])
            self.checks, self.uses = np.concatenate([self.checks, checks[new]]), np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            fresh = new[~other[new]]
            place = np.searchsorted(self.keys, hashes[fresh])
            self.keys, self.at = np.insert(self.keys, place, hashes[fresh]), np.insert(self.at, place, out[fresh])
        self.uses[out] += 1
        return out

    def gather(self, places: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[places], self.lengths[places])]

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        flat = self.gather(keep)
        moved = np.full(len(self.starts), -1)
        moved[keep] = np.arange(len(keep))
        stay = moved[self.at] >= 0
        self.keys, self.at = self.keys[stay], moved[self.at[stay]]
        self.lengths, self.checks, self.uses = self.lengths[keep], self.checks[keep], np.zeros(len(keep), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([flat, np.zeros(1 << 16, np.uint32)])
        self.used = len(flat)
