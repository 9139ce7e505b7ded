"""A run-length index: run-compressed Burrows-Wheeler transform of a collection of byte strings, with sampled run ends.

What is kept of the collection besides its bytes are three numbers for each run of the transform: the text positions at
the run's first row and at the last row of the run before, and how many bytes the suffixes there share.  They answer
matching statistics: the suffix before that of position ``p`` in suffix order, and how many bytes both share, follow
from the last sampled run start at or before ``p`` in the text, as inside a run both shift and shrink byte by byte.
"""

from __future__ import annotations

import numpy as np

FIRST = 6  # symbols sorted at once before doubling


class RunLengthIndex:
    """Of strings, each ended by a mark of its own; marks sort before all bytes, in the order of the strings.

    ``at`` (text positions, ascending), ``to`` and ``shared`` are the samples: the suffix at ``at[k]`` begins a run, the
    suffix at ``to[k]`` ends the run before, and both share their first ``shared[k]`` bytes.  A mark before a string's
    first byte is a run of its own, as no other row has that mark.
    """

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], "i8")
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", "u1")
        self.start = np.cumsum(self.sizes + 1) - self.sizes - 1
        order = self._sorted()
        first = np.zeros(len(order), bool)
        first[self.start] = True
        before = self.text[order - 1]
        alone = first[order]
        head = np.flatnonzero((before[1:] != before[:-1]) | alone[1:] | alone[:-1]) + 1
        at, to = order[head], order[head - 1]
        by_place = np.argsort(at)
        self.at, self.to = at[by_place], to[by_place]
        self.shared = self._common(self.at, self.to)

    def _sorted(self) -> np.ndarray:
        """Suffix order by prefix doubling; suffixes whose place is settled are left out of later rounds."""
        n = len(self.text)
        last = np.repeat(self.start + self.sizes, self.sizes + 1)
        symbol = self.text.astype("i8") + 1
        mark = self.start + self.sizes
        symbol[mark] = 0
        place = np.arange(n)
        key = np.zeros(n, "i8")
        for j in range(FIRST):
            key = (key << 9) | symbol[np.minimum(place + j, last)]
        key[mark] = np.arange(len(mark))
        order = np.argsort(key)
        rank, live = self._ranked(key[order], order, np.zeros(n, "i8"), 0)
        known = FIRST
        while len(live):
            # rows of a group of equals are neighbours in ``order`` and share their rank, the group's first row
            rows = order[live]
            key = rank[rows] * np.int64(n) + rank[np.minimum(rows + known, last[rows])]
            inside = np.argsort(key)
            rows, key = rows[inside], key[inside]
            order[live] = rows
            rank, still = self._ranked(key, rows, rank, live)
            live = still
            known *= 2
        return order

    @staticmethod
    def _ranked(key: np.ndarray, rows: np.ndarray, rank: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of rows sorted by key: the row number at which their group of equals starts; and the unsettled rows' numbers."""
        at = np.arange(len(rows)) + at if np.isscalar(at) else at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[rows] = at[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        single = new & np.concatenate((new[1:], [True]))
        return rank, at[~single]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share before either string ends."""
        own = np.searchsorted(self.start, a, side="right") - 1
        other = np.searchsorted(self.start, b, side="right") - 1
        most = np.minimum(self.start[own] + self.sizes[own] - a, self.start[other] + self.sizes[other] - b)
        padded = np.concatenate((self.text, np.zeros(8, "u1")))
        words = np.lib.stride_tricks.as_strided(padded, (len(self.text), 8), (1, 1))
        common = np.zeros(len(a), "i8")
        live = np.flatnonzero(most > 0)
        while len(live):
            x = np.ascontiguousarray(words[a[live] + common[live]]).view("<u8").ravel() ^ np.ascontiguousarray(words[b[live] + common[live]]).view("<u8").ravel()
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
            common[live] = np.minimum(common[live] + same, most[live])
            live = live[(same == 8) & (common[live] < most[live])]
        return common

    def linked(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of at least ``depth``: ascending text positions, and for each the position before it in suffix order that matches it so far."""
        stop = np.minimum(self.at + np.maximum(self.shared - depth + 1, 0), np.append(self.at[1:], len(self.text)))
        n = np.maximum(stop - self.at, 0)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.at, n) + offset, np.repeat(self.to, n) + offset

    def string_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, position, side="right") - 1


def earlier_matches(strings: list[bytes], where: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each string, the ascending offsets of those of its ``depth``-byte substrings that also start at an earlier place.

    ``where`` orders the strings' first bytes; a substring's place is that of its string plus its offset.  Every string is
    streamed through the index; positions that match ``depth`` bytes or more are linked to their neighbours in suffix
    order, equal substrings hang together by such links, and all but those at the earliest place of each are repetitions.
    """
    index = RunLengthIndex(strings)
    position, before = index.linked(depth)
    out = [np.empty(0, "i8")] * len(strings)
    if not len(position):
        return out
    node = np.union1d(position, before)
    up = np.arange(len(node))
    up[np.searchsorted(node, position)] = np.searchsorted(node, before)
    while not np.array_equal(up, twice := up[up]):
        up = twice
    own = index.string_of(node)
    offset = node - index.start[own]
    place = where[own] + offset
    earliest = np.full(len(node), np.iinfo("i8").max)
    np.minimum.at(earliest, up, place)
    again = np.flatnonzero(place > earliest[up])
    cut = np.searchsorted(own[again], np.arange(len(strings) + 1))
    return [offset[again[a:b]] for a, b in zip(cut, cut[1:], strict=False)]
