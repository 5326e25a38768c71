"""Enhanced suffix arrays of one bounded batch of texts, with numpy.

A batch is one array of symbols in which texts stand one after the other; suffixes end with
their text. Ranks are doubled (1, 2, 4, ... symbols); only suffixes that still share their
rank with another are sorted again, so a batch with few repeats costs about one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class SuffixArray:
    """``order``: suffixes sorted by content; ``lcp[i]``: symbols shared by order[i-1] and order[i].

    ``symbols`` are integers >= 0, ``ends[i]`` is where the text of position i stops. ``packed``
    may give the first ``width`` (8) bytes from each position as one big-endian number, which
    saves rounds. Common prefixes shorter than ``width`` or ``least`` may count as 0.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, packed: np.ndarray | None = None, width: int = 1,
                 least: int = 1) -> None:
        n = len(symbols)
        self.symbols, self.ends = symbols, ends
        left = np.minimum(ends - np.arange(n), width).astype(np.int8)
        short = left < width
        if packed is None:
            keys, order = symbols, np.argsort(symbols, kind="stable")
        else:  # what follows a text's end is not part of its suffixes; the shorter of two stands first
            keys = packed & (np.uint64(2**64 - 1) << (8 * (width - left)).astype(np.uint64))
            order = np.argsort(left, kind="stable")
            order = order[np.argsort(keys[order], kind="stable")]
        fresh = np.r_[True, (keys[order[1:]] != keys[order[:-1]]) | short[order[:-1]]][:n] | short[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
        self.levels = [(width, rank)]
        shared = self._shared(rank, order)
        while shared.any():
            active = order[shared]
            follow = active + width
            inside = follow < ends[active]
            # A suffix that stops here has no longer prefix to share: it stands apart, before the rest.
            second = np.where(inside, rank[np.minimum(follow, n - 1)].astype(np.int64) + 1, 0)
            first = rank[active].astype(np.int64)
            by = np.argsort(first * (n + 2) + second, kind="stable")
            active, first, second, inside = active[by], first[by], second[by], inside[by]
            new = np.r_[True, first[1:] != first[:-1]]
            group = np.flatnonzero(new)
            slots = first + np.arange(len(active)) - np.repeat(group, np.diff(np.r_[group, len(active)]))
            order[slots] = active
            fresh = new | np.r_[True, second[1:] != second[:-1]] | ~inside
            rank = rank.copy()
            rank[active] = np.maximum.accumulate(np.where(fresh, slots, 0))
            width *= 2
            self.levels.append((width, rank))
            shared = self._shared(rank, order)
        self.order, self.lcp = order, self._common(order, n, least)

    @staticmethod
    def _shared(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        return np.r_[False, same] | np.r_[same, False] if len(order) else np.zeros(0, bool)

    def _common(self, order: np.ndarray, n: int, least: int) -> np.ndarray:
        """Longest common prefixes of neighbours, from the ranks of all levels, longest first."""
        lcp = np.zeros(n, np.int64)
        if n < 2:
            return lcp
        first = max((k for k, (width, _) in enumerate(self.levels) if width <= least), default=0)
        sorted_rank = self.levels[first][1][order]
        near = np.flatnonzero(sorted_rank[1:] == sorted_rank[:-1]) + 1
        a, b = order[near - 1], order[near]
        stop_a, stop_b = self.ends[a], self.ends[b]
        shared = np.zeros(len(near), np.int64)
        for width, rank in reversed(self.levels):
            x, y = a + shared, b + shared
            fits = (x + width <= stop_a) & (y + width <= stop_b)
            fits[fits] = rank[x[fits]] == rank[y[fits]]
            shared[fits] += width
        for _ in range(1, self.levels[0][0]):  # what a packed key leaves
            x, y = a + shared, b + shared
            fits = (x < stop_a) & (y < stop_b)
            fits[fits] = self.symbols[x[fits]] == self.symbols[y[fits]]
            if not fits.any():
                break
            shared[fits] += 1
        lcp[near] = shared
        return lcp

    def longest_shared(self) -> np.ndarray:
        """For every position, how many symbols its suffix shares with the nearest other suffix.

        This is the length of the innermost LCP interval that holds the suffix. Spans of the
        outer intervals are prefixes of this one, so unions need no other.
        """
        longest = np.zeros(len(self.order), np.int64)
        longest[self.order] = np.maximum(self.lcp, np.r_[self.lcp[1:], 0][: len(self.lcp)])
        return longest

    def maximal_repeats(self, left: np.ndarray, minimum: int) -> Iterator[tuple[int, int, int]]:
        """(length, first slot, last slot) of every maximal repeat of ``minimum`` symbols or more.

        One scan with a stack walks the tree of LCP intervals, inner ones first. An interval
        is a maximal repeat if its suffixes are preceded by different symbols; ``left[i]`` is
        the symbol before position i, a distinct negative number where a text starts. All
        occurrences of the repeat are ``order[first:last + 1]``.
        """
        diverse = None
        deep = np.flatnonzero(self.lcp >= minimum)
        if not len(deep):
            return
        for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
            low, high = int(run[0]) - 1, int(run[-1])
            marks = left[self.order[low:high + 1]].tolist()
            depths = [*self.lcp[low + 1:high + 1].tolist(), 0]
            stack: list[list] = []
            for slot, depth in enumerate(depths):
                first, mark = slot, marks[slot]
                while stack and stack[-1][0] > depth:
                    length, first, seen = stack.pop()
                    mark = seen if seen == mark else diverse
                    if mark is diverse:
                        yield length, low + first, low + slot
                if depth:
                    if stack and stack[-1][0] == depth:
                        if stack[-1][2] != mark:
                            stack[-1][2] = diverse
                    else:
                        stack.append([depth, first, mark])


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0
