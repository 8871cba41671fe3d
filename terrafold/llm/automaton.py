"""Suffix automata over sequences of small integers, for one string or several."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class SuffixAutomaton:
    """All substrings of the given strings. State 0 is the start; ``ends`` holds (string, position) of one
    end of each occurrence class, and all of them when ``occurrences`` is asked for."""

    def __init__(self, strings: Iterable[Sequence[int]], occurrences: bool = False):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for s, string in enumerate(strings):
            last = 0
            for position, symbol in enumerate(string):
                last = self._extend(last, symbol)
                if occurrences:
                    own += [[] for _ in range(len(self.next) - len(own))]
                    own[last].append((s, position))
        own += [[] for _ in range(len(self.next) - len(own))]
        if occurrences:  # longer substrings end where their suffixes end too
            for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
                if self.link[v] > 0:
                    own[self.link[v]] += own[v]
        self.ends = own

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state of the longest string of ``p`` followed by ``symbol``, split off if need be."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # another string has been here
            return self._split(last, symbol)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        self.link[new] = self._split(p, symbol) if p >= 0 else 0
        return new

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """Matching statistics: the longest suffix read so far that is a substring, after one more symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], matched + 1
        return 0, 0
