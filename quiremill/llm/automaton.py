"""Suffix automata: every substring of a text leads from the start to one state."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def suffix_automaton(*texts: Iterable) -> tuple[list[dict], list[int], list[int]]:
    """(transitions, suffix links, longest lengths) by state, of which 0 is the start; at most two states a symbol."""
    step: list[dict] = [{}]
    link, length = [-1], [0]

    def twin_of(p: int, c, q: int) -> int:
        """A state for the shorter substrings of ``q``, those that end with ``c`` after ``p``."""
        twin = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        link[q] = twin
        return twin

    for text in texts:
        last = 0
        for c in text:
            q = step[last].get(c)
            if q is not None:  # an earlier text has this substring
                last = q if length[last] + 1 == length[q] else twin_of(last, c, q)
                continue
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[cur] = q if length[p] + 1 == length[q] else twin_of(p, c, q)
            last = cur
    return step, link, length


class Packed:
    """An automaton's transitions in two flat arrays that numpy can follow for many texts at a time.

    The transitions of a state lie at its ``base`` plus the symbol; the owner of a place tells whether it is the state's.
    Rows are laid so that they interlock, so room goes with the transitions, whatever the number of symbols. The start
    has no row: ``first`` holds the state after each symbol, the start where there is none.
    """

    def __init__(self, step: list[dict], symbols: int):
        self.symbols = symbols
        self.first = np.zeros(symbols, np.int32)
        for c, q in step[0].items():
            self.first[c] = q
        self.base = np.zeros(len(step), np.int32)
        rows = sorted((s for s in range(1, len(step)) if step[s]), key=lambda s: -len(step[s]))
        several = [s for s in rows if len(step[s]) > 1]
        total = sum(len(step[s]) for s in rows)
        free = np.ones(2 * total + 4 * symbols + 64, bool)
        free[:symbols] = False  # so that no base is negative
        low = symbols
        probe = np.arange(256)
        for s in several:
            own = np.fromiter(step[s], np.int64, len(step[s]))
            own.sort()
            at = low - own[0]
            while True:
                if at + 256 + own[-1] >= len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                ok = free[at + probe + own[0]]
                for c in own[1:]:
                    ok &= free[at + probe + c]
                hit = int(ok.argmax())
                if ok[hit]:
                    at += hit
                    break
                at += 256
            free[at + own] = False
            self.base[s] = at
            # places below are nearly full and left to states of one transition
            if at + own[0] - low > 2048:
                low += 1024
        single = [s for s in rows if len(step[s]) == 1]
        open_ = np.flatnonzero(free)
        if len(open_) < len(single):
            open_ = np.concatenate([open_, np.arange(len(free), len(free) + len(single))])
        letters = np.fromiter((next(iter(step[s])) for s in single), np.int64, len(single))
        self.base[single] = open_[: len(single)] - letters
        size = int(self.base.max(initial=0)) + symbols + 1
        self.owner, self.next = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for s in rows:
            b = int(self.base[s])
            for c, q in step[s].items():
                self.owner[b + c], self.next[b + c] = s, q

    def phrases(self, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Longest-match phrases of many texts: ``columns`` [place, text] holds their symbols, ``lengths`` falls from text to text."""
        state, count = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
        ends = len(lengths) - np.searchsorted(lengths[::-1], np.arange(len(columns)), "right")
        for c, n in zip(columns, ends.tolist(), strict=True):
            if not n:
                break
            c, now = c[:n], state[:n]
            at = self.base[now]
            at += c
            broken = self.owner[at] != now  # the start owns no place
            count[:n] += broken
            state[:n] = np.where(broken, self.first[c], self.next[at])
        return count
