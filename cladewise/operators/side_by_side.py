"""Placements of sites in many sequences at a time.

Sequences lie end to end in one array. A pass goes through the places of all of them side by side, the longest first, so that those that have
ended fall off the end. What a site weighs at a start depends only on the letters it covers: for short motifs it is looked up by their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: Letters, the missing one included; words up to this length are looked up in a table of all of them.
SYMBOLS, TABLED = 6, 8
#: Letters that are held to be gone through side by side, and places that a draw looks through at once.
CELLS, AHEAD = 2_000_000, 32


def held(rows: Iterator[tuple], cells: int = CELLS) -> Iterator[list[tuple]]:
    """Rows, whose last entry is a sequence's codes, as lists of about ``cells`` letters."""
    own, n = [], 0
    for row in rows:
        own.append(row)
        n += len(row[-1])
        if n >= cells:
            yield own
            own, n = [], 0
    if own:
        yield own


class Lined:
    """Sequences (codes 0 to 5) end to end; ``order``: their places in the list given, the longest first."""

    def __init__(self, seqs: list[np.ndarray]) -> None:
        given = np.array([len(s) for s in seqs], np.int64)
        self.order = np.argsort(-given, kind="stable")
        self.size = given[self.order]
        self.start = (np.cumsum(given) - given)[self.order]
        self.codes = np.concatenate(seqs).astype(np.int32) if seqs else np.zeros(0, np.int32)
        self.left = np.repeat(np.cumsum(given), given) - np.arange(len(self.codes))  # letters from here to the end of the sequence
        self.alive = np.searchsorted(-self.size, -np.arange(1, (int(self.size[0]) if len(given) else 0) + 1), "right")

    def windows(self, length: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.codes, length)

    def by_word(self, length: int, values: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """``values`` (of words, one a row) of the word at each start; at starts too close to an end they mean nothing."""
        n = len(self.codes) - length + 1
        if SYMBOLS**length > n or length > TABLED:
            parts = [values(self.windows(length)[at : at + 100_000]) for at in range(0, n, 100_000)]
            found = [np.concatenate(x) for x in zip(*parts)]
        else:
            number = np.zeros(n, np.int32)
            for j in range(length):
                number *= SYMBOLS
                number += self.codes[j : j + n]
            found = [np.take(x, number) for x in values(every_word(length))]
        return tuple(np.concatenate([x, np.zeros(length - 1, x.dtype)]) for x in found)


def every_word(length: int) -> np.ndarray:
    return np.arange(SYMBOLS**length)[:, None] // SYMBOLS ** np.arange(length - 1, -1, -1) % SYMBOLS


def site_shares(lined: Lined, weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By length: the probability that, of all placements up to a letter, one ends with a site of this length there."""
    lengths = sorted(weights)
    out = {n: np.zeros(len(lined.codes)) for n in lengths}
    most = max(lengths, default=1)
    sums = np.zeros((most, len(lined.size)))  # summed weights of the last places, as parts of the last one's
    sums[0] = 1.0
    for t, k in enumerate(lined.alive.tolist()):
        at, grown, terms = lined.start[:k] + t, np.ones(k), []
        for n in lengths:
            if t + 1 >= n:
                x = np.take(weights[n], at - (n - 1)) * sums[(t + 1 - n) % most, :k]
                grown += x
                terms.append((out[n], x))
        grown = 1 / grown
        for own, x in terms:
            own[at] = x * grown
        sums[:, :k] *= grown
        sums[(t + 1) % most, :k] = 1.0
    return out


def drawn_sites(lined: Lined, shares: dict[int, np.ndarray], uniform: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, length, start, u): sites drawn backwards from the ends; the uniform numbers of row k of ``lined`` are taken from ``last[k]`` downwards.

    A place takes one number, a site a second one, which is given back.
    """
    lengths = sorted(shares)
    if not lengths:
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.int64, float))
    whole = sum(shares[n] for n in lengths)
    live, ahead, found = np.arange(len(lined.size)), np.arange(AHEAD), []
    i, top = lined.size.copy(), last.copy()
    live = live[i > 0]
    while len(live):
        own, next_ = i[live], top[live]
        back = np.minimum(ahead, own[:, None] - 1)  # places before the first are the first again
        hit = uniform[next_[:, None] - back] < whole[(lined.start[live] + own - 1)[:, None] - back]
        first = hit.argmax(1)
        met = hit[np.arange(len(live)), first]
        step = np.where(met, first, np.minimum(AHEAD, own))
        own, next_ = own - step, next_ - step
        rows = np.flatnonzero(met)
        if len(rows):
            at, left, length = (lined.start[live] + own - 1)[rows], uniform[next_[rows]], np.full(len(rows), lengths[-1])
            done = np.zeros(len(rows), bool)
            for n in lengths:
                p = shares[n][at]
                now = ~done & (left < p)
                length[now] = n
                done |= now
                left = left - p
            # what rounding leaves between the sum and its parts is no site
            rows, length, lost = rows[done], length[done], rows[~done]
            own[lost], next_[lost] = own[lost] - 1, next_[lost] - 1
            own[rows] -= length
            found.append((live[rows], length, own[rows], uniform[next_[rows] - 1]))
            next_[rows] -= 2
        i[live], top[live] = own, next_
        live = live[own > 0]
    if not found:
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.int64, float))
    return tuple(np.concatenate(x) for x in zip(*found))


def best_placement(lined: Lined, scores: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, start) of the sites of each sequence's best placement; of equal sums fewer sites."""
    lengths = sorted(scores)
    most = max(lengths, default=1) + 1
    taken = np.zeros(len(lined.codes), np.int32)
    best = np.zeros((most, len(lined.size)))
    for t, k in enumerate(lined.alive.tolist()):
        at, now = lined.start[:k] + t, best[t % most, :k].copy()
        for n in lengths:
            if t + 1 >= n:
                more = np.take(scores[n], at - (n - 1)) + best[(t + 1 - n) % most, :k]
                better = more > now
                if better.any():
                    now[better] = more[better]
                    taken[at[better]] = n
        best[(t + 1) % most, :k] = now
    ends = np.maximum.accumulate(np.where(taken > 0, np.arange(len(taken)), -1))
    live, i, found = np.flatnonzero(lined.size > 0), lined.size.copy(), []
    while len(live):
        end = ends[lined.start[live] + i[live] - 1]
        own = end >= lined.start[live]
        live, end = live[own], end[own]
        i[live] = end - taken[end] + 1 - lined.start[live]
        found.append((live, taken[end].astype(np.int64), i[live]))
        live = live[i[live] > 0]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def add_letters(lined: Lined, sites: tuple[np.ndarray, ...], lengths: list[int], complement: np.ndarray, counts: list[np.ndarray], sizes: np.ndarray) -> None:
    """Add the letters of sites (row, motif, start, reverse), with those beside them, to counts by motif, offset and letter, and the sites to ``sizes``."""
    row, motif, start, reverse = sites
    sizes += np.bincount(motif, minlength=len(sizes))
    for k in np.unique(motif).tolist():
        mine = np.flatnonzero(motif == k)
        own, begin, turned, first, size = lengths[k], start[mine], reverse[mine], lined.start[row[mine]], lined.size[row[mine]]
        flank = math.ceil(own / 2)
        for j in range(-flank, own + flank):
            at = begin + np.where(turned, own - 1 - j, j)
            inside = (at >= 0) & (at < size)
            letter = lined.codes[(first + at)[inside]]
            letter = np.where(turned[inside], complement[letter], letter)
            counts[k][j + flank] += np.bincount(letter[letter < 5], minlength=5)
