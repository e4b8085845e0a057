"""Geodesics of many pairs of trees at a time.

Trees are columns of an array with a row for each edge that any of them has (0: no such edge), and with further rows for lengths that all of them
have, as those of leaves. Pairs whose edges all fit together go along straight lines. The others are taken together by which edges either tree has: what
replaces what depends on those sets and, where more than one edge stands against more than one, on the lightest cover, which is looked for among all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

from .trees import _compatible, _cover

#: Edges that the trees of one array may have, and the smaller side of a piece whose covers are tried one by one.
MOST_EDGES, MOST_TRIED = 30, 8


class Space:
    def __init__(self, masks: list[int]) -> None:
        if len(masks) > MOST_EDGES:
            raise ValueError("too many edges for one array")
        self.masks, self.n = masks, len(masks)
        self.clash = np.array([[not _compatible(a, b) for b in masks] for a in masks], bool).reshape(self.n, self.n)
        self.clashing = [int(sum(1 << int(j) for j in np.flatnonzero(row))) for row in self.clash]
        self._known: dict[tuple[int, int], list[tuple[list[int], list[int]]]] = {}
        self._small = 2 * self.n <= 16
        if self._small:
            both = np.arange(1 << (2 * self.n))
            self._apart = self._any_clash(both >> self.n, both & ((1 << self.n) - 1))

    def codes(self, trees: np.ndarray) -> np.ndarray:
        """Which edges each tree has, as bits."""
        if self.n <= 8:
            return np.packbits(trees[: self.n] > 0, axis=0, bitorder="little")[0].astype(np.int64) if self.n else np.zeros(trees.shape[1], np.int64)
        out = np.zeros(trees.shape[1], np.int64)
        for k in range(self.n):
            out |= (trees[k] > 0).astype(np.int64) << k
        return out

    def _any_clash(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(one.shape, bool)
        for k, others in enumerate(self.clashing):
            if others:
                out |= (one >> k & 1).astype(bool) & ((two & others) != 0)
        return out

    def flat(self, codes: np.ndarray) -> bool:
        """Whether all edges that occur fit together."""
        whole = np.bitwise_or.reduce(codes, initial=0)
        return not self._any_clash(np.array([whole]), np.array([whole]))[0]

    def _pieces(self, one: int, two: int) -> list[tuple[list[int], list[int]]]:
        """Rows of edges of both trees that stand against each other, between the edges that both can have."""
        found = self._known.get((one, two))
        if found is None:
            e1, e2 = ([k for k in range(self.n) if code >> k & 1] for code in (one, two))
            common = {x for x in e1 if x in e2 or not self.clash[x, e2].any()} | {x for x in e2 if x in e1 or not self.clash[x, e1].any()}
            pieces: dict[int, tuple[list[int], list[int]]] = {}
            for side, own in enumerate((e1, e2)):
                for x in own:
                    if x not in common:
                        m = self.masks[x]
                        border = min((self.masks[y] for y in common if not m & ~self.masks[y]), key=lambda y: (y.bit_count(), y), default=0)
                        pieces.setdefault(border, ([], []))[side].append(x)
            found = self._known[one, two] = list(pieces.values())
        return found

    def supports(self, one: np.ndarray, two: np.ndarray, codes: np.ndarray, others: np.ndarray) -> Iterator[tuple]:
        """(columns, a, b, norm of a, norm of b): in those pairs the edges ``a`` of the first tree give way to the edges ``b`` of the second.

        ``one`` may be a single tree for all of ``two``.
        """
        one, codes = np.broadcast_to(one, two.shape), np.broadcast_to(codes, others.shape)
        key = codes << self.n | others
        rows = np.flatnonzero(self._apart[key] if self._small else self._any_clash(codes, others))
        if not len(rows):
            return
        key = key[rows].astype(np.uint16) if self._small else key[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(rows)]
        for a, b in itertools.pairwise(cuts):
            code = int(key[a])
            for x, y in self._pieces(code >> self.n, code & ((1 << self.n) - 1)):
                yield from self._refined(one, two, rows[a:b], x, y)

    def _refined(self, one: np.ndarray, two: np.ndarray, rows: np.ndarray, x: list[int], y: list[int]) -> Iterator[tuple]:
        if len(x) == 1 and len(y) == 1:
            yield rows, x, y, one[x[0], rows], two[y[0], rows]
            return
        ex, ey = one[np.ix_(x, rows)] ** 2, two[np.ix_(y, rows)] ** 2
        nx, ny = np.sqrt(ex.sum(0)), np.sqrt(ey.sum(0))
        if not x or not y:
            yield rows, x, y, nx, ny
            return
        weight, covers, best = self._lightest(ex / nx**2, ey / ny**2, x, y)
        for k in np.unique(best[weight < 1 - 1e-6]).tolist():
            own = rows[(best == k) & (weight < 1 - 1e-6)]
            ca, cb = covers[k]
            yield from self._refined(one, two, own, sorted(ca), [j for j in y if j not in cb])
            yield from self._refined(one, two, own, [i for i in x if i not in ca], sorted(cb))
        last = weight >= 1 - 1e-6
        yield rows[last], x, y, nx[last], ny[last]

    def _lightest(self, wx: np.ndarray, wy: np.ndarray, x: list[int], y: list[int]) -> tuple[np.ndarray, list[tuple[set[int], set[int]]], np.ndarray]:
        """Weight of each column's lightest cover, the covers that occur, and which is whose."""
        covers, weights = [], []
        if min(len(x), len(y)) > MOST_TRIED:
            for k in range(wx.shape[1]):
                names = lambda own: {self.masks[i]: i for i in own}
                w, ca, cb = _cover([*names(x)], [*names(y)], {self.masks[i]: v for i, v in zip(x, wx[:, k])}, {self.masks[j]: v for j, v in zip(y, wy[:, k])})
                covers.append(({names(x)[m] for m in ca}, {names(y)[m] for m in cb}))
                weights.append(w)
            return np.array(weights), covers, np.arange(len(covers))
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        for n in range(len(small), -1, -1):
            for taken in itertools.combinations(small, n):
                left = [i for i in small if i not in taken]
                needed = {j for j in large if left and self.clash[left, j].any()}
                covers.append((set(taken), needed) if small is x else (needed, set(taken)))
                ca, cb = ([i in covers[-1][0] for i in x], [j in covers[-1][1] for j in y])
                weights.append(wx[ca].sum(0) + wy[cb].sum(0))
        every = np.array(weights)
        best = every.argmin(0)
        return every[best, np.arange(every.shape[1])], covers, best

    def lengths(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        square = ((one - two) ** 2).sum(0)
        for rows, _, _, nx, ny in self.supports(one, two, self.codes(one), self.codes(two)):
            square[rows] += 2 * nx * ny
        return np.sqrt(square)

    def between(self, one: np.ndarray, two: np.ndarray, share: np.ndarray | float, others: np.ndarray | None = None) -> np.ndarray:
        """The trees at ``share`` of the way; ``others``: the codes of ``two``, if known."""
        out, one = one + share * (two - one), np.broadcast_to(one, two.shape)
        for rows, x, y, nx, ny in self.supports(one, two, self.codes(one), self.codes(two) if others is None else others):
            own = share if np.ndim(share) == 0 else share[rows]
            rest = (1 - own) * nx - own * ny
            for edges, trees, norm, left in ((x, one, nx, rest), (y, two, ny, -rest)):
                if len(edges) == 1:
                    out[edges[0], rows] = np.maximum(left, 0.0)
                elif edges:
                    out[np.ix_(edges, rows)] = trees[np.ix_(edges, rows)] * (np.maximum(left, 0.0) / norm)
        return out

    def mean(self, trees: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """The inductive mean and the sum of positive weights: of equal lines of trees side by side, then of the lines' means."""
        total = weights.astype(float)
        if self.flat(self.codes(trees)):
            return trees @ total / total.sum(), float(total.sum())
        while trees.shape[1] > 1:
            n = trees.shape[1]
            width = int(np.sqrt(n))
            place, sums = trees[:, :width].copy(), total[:width].copy()
            for at in range(width, n, width):
                own, w = trees[:, at : at + width], total[at : at + width]
                k = own.shape[1]
                sums[:k] += w
                place[:, :k] = self.between(place[:, :k], own, w / sums[:k])
            trees, total = place, sums
        return trees[:, 0], float(total[0])


def mean_walks(space: Space, trees: np.ndarray, weights: np.ndarray, first: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """Ends of walks toward the mean, side by side: walk k starts at its first tree and passes ``steps`` times over the ``sizes[k]`` trees from ``first[k]`` on."""
    order = np.argsort(-sizes, kind="stable")
    start, size = first[order], sizes[order]
    place, codes, equal = trees[:, start].copy(), space.codes(trees), bool((weights == 1).all())
    todo = steps * size - 1
    at = np.zeros(len(size), np.int64)
    live = len(size)
    for k in range(int(todo[0]) if live else 0):
        while todo[live - 1] <= k:
            live -= 1
        own = at[:live]
        own += 1
        own[own == size[:live]] = 0
        n = start[:live] + own
        pull = 1.0 / (1 + k) if equal else weights[n] / (1 + k)
        new = space.between(place[:, :live], np.take(trees, n, axis=1), pull / (1 + pull), codes[n])
        if live == place.shape[1]:
            place = new
        else:
            place[:, :live] = new
    out = np.empty_like(place)
    out[:, order] = place
    return out
