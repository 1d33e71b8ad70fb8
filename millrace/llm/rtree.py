"""An R-tree over count vectors, searched by an upper bound of the overlap of two sets.

A set's members are dealt into groups by hash; its point is the count of members in each group.
Two sets share at most ``sum(min(a_g, b_g))`` members. For a box of points the same sum with the
box's upper corner bounds the overlap with every set in the box. Counts may stop at some number, if
the members that this leaves out are counted together, as one more coordinate.
"""

from __future__ import annotations

import numpy as np

LEAF = 16


def needed(n_a, n_b, percent: int):
    """Least overlap of sets of these sizes with a Jaccard similarity of ``percent`` or more."""
    return -(-(percent * (n_a + n_b)) // (100 + percent))


class RTree:
    """Bulk-loaded by size, then by the order of the points' coordinates."""

    def __init__(self, points: np.ndarray, more: np.ndarray, size: np.ndarray) -> None:
        order = np.lexsort((*points.T[::-1], size))
        self.order, self.points, self.more, self.size = order, points[order], more[order], size[order]
        high, over, low_n, high_n = self.points, self.more, self.size, self.size
        self.levels = []
        while len(high) > LEAF:
            cut = np.arange(0, len(high), LEAF)
            high, over = np.maximum.reduceat(high, cut, axis=0), np.maximum.reduceat(over, cut)
            low_n, high_n = np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            self.levels.append((high, over, low_n, high_n))

    def search(self, point: np.ndarray, more: int, n: int, percent: int) -> np.ndarray:
        """Row numbers of all points whose bound reaches the overlap that ``percent`` needs."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            high, over, low_n, high_n = self.levels[k]
            at = at[(percent * low_n[at] <= 100 * n) & (percent * n <= 100 * high_n[at])]
            least = np.maximum(low_n[at], -(-percent * n // 100))
            at = at[np.minimum(high[at], point).sum(axis=1) + np.minimum(over[at], more) >= needed(n, least, percent)]
            below = len(self.levels[k - 1][0]) if k else len(self.points)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        bound = np.minimum(self.points[at], point).sum(axis=1) + np.minimum(self.more[at], more)
        at = at[bound >= needed(n, self.size[at], percent)]
        return self.order[at]
