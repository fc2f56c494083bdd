"""A small union-find on arrays, for tasks that find many links among few nodes."""

from __future__ import annotations

import numpy as np


class Forest:
    """Joins of nodes 0..n-1; what it keeps is at most one link a node, however many it is given."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while not np.array_equal(r, t := self.up[r]):
            r = t
        return r

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            self.up[np.maximum(a, b)] = np.minimum(a, b)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each joined node with the root of its tree."""
        root = self.find(np.arange(len(self.up)))
        i = np.flatnonzero(root != np.arange(len(root)))
        return i, root[i]
