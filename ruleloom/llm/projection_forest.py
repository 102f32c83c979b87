"""A forest of random-projection trees, and the search of all trees through one priority queue, as numpy arrays.

A tree is complete: node 1 is the root, node i has the children 2i and 2i + 1, and the last level's nodes are leaves.
An inner node halves its sample at the median of a projection: of a few random directions, the one of largest spread.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Random directions of which a node takes the one of largest spread, and sample rows that are projected to find it.
DIRECTIONS, PROJECTED = 4, 2048


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int):
        """leaves: of one tree, a power of two."""
        rng, dims = np.random.default_rng(seed), sample.shape[1]
        self.trees, self.leaves, self.depth = trees, leaves, leaves.bit_length() - 1
        self.planes = np.zeros((trees, leaves, dims), np.float32)
        self.offsets = np.zeros((trees, leaves))
        for t in range(trees):
            rows = {1: np.arange(len(sample))}
            for node in range(1, leaves):
                own = rows.pop(node)
                tried = rng.standard_normal((DIRECTIONS, dims)).astype(np.float32)
                tried /= np.linalg.norm(tried, axis=1, keepdims=True)
                if len(own):
                    self.planes[t, node] = tried[(sample[own[:PROJECTED]] @ tried.T).std(axis=0).argmax()]
                    at = sample[own] @ self.planes[t, node].astype(np.float64)
                    self.offsets[t, node] = np.median(at)
                    right = at > self.offsets[t, node]
                    rows[2 * node], rows[2 * node + 1] = own[~right], own[right]
                else:
                    rows[2 * node] = rows[2 * node + 1] = own

    def place(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): the leaf of each row."""
        out = np.ones((self.trees, len(x)), np.int64)
        for t, node in enumerate(out):
            for _ in range(self.depth):
                at = np.einsum("ij,ij->i", x, self.planes[t, node])
                node *= 2
                node += at > self.offsets[t, node // 2]
        return out - self.leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(row, tree, node): how far each row lies beyond each node's plane."""
        return np.einsum("ij,tnj->itn", x, self.planes, optimize=True) - self.offsets

    def search(self, margin: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """Of one row's margins: the budget nearest leaves of all trees, (tree, leaf), nearest first.

        All trees share the queue. A branch's priority is the sum of the squared margins of the planes that the row
        lies beyond on the way there.
        """
        queue = [(0.0, t, 1) for t in range(self.trees)]
        of, found, leaves = margin.tolist(), [], self.leaves
        while queue and len(found) < budget:
            far, t, node = heapq.heappop(queue)
            own = of[t]
            while node < leaves:
                m = own[node]
                beyond = m > 0
                heapq.heappush(queue, (far + m * m, t, 2 * node + (not beyond)))
                node = 2 * node + beyond
            found.append((t, node - leaves))
        return found

    def order(self, margin: np.ndarray) -> np.ndarray:
        """Of one row's margins, (tree, leaf): the leaves that search() gives before or beside each, itself included."""
        far = np.zeros((self.trees, 1))
        for level in range(self.depth):
            m = margin[:, 1 << level : 2 << level]
            far = np.stack([far + np.maximum(m, 0) ** 2, far + np.maximum(-m, 0) ** 2], axis=2).reshape(self.trees, -1)
        return np.searchsorted(np.sort(far, axis=None), far, side="right")
