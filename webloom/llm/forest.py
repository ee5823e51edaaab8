"""A union-find over positions that takes links as arrays; used inside tile tasks."""

from __future__ import annotations

import numpy as np


class Forest:
    """Components of n positions. Links are added in bulk; those within a component cost no more
    than two gathers, so a large group that is already joined is cheap however many links it has."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        while apart.any():
            lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            step = np.arange(len(self.root), dtype=np.int64)
            np.minimum.at(step, hi, lo)  # each root hangs on its smallest neighbour
            while True:
                jump = step[step]
                if (jump == step).all():
                    break
                step = jump
            self.root = step[self.root]
            ra, rb = self.root[ra], self.root[rb]
            apart = ra != rb

    def star_edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each component, links from its first position to the others: fewer than n in all."""
        other = np.flatnonzero(self.root != np.arange(len(self.root)))
        return ids[self.root[other]], ids[other]
