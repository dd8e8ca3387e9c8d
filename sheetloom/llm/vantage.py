"""Vantage-point trees over 64-bit fingerprints under Hamming distance.

A node sends fingerprints nearer than ``radius`` to its vantage point left and the others right.
For pairs within ``bits``, the triangle inequality bounds how their distances to the vantage point
differ: of a pair that a node parts, the left one is at ``radius - bits`` at least. Those boundary
fingerprints are copied to the right side too. Then every such pair meets in some leaf: where both
go the same way nothing is lost, and where they part both are on the right. So leaves can be
searched apart, and one copy in five or so (for two bits) is what a level costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class VantageTree:
    """Nodes in arrays; a child below zero is leaf -child - 1."""

    bits: int
    points: list[int] = field(default_factory=list)
    radii: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    n_leaves: int = 0

    def route(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indexes of the prints that it holds)."""
        todo = [(0 if self.points else -1, np.arange(len(prints)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at
                continue
            d = np.bitwise_count(prints[at] ^ np.uint64(self.points[node])).astype(np.int16)
            left, right = self.children[node]
            todo.append((left, at[d < self.radii[node]]))
            todo.append((right, at[d >= self.radii[node] - self.bits]))


def best_split(prints: np.ndarray, bits: int, seed: int, tries: int = 6) -> tuple[int, int, int]:
    """(vantage point, radius, size of the larger side with its copies), the best of some points."""
    best = (0, 0, len(prints) + 1)
    picks = np.random.default_rng(seed).integers(0, len(prints), tries)
    for point in prints[picks]:
        near = np.cumsum(np.bincount(np.bitwise_count(prints ^ point), minlength=65))
        below = np.concatenate([[0], near])  # below[r]: nearer than r
        radii = np.arange(1, 65)
        larger = np.maximum(below[radii], len(prints) - below[np.maximum(0, radii - bits)])
        r = int(np.argmin(larger))
        if larger[r] < best[2]:
            best = (int(point), int(radii[r]), int(larger[r]))
    return best


def grow(sample: np.ndarray, bits: int, leaf_share: float) -> VantageTree:
    """A tree whose leaves hold about leaf_share of all fingerprints, fitted on a sample."""
    tree = VantageTree(bits)
    stop = max(4.0, leaf_share * len(sample))

    def add(prints: np.ndarray, seed: int) -> int:
        point, radius, larger = best_split(prints, bits, seed) if len(prints) > stop else (0, 0, len(prints))
        if larger > 0.9 * len(prints):
            tree.n_leaves += 1
            return -tree.n_leaves
        node = len(tree.points)
        tree.points.append(point)
        tree.radii.append(radius)
        tree.children.append([0, 0])
        d = np.bitwise_count(prints ^ np.uint64(point)).astype(np.int16)
        tree.children[node] = [add(prints[d < radius], 2 * seed + 1), add(prints[d >= radius - bits], 2 * seed + 2)]
        return node

    def seeds_fit(prints: np.ndarray) -> None:
        add(prints, 1)

    if len(sample):
        seeds_fit(np.unique(sample))
    else:
        tree.n_leaves = 1
    return tree


def spanning_links(prints: np.ndarray, bits: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of each class of two or more distinct prints that links of at
    most ``bits`` join. Every pair within ``bits`` is found; one link a member is given."""
    prints = np.unique(prints)
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    todo = [(np.arange(len(prints)), 1)]
    while todo:
        at, seed = todo.pop()
        if len(at) > block:
            point, radius, larger = best_split(prints[at], bits, seed, 3)
            if larger <= 0.9 * len(at):
                d = np.bitwise_count(prints[at] ^ np.uint64(point)).astype(np.int16)
                todo += [(at[d < radius], 2 * seed % (1 << 60)), (at[d >= radius - bits], (2 * seed + 1) % (1 << 60))]
                continue
        for a in range(0, len(at), block):
            rows = at[a : a + block]
            for b in range(a, len(at), block):
                cols = at[b : b + block]
                i, j = np.nonzero(np.bitwise_count(prints[rows][:, None] ^ prints[cols][None, :]) <= bits)
                for x, y in zip(rows[i].tolist(), cols[j].tolist(), strict=True):
                    if x != y and (p := root(x)) != (q := root(y)):
                        parent[max(p, q)] = min(p, q)
    roots = np.array([root(i) for i in range(len(prints))], np.int64)
    linked = roots != np.arange(len(prints))
    return prints[linked], prints[roots[linked]]
