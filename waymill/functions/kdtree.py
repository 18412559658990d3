"""k-d trees over unit vectors, in NumPy: a splitting tree that spreads rows over partitions, and a local tree
for radius queries inside one partition.

Planar metres (x, y) are laid on the unit sphere as longitude x/R and latitude y/R. That map never lengthens a
distance: the chord between two images is at most the planar distance over R. So every pair within a planar radius
r lies within the chord r/R, and a chord query finds all of them; the exact planar test follows.
"""

from __future__ import annotations

import numpy as np

#: Metres of the sphere the plane is laid on. Planar coordinates far below it keep chords close to distances.
RADIUS = 6_371_000.0
#: Relative and absolute slack of chord comparisons, far above the rounding of doubles.
SLACK, FLOOR = 1e-9, 1e-14


def unit_vectors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, 3) unit vectors of planar coordinates."""
    lon, lat = np.asarray(x, float) / RADIUS, np.asarray(y, float) / RADIUS
    flat = np.cos(lat)
    return np.stack([flat * np.cos(lon), flat * np.sin(lon), np.sin(lat)], axis=1)


def chord(metres: np.ndarray | float) -> np.ndarray | float:
    """A chord that no pair within ``metres`` exceeds."""
    return np.asarray(metres, float) / RADIUS * (1 + SLACK) + FLOOR


#: Sample vectors per leaf: the spread of a leaf's size about its mean is then some 20 %.
PER_LEAF = 32
#: Leaves of a tree that driver and executors hold: 21 bytes each, so some 88 MB at most; beyond it leaves grow.
MOST_LEAVES = 1 << 22


class SplitTree:
    """A k-d tree of leaves that tile all of space, so every vector has a leaf, whether it was in the sample or not.

    Fitted by medians on a sample to ``2**depth`` leaves; ``split`` parts single leaves again. Inner nodes are rows of
    ``axis``, ``cut`` and ``kids`` (left, right); a negative kid is a leaf, ``~leaf``.
    """

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.axis, self.cut = np.zeros(0, np.int8), np.zeros(0)
        self.kids = np.zeros((0, 2), np.int32)
        self.leaves = 1
        self.split({0: sample}, {0: depth})

    def split(self, samples: dict[int, np.ndarray], depths: dict[int, int]) -> None:
        """Part each leaf of ``samples`` by medians into ``2**depths[leaf]``; one of the parts keeps the leaf's number.
        A leaf whose sample is all in one place isn't parted."""
        axis, cut, kids = self.axis.tolist(), self.cut.tolist(), self.kids.tolist()
        above = {~kid: (node, side) for node, pair in enumerate(kids) for side, kid in enumerate(pair) if kid < 0}
        stack = [(leaf, *above.get(leaf, (-1, 0)), samples[leaf], depths[leaf]) for leaf in samples]
        while stack:
            leaf, parent, side, points, depth = stack.pop()
            wide = np.ptp(points, axis=0) if len(points) else np.zeros(3)
            if not depth or not wide.max() > 0:
                continue
            at = int(np.argmax(wide))
            middle = float(np.median(points[:, at]))
            if not (points[:, at] < middle).any():  # more than half share the least value: the cut goes above it
                middle = float(points[:, at][points[:, at] > middle].min())
            node, other = len(axis), self.leaves
            self.leaves += 1
            axis.append(at), cut.append(middle), kids.append([~leaf, ~other])
            if parent >= 0:
                kids[parent][side] = node
            low = points[:, at] < middle
            stack += [(leaf, node, 0, points[low], depth - 1), (other, node, 1, points[~low], depth - 1)]
        self.axis, self.cut = np.array(axis, np.int8), np.array(cut, float)
        self.kids = np.array(kids, np.int32).reshape(-1, 2)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.full(len(vectors), 0 if len(self.axis) else ~0, np.int64)
        rows = np.flatnonzero(node >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = self.kids[at, (vectors[rows, self.axis[at]] >= self.cut[at]).astype(np.int8)]
            rows = rows[node[rows] >= 0]
        return ~node

    def reached(self, vectors: np.ndarray, reach: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the ball of chord ``reach`` about a vector can touch."""
        rows, node = np.arange(len(vectors)), np.full(len(vectors), 0 if len(self.axis) else ~0, np.int64)
        reach = np.broadcast_to(np.asarray(reach, float), len(vectors))
        done_rows, done = [], []
        while len(rows):
            last = node < 0
            done_rows.append(rows[last]), done.append(~node[last])
            rows, node = rows[~last], node[~last]
            at, cut = vectors[rows, self.axis[node]], self.cut[node]
            left, right = at - reach[rows] < cut, at + reach[rows] >= cut
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([self.kids[node[left], 0], self.kids[node[right], 1]])
        return np.concatenate([*done_rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*done, np.zeros(0, np.int64)]).astype(np.int64)


class LocalTree:
    """A k-d tree over the vectors of one partition, with leaves of at most ``leaf`` vectors."""

    def __init__(self, vectors: np.ndarray, leaf: int = 24) -> None:
        self.vectors = vectors
        self.order = np.arange(len(vectors))
        lows, highs, starts, ends, kids = [], [], [], [], []
        stack = [(0, len(vectors), -1, 0)] if len(vectors) else []
        while stack:
            start, end, parent, side = stack.pop()
            own = vectors[self.order[start:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            at = len(starts)
            lows.append(low), highs.append(high), starts.append(start), ends.append(end), kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = at
            if end - start > leaf and (high > low).any():
                axis, middle = int(np.argmax(high - low)), (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], middle)]
                stack += [(start, start + middle, at, 0), (start + middle, end, at, 1)]
        self.low, self.high = np.array(lows).reshape(-1, 3), np.array(highs).reshape(-1, 3)
        self.start, self.end, self.kids = np.array(starts, np.int64), np.array(ends, np.int64), np.array(kids, np.int64).reshape(-1, 2)

    def within(self, queries: np.ndarray, reach: float, budget: int = 2_000_000):
        """Blocks of (query row, tree row) of all pairs at most ``reach`` apart; a block compares about ``budget``
        pairs, so memory stays bounded however dense the place is."""
        if not len(self.start):
            return
        step = max(1, min(len(queries), 8192))
        for begin in range(0, len(queries), step):
            part = queries[begin : begin + step]
            rows, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            pending_rows, pending_nodes = [], []
            while len(rows):
                gap = np.maximum(0, np.maximum(self.low[node] - part[rows], part[rows] - self.high[node]))
                near = (gap * gap).sum(axis=1) <= reach * reach
                rows, node = rows[near], node[near]
                last = self.kids[node, 0] < 0
                pending_rows.append(rows[last]), pending_nodes.append(node[last])
                rows, node = rows[~last], node[~last]
                rows, node = np.concatenate([rows, rows]), np.concatenate([self.kids[node, 0], self.kids[node, 1]])
            rows, node = np.concatenate(pending_rows), np.concatenate(pending_nodes)
            sizes = self.end[node] - self.start[node]
            edges = np.searchsorted(np.cumsum(sizes), np.arange(budget, sizes.sum() + budget, budget), side="left") + 1
            before = 0
            for edge in np.unique(np.minimum(edges, len(rows))):
                r, n, s = rows[before:edge], node[before:edge], sizes[before:edge]
                before = edge
                if not len(r):
                    continue
                who = np.repeat(r, s)
                what = self.order[np.repeat(self.start[n] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())]
                apart = part[who] - self.vectors[what]
                near = (apart * apart).sum(axis=1) <= reach * reach
                yield who[near] + begin, what[near]
