"""Boxes around runs of points, for nearest neighbours in few dimensions.

A tree of median cuts (widest side first) deals points to leaves; every node knows
the tight box and the number of the rows below it. The rows within a distance of a
query lie in leaves whose box is that near, which a walk from the root finds in about
the logarithm of the number of leaves. The same tree serves twice: built on a bounded
sample it deals a table to cells, built on a cell's own rows it searches the cell.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

FRONTIER = 200_000  # pairs of query and node held at a time
ENTRIES = 1_000_000  # distances held at a time
LEAF_ROWS = 48
SLACK = 1e-9


class Boxes:
    """Nodes as arrays: ``dim`` and ``cut`` (rows up to it go left), ``left`` (right is next to it, -1: a leaf),
    ``leaf`` (number of a leaf); children come after their parents."""

    def __init__(self, points: np.ndarray, leaf_rows: int, least: int = 1):
        """Cut until a leaf holds at most ``leaf_rows`` of ``points``, or a cut would leave fewer than ``least`` on a side."""
        dim, cut, left, rows = [0], [0.0], [-1], [np.arange(len(points))]
        at = 0
        while at < len(dim):
            own = rows[at]
            found = self._cut(points, own, least) if len(own) > leaf_rows else None
            if found is not None:
                dim[at], cut[at], low = found
                left[at] = len(dim)
                for side in (own[low], own[~low]):
                    dim.append(0), cut.append(0.0), left.append(-1), rows.append(side)
                rows[at] = None
            at += 1
        self.dim, self.cut, self.left = np.array(dim), np.array(cut), np.array(left)
        ends = np.flatnonzero(self.left < 0)
        self.leaf = np.full(len(dim), -1)
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)
        #: rows in the order of their leaves, and where each leaf begins
        self.rows = np.concatenate([rows[i] for i in ends])
        self.first = np.cumsum([0, *(len(rows[i]) for i in ends)])

    @staticmethod
    def _cut(points, own, least):
        x = points[own]
        for d in np.argsort(-(x.max(axis=0) - x.min(axis=0)), kind="stable"):
            v = x[:, d]
            middle = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            below = v[v < middle]
            for cut in ([middle] if not len(below) else [middle, below.max()]):
                low = v <= cut
                if least <= low.sum() <= len(v) - least:
                    return int(d), float(cut), low
        return None

    def leaf_of(self, q: np.ndarray) -> np.ndarray:
        at, go = np.zeros(len(q), np.int64), np.arange(len(q))
        while len(go):
            go = go[self.left[at[go]] >= 0]
            n = at[go]
            at[go] = self.left[n] + (q[go, self.dim[n]] > self.cut[n])
        return self.leaf[at]

    def fill(self, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Boxes:
        """Set the number and the box of the rows of each leaf (an empty leaf: from inf to -inf)."""
        n = len(self.left)
        self.size, self.lo, self.hi = np.zeros(n, np.int64), np.full((n, lo.shape[1]), np.inf), np.full((n, lo.shape[1]), -np.inf)
        ends = np.flatnonzero(self.left < 0)
        self.size[ends], self.lo[ends], self.hi[ends] = size, lo, hi
        for i in np.flatnonzero(self.left >= 0)[::-1]:
            c = self.left[i]
            self.size[i] = self.size[c] + self.size[c + 1]
            self.lo[i], self.hi[i] = np.minimum(self.lo[c], self.lo[c + 1]), np.maximum(self.hi[c], self.hi[c + 1])
        return self

    def near(self, q: np.ndarray, bound: np.ndarray):
        """Pairs (row of q, leaf) whose box is within the squared distance ``bound``, in runs of bounded size."""
        bound = bound * (1 + SLACK) + SLACK * SLACK * np.einsum("ij,ij->i", q, q)
        stack = [(np.arange(len(q)), np.zeros(len(q), np.int64))]
        while stack:
            row, node = stack.pop()
            if len(row) > FRONTIER:
                half = len(row) // 2
                stack += [(row[:half], node[:half]), (row[half:], node[half:])]
                continue
            at = q[row]
            gap = np.maximum(self.lo[node] - at, at - self.hi[node])
            np.maximum(gap, 0, out=gap)
            keep = (self.size[node] > 0) & (np.einsum("ij,ij->i", gap, gap) <= bound[row])
            row, node = row[keep], node[keep]
            end = self.left[node] < 0
            if end.any():
                yield row[end], self.leaf[node[end]]
            row, node = row[~end], self.left[node[~end]]
            if len(row):
                stack.append((np.concatenate([row, row]), np.concatenate([node, node + 1])))


def give_back() -> None:
    """Return freed memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _least(rows, points, exact, k, tid, label):
    """The first k candidates of each row, by distance, id and label."""
    order = np.lexsort((label[points], tid[points], exact, rows))
    rows, points, exact = rows[order], points[order], exact[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], points[keep], exact[keep]


def _between(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Exact squared distances, coordinate by coordinate."""
    out = np.zeros((len(q), len(t)))
    for j in range(q.shape[1]):
        gap = q[:, j, None] - t[None, :, j]
        gap *= gap
        out += gap
    return out


def search(q: np.ndarray, t: np.ndarray, tid: np.ndarray, label: np.ndarray, k: int, bound: np.ndarray):
    """``(row of q, row of t, squared distance)`` of the k nearest rows of t by distance, id and label;
    rows beyond the squared distance ``bound`` may be missing."""
    order = np.lexsort((label, tid))  # equal distances then come in the order of their ties
    t, tid, label = t[order], tid[order], label[order]
    tree = Boxes(t, max(LEAF_ROWS, 2 * k), min(k, 8))
    leaf_rows = [np.sort(tree.rows[a:b]) for a, b in zip(tree.first[:-1], tree.first[1:], strict=True)]
    tree.fill(np.diff(tree.first), np.array([t[r].min(axis=0) for r in leaf_rows]), np.array([t[r].max(axis=0) for r in leaf_rows]))
    bound = bound.copy()

    def runs(row, leaf):
        """Rows that visit a leaf, a bounded number at a time."""
        by = np.argsort(leaf, kind="stable")
        row, leaf = row[by], leaf[by]
        cut = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(leaf)], strict=True):
            own = leaf_rows[leaf[a]]
            step = max(1, ENTRIES // len(own))
            for s in range(a, b, step):
                yield row[s:min(s + step, b)], own

    for row, own in runs(np.arange(len(q)), tree.leaf_of(q)):  # the own leaf bounds the k-th distance
        if len(own) >= k:
            d = _between(q[row], t[own])
            bound[row] = np.minimum(bound[row], np.partition(d, k - 1, axis=1)[:, k - 1])
    rows, points, exact, held = [], [], [], 0

    def settle():
        nonlocal rows, points, exact, held
        best = _least(np.concatenate(rows), np.concatenate(points), np.concatenate(exact), k, tid, label)
        rows, points, exact = ([b] for b in best)
        held = len(best[0])

    limit = max(ENTRIES, 4 * k * len(q))
    for pairs in tree.near(q, bound):
        for row, own in runs(*pairs):
            d = _between(q[row], t[own])
            hit = d <= bound[row, None]
            many = np.flatnonzero(hit.sum(axis=1) > k)
            if len(many):
                far = np.argsort(d[many], axis=1, kind="stable")[:, k:]
                hit[many[:, None], far] = False
            r, c = np.nonzero(hit)
            rows.append(row[r]), points.append(own[c]), exact.append(d[r, c])
            held += len(r)
            if held > limit:
                settle()
    if not rows:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    settle()
    return rows[0], order[points[0]], exact[0]
