"""Exact regression trees and forests.

Every split is the best of all: for each feature the distinct values of a node in
order, prefix sums of counts and labels, and the score ``SL^2/nL + SR^2/nR`` (least
squared error) after each value; ties go to the first feature, then the lowest
value; the threshold is the midpoint to the next value. Nothing is binned.

Rows are stored once, as compressed columns in blocks; without draws, rows of equal
features and label are one row with its weight. Nodes of more than ``local_rows``
train rows are split level by level on the executors: bins per (node, feature), counted
in the tasks, of which only those that can hold the best split are looked into (a node
of any size spans many tasks). Tasks find the node of a row by the splits so far, which
are broadcast, so a level writes no rows. Smaller nodes are finished in one task each,
down to pure leaves, by the same rule in numpy, after one shuffle of the rows. That
bounds memory: a task holds ``local_rows`` train rows and as many test rows (some 200 MB
at the defaults), whatever the depth, and the number of distributed levels follows from
the rows, not from the depth.

The rows of a forest are weighted by Poisson(1) counts from a hash of (seed, tree,
row): bootstrap samples that any recomputation draws again. While all rows fit a task
(``PACKED`` numbers, 4 M rows of six features), they are packed and broadcast once,
and tasks grow whole trees from them; rows of equal features are one cell there, with
their weight and sum of labels. A larger forest grows its trees together by levels, each
tree from a root of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.boxes import give_back
from quarry.session import cut_lineage

LOCAL_ROWS = 500_000
FITTED = "rid long, label double, prediction double"


# --- the exact tree of rows that fit a task ---------------------------------------------------

REPACK = 3  # levels until the open cells are moved together again
RUN = 1 << 17  # cells whose cuts are scored at once, or one node


def _coded(x) -> tuple[list[np.ndarray], np.ndarray]:
    """Per feature its values in order, and for every row the numbers of its values."""
    values, codes = [], np.empty((len(x), len(x[0])), np.int32)
    for f, column in enumerate(x):
        told, codes[f] = np.unique(column, return_inverse=True)
        values.append(told)
    return values, codes


def _cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal features go the same way in every tree: a row of each such cell, and the cell of every row."""
    key, span = np.zeros(codes.shape[1], np.int64), 1
    for c in codes:
        many = int(c.max(initial=0)) + 1
        if span * many >= 1 << 62:
            told, key = np.unique(key, return_inverse=True)
            span = len(told)
        key = key * many + c
        span *= many
    _, first, cell = np.unique(key, return_index=True, return_inverse=True)
    return first, cell


def _by_key(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` in the order of ``key``."""
    bits = len(rows).bit_length()
    if int(key.max()) >> (62 - bits):
        return rows.take(np.argsort(key, kind="stable"))
    key = (key << bits) + np.arange(len(rows))
    key.sort()
    return rows.take(key & ((1 << bits) - 1))


def _scan(code, sums, start, node, n, s):
    """Best cut of every node by one feature, whose values stand by node, then in order: nodes that have one,
    score, the value below and the value above it. ``sums``: weight + i * labels."""
    edge = code[1:] != code[:-1]
    edge[start[1:] - 1] = False
    here = np.flatnonzero(edge)
    if not len(here):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0), none, none
    run = np.cumsum(sums)
    of = node.take(here)
    left = run.take(here) - np.r_[0, run[start[1:] - 1]].take(of)
    nl, sl = left.real.copy(), left.imag.copy()
    score = _score(nl, sl, n.take(of), s.take(of))
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    top = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(of)])))
    at = of.take(hit)
    hit = here.take(hit[np.r_[True, at[1:] != at[:-1]]])  # the lowest value
    return of.take(first), top, code.take(hit), code.take(hit + 1)


def grow_cells(codes: np.ndarray, values: list[np.ndarray], n: np.ndarray, s: np.ndarray,
               depth: int | None = None) -> dict[str, np.ndarray]:
    """An exact tree, level by level: arrays ``feature`` (-1: leaf), ``cut``, ``left`` (right is next to it), ``value``.

    ``codes`` (features x cells), with their weights and sums of labels. A feature is summed up by its values while
    these are few beside the cells of a node; then its cells are sorted once, and divided with the nodes."""
    k, held = codes.shape
    spans = [int(c.max()) + 1 for c in codes]
    sums, mean = n + 1j * s, s / n
    rows, order = np.arange(held), [None] * k  # cells by node; by node and value of a feature
    sizes, weight, total = np.array([held]), np.array([n.sum()]), np.array([s.sum()])
    value, splits = [total / weight], []
    names, made, level, old = np.zeros(1, np.int64), 1, 0, 0
    if depth == 0 or mean.min() == mean.max():
        sizes = sizes[:0]
    while len(sizes):
        nodes, open_ = len(sizes), len(rows)
        start = np.cumsum(sizes) - sizes
        node = np.repeat(np.arange(nodes), sizes)
        best, feature = np.full(nodes, -np.inf), np.full(nodes, -1)
        low, high = np.zeros((2, nodes), np.int64)
        counted = [nodes * span <= open_ // 2 for span in spans]
        for f, span in enumerate(spans):
            if not counted[f] and order[f] is None:
                order[f] = _by_key(node * span + codes[f].take(rows), rows).astype(np.int32)
        runs = np.flatnonzero(np.r_[True, start[1:] // RUN != start[:-1] // RUN, True])
        for a, b in zip(runs[:-1], runs[1:], strict=True):  # some nodes at a time
            p, q = start[a], start[b - 1] + sizes[b - 1]
            own, place = rows[p:q], node[p:q] - a
            own_n, own_s = (n.take(own), s.take(own)) if any(counted) else (None, None)
            for f, span in enumerate(spans):
                if counted[f]:
                    key = place * span + codes[f].take(own)
                    got = np.bincount(key, own_n, (b - a) * span)
                    some = np.flatnonzero(got)
                    both = got.take(some) + 1j * np.bincount(key, own_s, (b - a) * span).take(some)
                    of = some // span
                    found = _scan(some - of * span, both, np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), of, weight[a:b], total[a:b])
                else:
                    at = order[f][p:q].astype(np.int64)
                    found = _scan(codes[f].take(at), sums.take(at), start[a:b] - p, place, weight[a:b], total[a:b])
                at, top, lo, hi = found
                at = at + a
                better = top > best[at]
                at = at[better]
                best[at], feature[at], low[at], high[at] = top[better], f, lo[better], hi[better]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        splits.append((names[split], feature[split], low[split], high[split], made + 2 * np.arange(len(split))))
        side = (codes.reshape(-1).take((np.maximum(feature, 0) * held).take(node) + rows) > low.take(node)).astype(np.int8)
        if len(split) < nodes:
            side[(feature < 0).take(node)] = 2
        l, r = side == 0, side == 1
        children = np.r_[np.bincount(np.compress(l, node), minlength=nodes)[split], np.bincount(np.compress(r, node), minlength=nodes)[split]]
        rows = np.r_[np.compress(l, rows), np.compress(r, rows)]  # all left children, then all right ones
        first = np.cumsum(children) - children
        part = np.add.reduceat(sums.take(rows), first)
        level += 1
        means = mean.take(rows)
        # a node of one mean predicts the same however it is split
        go_on = (np.minimum.reduceat(means, first) < np.maximum.reduceat(means, first)) & (depth is None or level < depth)
        keep = np.repeat(go_on, children)
        lefts = np.count_nonzero(keep[:np.count_nonzero(l)])
        rows = np.compress(keep, rows)
        side = np.full(held, 2, np.int8)
        side[rows[:lefts]], side[rows[lefts:]] = 0, 1
        for f in range(k):
            if order[f] is not None:
                at = side.take(order[f].astype(np.int64))
                order[f] = np.r_[np.compress(at == 0, order[f]), np.compress(at == 1, order[f])]
        name = np.r_[splits[-1][4], splits[-1][4] + 1]
        value.append(np.empty(len(name)))
        value[-1][name - made] = part.imag / part.real
        made += len(name)
        sizes, weight, total, names = children[go_on], part.real[go_on], part.imag[go_on], name[go_on]
        old += 1
        if old >= REPACK and len(rows):
            place = np.empty(held, np.int32)
            place[rows] = np.arange(len(rows), dtype=np.int32)
            for f in range(k):
                if order[f] is not None:
                    order[f] = place.take(order[f].astype(np.int64))
            codes = np.take(codes, rows, axis=1)
            n, s, mean = n.take(rows), s.take(rows), mean.take(rows)
            sums = n + 1j * s
            held, rows, old = len(rows), np.arange(len(rows)), 0
    tree = {"feature": np.full(made, -1), "cut": np.zeros(made), "left": np.full(made, -1), "value": np.concatenate(value)}
    for at, feature, low, high, left in splits:
        tree["feature"][at], tree["left"][at] = feature, left
        for f in np.unique(feature):
            own = feature == f
            v, up = values[f][low[own]], values[f][high[own]]
            mid = (v + up) / 2
            tree["cut"][at[own]] = np.where(mid >= up, v, mid)
    return tree


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int | None = None) -> dict[str, np.ndarray]:
    """The tree of weighted rows ``x``."""
    values, codes = _coded(x.T)
    first, cell = _cells(codes)
    return grow_cells(codes[:, first], values, np.bincount(cell, w), np.bincount(cell, w * y), depth)


def _descend(tree: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where rows ``x`` (features x rows) come to in a tree from their nodes ``at``."""
    many, flat, go = x.shape[1], x.reshape(-1), np.arange(x.shape[1])
    while len(go):
        here = at.take(go)
        f = tree["feature"].take(here)
        inner = f >= 0
        go, here, f = (np.compress(inner, a) for a in (go, here, f))
        at[go] = tree["left"].take(here) + (flat.take(f * many + go) > tree["cut"].take(here))
    return at


def walk(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Predictions of a grown tree."""
    return tree["value"].take(_descend(tree, np.ascontiguousarray(x.T), np.zeros(len(x), np.int64)))


# --- rows as compressed columns -----------------------------------------------------------------

PACK_ROWS = 1 << 18
BLOCKS = "part int, seq int, many int, blobs array<binary>"


def _packed(columns) -> list[bytes]:
    return [pa.compress(np.ascontiguousarray(c).tobytes(), codec="zstd", asbytes=True) for c in columns]


def _column(blob, many: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, many * np.dtype(kind).itemsize, codec="zstd"), kind)


def _columns(names: list[str]):
    """A task's rows in blocks of some PACK_ROWS: compressed columns."""
    def run(batches):
        from pyspark import TaskContext

        part, held, many, seq = TaskContext.get().partitionId(), [], 0, 0

        def block():
            blobs = _packed(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([many], pa.int32()), pa.array([blobs], pa.list_(pa.binary()))],
                ["part", "seq", "many", "blobs"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= PACK_ROWS:
                yield block()
                held, many, seq = [], 0, seq + 1
        if many:
            yield block()
    return run


def _blocks(batch, features: int):
    """Blocks of a batch: features (x rows), labels, row numbers, weights (0: no train row), numbers of test rows."""
    for many, blobs in zip(batch.column("many").to_pylist(), batch.column("blobs"), strict=True):
        blobs = [b.as_buffer() for b in blobs.values]
        x = np.stack([_column(b, many) for b in blobs[:features]])
        y, rid, w, tests = (_column(b, many, kind) for b, kind in zip(blobs[features:], (np.float64, np.int64, np.float64, np.float64), strict=True))
        yield x, y, rid, w, tests


def _drawn(tree: int, seed: int | None, rid: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights of rows in a tree (``seed`` None: no draws)."""
    return w if seed is None else np.where(w > 0, poisson(seed, tree, rid), 0.0)


# --- a small node, in a task ------------------------------------------------------------------

def _finish(features: int, depth: int | None, levels: list[int], small: list[bool], values: list[float]):
    """Grow the rest of a small node from its train rows and predict a block of its test rows; a leaf's are known."""
    def run(key, parts):
        node = key[0].as_py()
        blocks = [block for batch in parts.to_batches() for block in _blocks(batch, features)]
        del parts
        x = np.concatenate([block[0] for block in blocks], axis=1)
        y, rid, w, tests = (np.concatenate([block[i] for block in blocks]) for i in range(1, 5))
        del blocks
        asked = np.flatnonzero(tests > 0)
        if small[node] and len(asked):
            fit = np.flatnonzero(w > 0)
            guess = walk(grow(x[:, fit].T, y[fit], w[fit], None if depth is None else depth - levels[node]), x[:, asked].T)
        else:
            guess = np.full(len(asked), values[node])
        del x
        give_back()
        asked = np.repeat(np.arange(len(asked)), tests[asked].astype(np.int64)), asked
        return pa.Table.from_arrays([pa.array(a.take(asked[1]).take(asked[0])) for a in (rid, y)] + [pa.array(guess.take(asked[0]))],
                                    ["rid", "label", "prediction"])
    return run


# --- large nodes, on the executors -----------------------------------------------------------

class _Bins:
    """Bins of equal width, level under level: ``steps`` holds per level the least value and the scale of each
    interval, the number of its bins, and which interval of the next level a bin is (-1: none)."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, bins: int):
        self.steps: list = []
        self._open(lo.ravel(), hi.ravel(), bins)

    @classmethod
    def of(cls, steps: list) -> _Bins:
        """Bins from their steps (a broadcast holds these: executors need not have this class)."""
        bins = cls.__new__(cls)
        bins.steps = steps
        return bins

    def _open(self, lo, hi, bins):
        with np.errstate(over="ignore", divide="ignore"):
            scale = np.where(hi > lo, bins / (hi - lo), 0.0)
        self.steps.append([lo, np.where(np.isfinite(scale), scale, 0.0), bins, None])

    def narrow(self, chosen: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int | None):
        """Go on with the ``chosen`` bins, cut into ``bins`` (None: not cut again)."""
        last = self.steps[-1]
        last[3] = np.full(len(last[0]) * last[2], -1, np.int64)
        last[3][chosen] = np.arange(len(chosen))
        if bins is not None:
            self._open(lo, hi, bins)

    def place(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Number of the innermost bin of each value in its interval ``at``; -1 if it lies in none."""
        at = at.copy()
        for lo, scale, bins, inner in self.steps:
            ok = np.flatnonzero(at >= 0)
            i = at[ok]
            bin_ = np.clip(np.floor((v[ok] - lo[i]) * scale[i]), 0, bins - 1).astype(np.int64) + i * bins
            at[ok] = bin_ if inner is None else inner[bin_]
        return at


BINS = 1 << 18  # of a pass, each a row for the driver
NODES = 2048  # split in one pass
DIRECT = 200_000  # rows of a bin whose values are taken one by one
BINNED = "bin long, rows long, n double, s double, ylo double, yhi double, vlo double, vhi double"


def _values(batch, features: int, tree: dict | None):
    """Per feature the intervals (node, feature), values, labels and weights of the train rows of a batch."""
    if tree is None:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T
        g, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "y", "w"))
        parts = [(g.astype(np.int64), x, y, w.astype(np.float64))]
    else:
        parts = _placed(batch, features, tree)
    for g, x, y, w in parts:
        for f in range(features):
            yield g * features + f, np.ascontiguousarray(x[f]), y, w


def _placed(batch, features: int, tree: dict):
    """Train rows of the nodes that have a ``number``, which the trees grown so far tell."""
    for x, y, rid, w, _ in _blocks(batch, features):
        fit = np.flatnonzero(w > 0)
        if len(fit) < len(w):
            x, y, rid, w = x[:, fit], y[fit], rid[fit], w[fit]
        for t in range(tree["trees"]):
            own = _drawn(t, tree["seed"], rid, w)
            g = tree["number"].take(_descend(tree, x, np.full(len(y), t)))
            some = np.flatnonzero((g >= 0) & (own > 0))
            if len(some) == len(g):
                yield g, x, y, own
            elif len(some):
                yield g[some], x[:, some], y[some], own[some]


def _histogram(told, features: int):
    """Rows, labels, and the limits of labels and values of every bin of a task's rows."""
    def run(batches):
        bins, tree = _Bins.of(told.value["steps"]), told.value["tree"]
        many = len(bins.steps[-1][0]) * bins.steps[-1][2]
        rows, n, s = np.zeros((3, many))
        low, high = np.full((2, many), np.inf), np.full((2, many), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, v, y, w in _values(batch, features, tree):
                at = bins.place(at, v)
                ok = at >= 0
                if not ok.all():
                    at, v, y, w = at[ok], v[ok], y[ok], w[ok]
                np.add.at(rows, at, 1.0)
                np.add.at(n, at, w)
                np.add.at(s, at, w * y)
                for i, values in enumerate((y, v)):
                    np.minimum.at(low[i], at, values)
                    np.maximum.at(high[i], at, values)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
            some, rows[some].astype(np.int64), n[some], s[some], low[0][some], high[0][some], low[1][some], high[1][some])],
            ["bin", "rows", "n", "s", "ylo", "yhi", "vlo", "vhi"])
    return run


def _inside(told, features: int):
    """Values that lie in the chosen bins, with their bin."""
    def run(batches):
        bins, tree = _Bins.of(told.value["steps"]), told.value["tree"]
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, v, y, w in _values(batch, features, tree):
                at = bins.place(at, v)
                ok = np.flatnonzero(at >= 0)
                if len(ok):
                    yield pa.RecordBatch.from_arrays([pa.array(at[ok]), pa.array(v[ok]), pa.array(w[ok]), pa.array(w[ok] * y[ok])],
                                                     ["bin", "v", "w", "wy"])
    return run


COUNTED = 1 << 16  # bins of a feature that are counted in one pass


def bin_counts(df: DataFrame, features: list[str], bins: int) -> list[list[tuple[float, float, float]]]:
    """Per feature its values in order, as ``(least, greatest, rows)`` of fine bins, counted over all rows.

    A bin is cut again while it holds more than a sixteenth of the rows that one of ``bins`` would, or while there
    are no more than ``bins`` of them; a bin of one value stays. The driver holds at most some COUNTED bins a pass and feature."""
    k = len(features)
    cols = [F.col(c).cast("double") for c in features]
    ends = df.agg(F.count(F.lit(1)), *[f(c) for c in cols for f in (F.min, F.max)]).first()
    found: list = [[] for _ in features]
    if not ends[0]:
        return found
    rows = df.select(F.lit(0).alias("g"), F.array(*cols).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"))
    width = COUNTED
    placed = _Bins(np.array([ends[1 + 2 * i] for i in range(k)]), np.array([ends[2 + 2 * i] for i in range(k)]), width)
    owner = np.arange(k)
    while len(owner):
        told = df.sparkSession.sparkContext.broadcast({"steps": placed.steps, "tree": None})
        t = rows.mapInArrow(_histogram(told, k), BINNED).groupBy("bin").agg(
            F.sum("n").alias("n"), F.min("vlo").alias("lo"), F.max("vhi").alias("hi")).toPandas()
        number, n, lo, hi = (t[c].to_numpy() for c in ("bin", "n", "lo", "hi"))
        own = owner[number // width]
        many = np.array([len(f) for f in found]) + np.bincount(own, minlength=k)
        again = (lo < hi) & ((n * bins * 16 > ends[0]) | (many[own] <= bins))
        for f, a, b, m in zip(own[~again], lo[~again], hi[~again], n[~again], strict=True):
            found[f].append((float(a), float(b), float(m)))
        if again.any():
            # a feature has at most 16 * bins of these
            width = max(16, COUNTED // int(np.bincount(own[again]).max()))
            placed.narrow(number[again], lo[again], hi[again], width)
        owner = own[again]
    return [sorted(f) for f in found]


def _score(nl, sl, n, s):
    return sl * sl / nl + (s - sl) * (s - sl) / (n - nl)


def _greatest(n, s, nl, sl, bn, bs, ylo, yhi):
    """An upper bound of the score of every split inside a bin of ``bn`` rows after ``nl`` others. Its splits have
    (rows, labels) in a parallelogram, as each row adds a label from ylo to yhi, and all of them bs; the score is
    convex, so a corner has the most."""
    with np.errstate(divide="ignore", invalid="ignore"):
        # j rows of the least and bn - j of the greatest label make up bs
        j = np.where(yhi > ylo, (bn * yhi - bs) / (yhi - ylo), bn)
        found = np.full(len(bn), -np.inf)
        for m, t in ((0, 0), (bn, bs), (j, j * ylo), (bn - j, (bn - j) * yhi)):
            at, of = nl + m, sl + t
            score = np.where(at > 0, of * of / at, np.where(of == 0, 0.0, np.inf))
            rest = n - at
            score = score + np.where(rest > 1e-9 * n, (s - of) ** 2 / rest, np.where(np.abs(s - of) <= 1e-9 * np.abs(s), 0.0, np.inf))
            found = np.maximum(found, score)
    return found


def best_splits(rows: DataFrame, nodes: list, features: int) -> list[tuple]:
    """The best split ``(g, f, cut)`` of every node that some feature can split.

    ``rows(g, x, y, w)``; ``nodes``: per g its weight, sum of labels, and least and greatest value of each feature.
    Bins of each feature give the scores of the splits at their ends, exactly, and an upper bound of those inside
    (:func:`_greatest`). Only bins whose bound reaches the best score found are looked into: cut again while
    they hold more than ``DIRECT`` rows, then value by value. Nothing but bins and the values of the last few is shuffled."""
    found = []
    for a in range(0, len(nodes), NODES):
        part = rows if len(nodes) <= NODES else rows.where(F.col("g").between(a, a + NODES - 1)).withColumn("g", F.col("g") - a)
        best, _ = _best_of(part, nodes[a:a + NODES], features)
        found += [(g + a, b[0], b[1]) for g, b in best.items()]
    return found


def _best_of(rows: DataFrame, nodes: list, features: int, tree: dict | None = None, least_rows: int = 0) -> tuple[dict, dict]:
    """Per node its best split ``(f, cut, value below, value above, weight and labels left)``, and per node its number
    of rows and the limits of its labels. ``tree``: where rows have no ``g``, the trees grown so far, which tell it.
    Nodes of ``least_rows`` or fewer, or of one label, are not split."""
    context = rows.sparkSession.sparkContext
    n_all, s_all = (np.repeat([float(node[i]) for node in nodes], features) for i in (0, 1))
    lo, hi = (np.array([node[i] for node in nodes], float) for i in (2, 3))
    many = len(nodes) * features
    best: dict = {}  # per node: score, -feature, -value, next value, weight and labels left
    seen: dict = {}

    def offer(g, score, f, v, up, nl, sl):
        key = (score, -f, -v, up, nl, sl)
        if g not in best or key[:3] > best[g][:3]:
            best[g] = key

    width = int(np.clip(BINS // many, 16, 1024))
    bins = _Bins(lo, hi, width)
    owner, base_n, base_s = np.arange(many), np.zeros(many), np.zeros(many)  # of each interval
    direct: list = []  # bins of few rows that may hold the best: their _Bins, numbers, owners, base
    while len(owner):
        told = context.broadcast({"steps": bins.steps, "tree": tree})
        t = (rows.mapInArrow(_histogram(told, features), BINNED).groupBy("bin").agg(
            F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("ylo").alias("ylo"), F.max("yhi").alias("yhi"),
            F.min("vlo").alias("vlo"), F.max("vhi").alias("vhi")).toPandas().sort_values("bin"))  # at most some BINS rows
        at = t["bin"].to_numpy() // width
        if not seen:
            first = t[owner[at] % features == 0].assign(g=owner[at][owner[at] % features == 0] // features)
            first = first.groupby("g").agg({"rows": "sum", "ylo": "min", "yhi": "max"})
            seen = {int(g): (int(r), lo_, hi_) for g, r, lo_, hi_ in first.itertuples()}
            open_ = np.array([g in seen and seen[g][0] > least_rows and seen[g][1] < seen[g][2] for g in range(len(nodes))])
            t = t[open_[owner[at] // features]]
            at = t["bin"].to_numpy() // width
            if not len(t):
                break
        n, s, ylo, yhi, vlo, vhi = (t[c].to_numpy() for c in ("n", "s", "ylo", "yhi", "vlo", "vhi"))
        start = np.searchsorted(at, at)
        before_n, before_s = np.cumsum(n) - n, np.cumsum(s) - s
        before_n = base_n[at] + before_n - before_n[start]
        before_s = base_s[at] + before_s - before_s[start]
        own = owner[at]
        score = np.full(len(n), -np.inf)
        edge = np.flatnonzero(at[:-1] == at[1:])  # the next bin tells the next value
        score[edge] = _score(before_n[edge] + n[edge], before_s[edge] + s[edge], n_all[own[edge]], s_all[own[edge]])
        for i in edge[score[edge] >= np.maximum.reduceat(score, np.flatnonzero(np.r_[True, at[1:] != at[:-1]]))[
                np.cumsum(np.r_[0, at[1:] != at[:-1]])[edge]]]:
            offer(int(own[i]) // features, score[i], int(own[i]) % features, vhi[i], vlo[i + 1], before_n[i] + n[i], before_s[i] + s[i])
        bound = _greatest(n_all[own], s_all[own], before_n, before_s, n, s, ylo, yhi)
        least = np.array([best[g][0] if g in best else -np.inf for g in own // features])
        # inside a bin there is a split if it has two values; rounding must lose none
        alive = np.flatnonzero((vlo < vhi) & (bound >= least - 1e-9 * np.abs(least)))
        number, held = t["bin"].to_numpy(), t["rows"].to_numpy()
        few = alive[held[alive] <= DIRECT]
        if len(few):
            last = _Bins.of([list(step) for step in bins.steps])
            last.narrow(number[few], None, None, None)
            direct.append((last, own[few], before_n[few], before_s[few]))
        more = alive[held[alive] > DIRECT]
        if len(more):
            width = int(np.clip(BINS // len(more), 16, 1024))
            bins.narrow(number[more], vlo[more], vhi[more], width)
        owner, base_n, base_s = own[more], before_n[more], before_s[more]
    for last, own, before_n, before_s in direct:
        told = context.broadcast({"steps": last.steps, "tree": tree})
        base = rows.sparkSession.createDataFrame(
            [(i, int(o), float(p), float(q), float(n_all[o]), float(s_all[o]))
             for i, (o, p, q) in enumerate(zip(own, before_n, before_s, strict=True))],
            "bin long, own long, bn double, bs double, n double, s double")
        order = Window.partitionBy("bin").orderBy("v")
        run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        split = (rows.mapInArrow(_inside(told, features), "bin long, v double, w double, wy double")
                 .groupBy("bin", "v").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
                 .select("bin", "v", F.lead("v").over(order).alias("up"), F.sum("w").over(run).alias("nl"), F.sum("wy").over(run).alias("sl"))
                 .where("up is not null").join(F.broadcast(base), "bin")  # at most some BINS rows
                 .withColumns({"nl": F.col("nl") + F.col("bn"), "sl": F.col("sl") + F.col("bs")}))
        score = _score(F.col("nl"), F.col("sl"), F.col("n"), F.col("s"))
        for r in split.groupBy(F.expr(f"own div {features}").alias("g")).agg(F.max(F.struct(
                score.alias("score"), (-(F.col("own") % features)).alias("f"), (-F.col("v")).alias("v"), "up", "nl", "sl")).alias("b")).collect():
            offer(r.g, r.b.score, -r.b.f, -r.b.v, r.b.up, r.b.nl, r.b.sl)
    out = {}
    for g, (_, f, v, up, nl, sl) in best.items():
        v = -v
        mid = (v + up) / 2
        out[g] = (-f, float(v if mid >= up else mid), float(v), float(up), float(nl), float(sl))
    return out, seen


class _Top:
    """The large nodes of some trees, on the driver: one entry for each node, the roots first."""

    def __init__(self, roots: list, seed: int | None):
        """``roots``: per tree its weight, sum of labels, and least and greatest value of each feature."""
        self.trees, self.seed = len(roots), seed
        self.feature, self.cut, self.left, self.level = [-1] * len(roots), [0.0] * len(roots), [-1] * len(roots), [0] * len(roots)
        self.stats = list(roots)
        self.small = [False] * len(roots)  # to be finished in a task

    def arrays(self) -> dict:
        return {"feature": np.array(self.feature), "cut": np.array(self.cut), "left": np.array(self.left),
                "trees": self.trees, "seed": self.seed}

    def split(self, node: int, f: int, cut: float, v: float, up: float, nl: float, sl: float) -> list[int]:
        n, s, lo, hi = self.stats[node]
        self.feature[node], self.cut[node], self.left[node] = f, cut, len(self.feature)
        self.stats += [(nl, sl, lo, [v if i == f else h for i, h in enumerate(hi)]),
                       (n - nl, s - sl, [up if i == f else a for i, a in enumerate(lo)], hi)]
        for of, what in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.level, self.level[node] + 1), (self.small, False)):
            of += [what, what]
        return [self.left[node], self.left[node] + 1]

    def grow(self, rows: DataFrame, features: int, max_depth: int | None, local_rows: int) -> None:
        """Split nodes of more than ``local_rows`` train rows, a level at a time. No row is stored anew: tasks find
        its node by the splits so far, and a level is as many passes as its bins need."""
        asked = list(range(len(self.feature)))
        while asked:
            go_on = []
            for node in asked:
                n, deep = self.stats[node][0], max_depth is not None and self.level[node] >= max_depth
                self.small[node] = not deep and 0 < n <= local_rows  # a train row weighs 1 or more
                if n > local_rows and not deep:
                    go_on.append(node)
            asked = []
            tree = self.arrays()
            for a in range(0, len(go_on), NODES):
                own = go_on[a:a + NODES]
                tree["number"] = np.full(len(self.feature), -1)
                tree["number"][own] = np.arange(len(own))
                best, seen = _best_of(rows, [self.stats[node] for node in own], features, dict(tree), local_rows)
                for g, node in enumerate(own):
                    if seen[g][0] <= local_rows:
                        self.small[node] = True
                    elif g in best:
                        asked += self.split(node, *best[g])


# --- a forest whose rows fit a task ---------------------------------------------------------

PACKED = 1 << 25  # numbers (features, label, row) that a task of a forest holds
TREES = 3  # grown by one task, and fewer by the last ones
BLOCK = 1 << 16  # cells whose predictions are added up together


def poisson(seed: int, tree: int, rid: np.ndarray) -> np.ndarray:
    """The bootstrap weights that :func:`fit_predict` draws with Spark's xxhash64 of (seed, tree, row)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v, by):
        return (v << np.uint64(by)) | (v >> np.uint64(64 - by))

    def mixed(v):
        v = (v ^ (v >> np.uint64(33))) * p2
        v = (v ^ (v >> np.uint64(29))) * p3
        return v ^ (v >> np.uint64(32))

    with np.errstate(over="ignore"):
        found = np.full(1, 42, np.uint64)
        for i in (seed, tree):
            found = found + p5 + np.uint64(4)
            found = mixed(turned(found ^ (np.uint64(i & 0xFFFFFFFF) * p1), 23) * p2 + p3)
        found = (found + p5 + np.uint64(8)) ^ (turned(rid.astype(np.uint64) * p2, 31) * p1)
        found = mixed(turned(found, 27) * p1 + p4)
    u = (found & np.uint64((1 << 53) - 1)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_poisson_steps(), u, side="right").astype(np.float64)


def _poisson_steps() -> list[float]:
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return steps


def _unpacked(told, features: int) -> dict:
    """The forest's data in a worker, unpacked once: cells as numbers of values, cells and labels of the rows.
    Test rows stand in the order of their cells."""
    data = told.value
    if "codes" in data:
        return data
    many, blobs = data["many"], data["blobs"]

    def column(i, kind=np.float64):
        return np.concatenate([_column(b[i], m, kind) for m, b in zip(many, blobs, strict=True)])

    values, codes = [], np.empty((features, sum(many)), np.int32)
    for f in range(features):
        v, codes[f] = np.unique(column(f), return_inverse=True)
        values.append(v)
    first, cell = _cells(codes)
    y, rid, w = column(features), column(features + 1, np.int64), column(features + 2)
    fit, test = np.flatnonzero(w > 0), np.flatnonzero(w == 0)
    test = test[np.argsort(cell[test], kind="stable")]
    asked, place = np.unique(cell[test], return_inverse=True)
    data.clear()
    data.update(codes=np.take(codes, first, axis=1), values=values, cell=cell[fit].astype(np.int32), y=y[fit], rid=rid[fit],
                asked=asked, place=place.astype(np.int32), test_y=y[test], test_rid=rid[test])
    del codes, first, cell, y, rid, w, fit, test, place, blobs
    give_back()
    return data


def _tree_tasks(trees: int) -> list[tuple[int, int]]:
    """Trees of each task: TREES at first, single ones at the end, when other tasks wait for none."""
    tasks, at = [], 0
    while at < trees:
        tasks.append((at, min(trees, at + max(1, min(TREES, (trees - at) // 12)))))
        at = tasks[-1][1]
    return tasks


def _grown(told, features: int, tasks: list[tuple[int, int]], depth: int | None, seed: int):
    """Sums of the predictions of the tests' cells by the trees of each task."""
    def drawn(data, tree):
        w = poisson(seed, tree, data["rid"])
        many = data["codes"].shape[1]
        n = np.bincount(data["cell"], w, many)
        s = np.bincount(data["cell"], w * data["y"], many)
        some = np.flatnonzero(n)
        return np.take(data["codes"], some, axis=1), n[some], s[some]

    def run(batches):
        for batch in batches:
            for task in batch.column("id").to_pylist():
                data = _unpacked(told, features)
                total, count = np.zeros(len(data["asked"])), 0
                for tree in range(*tasks[task]):
                    codes, n, s = drawn(data, tree)
                    if not len(n):  # nothing was drawn
                        continue
                    grown = grow_cells(codes, data["values"], n, s, depth)
                    del codes, n, s
                    for f, values in enumerate(data["values"]):  # cuts as numbers of values
                        own = grown["feature"] == f
                        grown["cut"][own] = np.searchsorted(values, grown["cut"][own], side="right") - 1
                    total += walk(grown, np.take(data["codes"], data["asked"], axis=1).T)
                    count += 1
                    give_back()
                for block in range(-(-len(total) // BLOCK) if count else 0):
                    own = total[block * BLOCK:(block + 1) * BLOCK].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([count], pa.int32()),
                         pa.array([pa.compress(own, codec="zstd", asbytes=True)], pa.binary())], ["block", "task", "trees", "sums"])
    return run


def _averaged(told, features: int):
    """Predictions of the test rows of a block of cells."""
    def run(key, sums):
        data = _unpacked(told, features)
        a = key[0].as_py() * BLOCK
        b = min(a + BLOCK, len(data["asked"]))
        total, sums = np.zeros(b - a), sums.sort_by("task")
        for blob in sums["sums"].to_pylist():
            total += np.frombuffer(pa.decompress(blob, 8 * (b - a), codec="zstd"), np.float64)
        total /= sum(sums["trees"].to_pylist())
        p, q = np.searchsorted(data["place"], [a, b])
        return pa.Table.from_arrays([pa.array(data["test_rid"][p:q]), pa.array(data["test_y"][p:q]),
                                     pa.array(total[data["place"][p:q] - a])], ["rid", "label", "prediction"])
    return run


def _forest(packed: DataFrame, features: int, trees: int, depth: int | None, seed: int) -> DataFrame:
    """A forest on rows that every task holds: they are sent once to each executor, not once for each tree, and a
    task grows whole trees."""
    spark = packed.sparkSession
    blocks = sorted(packed.collect(), key=lambda r: (r.part, r.seq))  # at most some PACKED numbers
    told = spark.sparkContext.broadcast({"many": [r.many for r in blocks], "blobs": [[bytes(b) for b in r.blobs] for r in blocks]})
    del blocks
    tasks = _tree_tasks(trees)
    sums = cut_lineage(spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(
        _grown(told, features, tasks, depth, seed), "block int, task int, trees int, sums binary"))
    return sums.groupBy("block").applyInArrow(_averaged(told, features), FITTED)


# --- a tree or forest of any size -------------------------------------------------------------

def _limits(features: int, trees: int, seed: int | None):
    """Weight, sum of labels, and the limits of the features of a task's rows, for each tree."""
    def run(batches):
        n, s = np.zeros((2, trees))
        lo, hi = np.full((trees, features), np.inf), np.full((trees, features), -np.inf)
        for batch in batches:
            for x, y, rid, w, _ in _blocks(batch, features):
                for t in range(trees):
                    own = _drawn(t, seed, rid, w)
                    some = np.flatnonzero(own > 0)
                    if len(some):
                        n[t] += own.sum()
                        s[t] += (own * y).sum()
                        lo[t], hi[t] = np.minimum(lo[t], x[:, some].min(axis=1)), np.maximum(hi[t], x[:, some].max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees, dtype=np.int32)), pa.array(n), pa.array(s), pa.array(list(lo), pa.list_(pa.float64())),
                                          pa.array(list(hi), pa.list_(pa.float64()))], ["tree", "n", "s", "lo", "hi"])
    return run


def _asked(told, features: int):
    """Number of test rows of each node."""
    def run(batches):
        tree = told.value
        found = np.zeros(len(tree["feature"]), np.int64)
        for batch in batches:
            for x, _, _, _, tests in _blocks(batch, features):
                some = np.flatnonzero(tests > 0)
                for t in range(tree["trees"]):
                    found += np.bincount(_descend(tree, x[:, some], np.full(len(some), t)), minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["node", "n"])
    return run


def _routed(told, features: int):
    """The rows of each block by node and by part of the node's test rows; every part has all its train rows."""
    def run(batches):
        tree = told.value
        for batch in batches:
            for x, y, rid, w, tests in _blocks(batch, features):
                for t in range(tree["trees"]):
                    own = _drawn(t, tree["seed"], rid, w)
                    at = _descend(tree, x, np.full(len(y), t))
                    # leaves need no train rows, and nodes without train rows or test rows nothing
                    some = np.flatnonzero((tree["parts"].take(at) > 0) & ((tests > 0) | (tree["small"].take(at) & (own > 0))))
                    some = some[np.argsort(at[some], kind="stable")]
                    for rows in np.split(some, np.flatnonzero(np.diff(at[some])) + 1):
                        if not len(rows):
                            continue
                        node = at[rows[0]]
                        parts = int(tree["parts"][node])
                        for part in range(parts):
                            here = np.where(rid[rows] % parts == part, tests[rows], 0.0)
                            keep = np.flatnonzero((here > 0) | (own[rows] > 0))
                            if not len(keep):
                                continue
                            r = rows[keep]
                            blobs = _packed([*x[:, r], y[r], rid[r], own[r], here[keep]])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([node], pa.int32()), pa.array([part], pa.int32()), pa.array([len(r)], pa.int32()),
                                 pa.array([blobs], pa.list_(pa.binary()))], ["node", "part", "many", "blobs"])
    return run


def fit_predict(split: DataFrame, features: list[str], label: str = "label", trees: int = 1, bootstrap: bool = False,
                max_depth: int | None = None, seed: int = 5, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Predictions of the rows with ``split = 'test'`` by trees grown on those with ``'train'``:
    ``rid`` (a row number), ``label``, ``prediction`` (the mean over the trees)."""
    k = len(features)
    names = [f"x{i}" for i in range(k)]
    train = F.col("split") == "train"
    rows = split.select(*[F.col(c).cast("double").alias(x) for c, x in zip(features, names, strict=True)], F.col(label).cast("double").alias("y"),
                        train.cast("double").alias("w"), (~train).cast("double").alias("tests"))
    if not bootstrap:  # without draws all trees are one; rows of equal features and label are one row, with its weight
        trees, seed = 1, None
        rows = rows.groupBy(*names, "y").agg(F.sum("w").alias("w"), F.sum("tests").alias("tests"))
    columns = [*names, "y", "rid", "w", "tests"]
    packed = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()).select(*columns).mapInArrow(_columns(columns), BLOCKS))
    if bootstrap and trees > 1 and (packed.agg(F.sum("many")).first()[0] or 0) <= PACKED // (k + 2):
        return _forest(packed, k, trees, max_depth, seed)

    spark = packed.sparkSession
    packed = packed.select("many", "blobs").coalesce(4 * spark.sparkContext.defaultParallelism)  # each task sends its bins
    roots = [[0.0, 0.0, [math.inf] * k, [-math.inf] * k] for _ in range(trees)]
    for r in packed.mapInArrow(_limits(k, trees, seed), "tree int, n double, s double, lo array<double>, hi array<double>").collect():
        n, s, lo, hi = roots[r.tree]
        roots[r.tree] = [n + r.n, s + r.s, [min(a, b) for a, b in zip(lo, r.lo, strict=True)], [max(a, b) for a, b in zip(hi, r.hi, strict=True)]]
    top = _Top(roots, seed)
    top.grow(packed, k, max_depth, local_rows)

    told = spark.sparkContext.broadcast(top.arrays())
    tests = np.zeros(len(top.feature), np.int64)
    for r in packed.mapInArrow(_asked(told, k), "node int, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
        tests[r.node] = r.n
    # test rows beyond ``local_rows`` of a node go to further tasks
    parts = np.where(np.array([n > 0 for n, *_ in top.stats]), -(-tests // local_rows), 0)
    told = spark.sparkContext.broadcast({**top.arrays(), "small": np.array(top.small), "parts": parts})
    out = packed.mapInArrow(_routed(told, k), "node int, part int, many int, blobs array<binary>").groupBy("node", "part").applyInArrow(
        _finish(k, max_depth, top.level, top.small, [s / n if n else 0.0 for n, s, *_ in top.stats]), FITTED)
    if trees > 1:
        return out.groupBy("rid", "label").agg(F.avg("prediction").alias("prediction"))
    return out.withColumn("rid", F.monotonically_increasing_id())
