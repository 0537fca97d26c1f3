"""Exact nearest neighbours over pivot cells.

Train rows belong to the cell of their nearest pivot; a cell knows its size and
the smallest and largest distance of its rows to the pivot. A query first searches
its home cells (the nearest ones that together hold ``k`` rows), which bounds its
k-th distance. A further cell is visited only if its lower bound does not exceed
that distance. For a query q, a pivot p with distances [r, R] of its rows, and the
pivot h nearest to q::

    |q x| >= d(q, p) - R,   r - d(q, p),   (d(q, p)^2 - d(q, h)^2) / (2 d(p, h))

(triangle inequality twice, and the plane between two cells). Bounds get a slack
far above rounding errors, so no neighbour is lost; ties come in by ``<=``.

Work: pivots grow with the square root of the train rows, up to ``MAX_PIVOTS``, so
cells do too. Cells meet their queries in cogroups of at most about ``block_rows``
rows a side; a cell that holds a third of all rows (copies) and a cell that many
queries visit are cut into blocks like any other. Only the ``k`` best rows of a
block leave its task. Pivots and cell statistics (at most MAX_PIVOTS rows) are the
only things that the driver holds; a query is a row, so ids may repeat.

Pivots come from a bounded sample; they decide the work, never the result.

In few dimensions cells are boxes of median cuts instead (``quarry.operators.boxes``):
a row finds its cell, and a query the cells within its k-th distance, in about the
logarithm of their number, cells keep their size as the table grows (up to
``MAX_BOXES``), and a block is searched by boxes of its own.

Of equal train vectors only the ``k`` first by id and label can be neighbours; the rest
is dropped at the start, so copies cost neither work nor memory later.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.boxes import Boxes, give_back, search
from quarry.session import cut_lineage

MAX_PIVOTS = 4096
SAMPLE_PER_PIVOT = 4
FEW_DIMENSIONS = 8  # cells are boxes up to here
MAX_BOXES = 1 << 14
SAMPLE_PER_BOX = 24
SEED = 11
BLOCK_ENTRIES = 2_000_000  # distances, or numbers of candidates, held at a time
SLACK = 1e-6

QUERY = "q_id long, q_row long, q_truth double, q_vec array<double>"
CARRIED = {True: ["q_id", "q_row", "q_truth", "q_vec"], False: ["q_id", "q_row", "q_truth", "q_vec", "kth"]}
FOUND = "qid long, qrow long, truth double, tid long, dist double, label double"


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product; accurate up to the slack."""
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def choose_pivots(train: DataFrame, n: int, count: int) -> np.ndarray:
    """``count`` centres of a seeded sample of at most SAMPLE_PER_PIVOT rows for each."""
    want = count * SAMPLE_PER_PIVOT
    rows = train.sample(False, min(1.0, 1.2 * want / n), SEED).select("vec").limit(want).collect()
    rows = rows or train.select("vec").limit(1).collect()
    points = np.unique(np.array([r.vec for r in rows], np.float64), axis=0)
    pivots = points[np.random.default_rng(SEED).permutation(len(points))[:count]]
    for _ in range(3):
        home = np.concatenate([squared_distances(part, pivots).argmin(axis=1)
                               for part in np.array_split(points, 1 + len(points) * len(pivots) // BLOCK_ENTRIES)])
        held = np.bincount(home, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, home, points)
        pivots = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], pivots)
    return pivots


def choose_boxes(train: DataFrame, n: int, count: int) -> Boxes:
    """Median cuts of a seeded sample of about SAMPLE_PER_BOX rows for each of ``count`` cells."""
    want = count * SAMPLE_PER_BOX
    got = train.sample(False, min(1.0, 1.2 * want / n), SEED).select("vec").limit(want).toPandas()["vec"]
    got = got if len(got) else train.select("vec").limit(1).toPandas()["vec"]
    points = np.stack([np.asarray(v, np.float64) for v in got])
    return Boxes(points, max(1, len(points) // count))


def _deal(boxes):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = boxes.value.leaf_of(_vectors(batch.column("vec"))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("vec"), batch.column("label"), pa.array(cell), pa.nulls(len(cell), pa.float64())],
                    ["t_id", "t_vec", "t_label", "cell", "far"])
    return run


def _assign(pivots):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _vectors(batch.column("vec"))
            cell, far = np.empty(len(vec), np.int32), np.empty(len(vec))
            step = max(1, BLOCK_ENTRIES // len(pivots.value))
            for s in range(0, len(vec), step):
                d = squared_distances(vec[s:s + step], pivots.value)
                cell[s:s + step] = d.argmin(axis=1)
                far[s:s + step] = np.sqrt(d[np.arange(len(d)), cell[s:s + step]])
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("vec"), batch.column("label"), pa.array(cell), pa.array(far)],
                ["t_id", "t_vec", "t_label", "cell", "far"])
    return run


class Cells:
    """Pivots with the size and the distance range of their cells."""

    def __init__(self, pivots: np.ndarray, size: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.pivots, self.size, self.near, self.far = pivots, size, near, far
        self.scale = 1.0 + np.sqrt(np.einsum("ij,ij->i", pivots, pivots)).max()

    def home(self, d: np.ndarray, k: int) -> np.ndarray:
        """Marks of the home cells, from the distances of queries to pivots."""
        d = np.where(self.size > 0, d, np.inf)
        nearest = d.argmin(axis=1)
        marks = np.zeros(d.shape, bool)
        marks[np.arange(len(d)), nearest] = True
        few = np.flatnonzero(self.size[nearest] < k)
        if len(few):
            order = np.argsort(d[few], axis=1, kind="stable")
            held = np.cumsum(self.size[order], axis=1) - self.size[order]
            row, col = np.nonzero(held < k)
            marks[few[row], order[row, col]] = True
        return marks & (self.size > 0)

    def further(self, q: np.ndarray, d: np.ndarray, kth: np.ndarray, k: int) -> np.ndarray:
        """Marks of the cells beyond the home cells that may hold a row within ``kth``."""
        reach = (kth * (1 + SLACK) + SLACK * (self.scale + np.sqrt(np.einsum("ij,ij->i", q, q))))[:, None]
        marks = (d - self.far <= reach) & (self.near - d <= reach) & (self.size > 0) & ~self.home(d, k)
        h = d.argmin(axis=1)
        at, of = np.unique(h, return_inverse=True)
        between = np.sqrt(squared_distances(self.pivots[at], self.pivots))
        row, cell = np.nonzero(marks)  # the plane between two cells only for what is left
        apart = between[of[row], cell]
        plane = (d[row, cell] ** 2 - d[row, h[row]] ** 2) / np.maximum(2 * apart, 1e-300)
        beyond = (apart > SLACK * self.scale) & (plane > reach[row, 0])
        marks[row[beyond], cell[beyond]] = False
        return marks


    def pairs(self, q: np.ndarray, kth: np.ndarray | None, k: int):
        """Pairs (row of q, cell): the home cells, or with the squared k-th distances the further ones."""
        step = max(1, BLOCK_ENTRIES // (4 * len(self.size)))
        for s in range(0, len(q), step):
            d = np.sqrt(squared_distances(q[s:s + step], self.pivots))
            row, cell = np.nonzero(self.home(d, k) if kth is None else self.further(q[s:s + step], d, np.sqrt(kth[s:s + step]), k))
            yield s + row, cell


class BoxCells:
    """Cells that are the leaves of boxes; the home cells of a query are its own leaf, or
    if that holds fewer than ``k`` rows the nearest ones by their boxes."""

    def __init__(self, boxes: Boxes, size: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.boxes, self.size, self.lo, self.hi = boxes.fill(size, lo, hi), size, lo, hi

    def _home(self, q: np.ndarray, k: int):
        own = self.boxes.leaf_of(q)
        full = np.flatnonzero(self.size[own] >= k)
        yield full, own[full]
        few = np.flatnonzero(self.size[own] < k)
        step = max(1, BLOCK_ENTRIES // (q.shape[1] * len(self.size)))
        for s in range(0, len(few), step):
            at = q[few[s:s + step], None]
            gap = np.maximum(np.maximum(self.lo - at, at - self.hi), 0)
            order = np.argsort(np.einsum("ijk,ijk->ij", gap, gap), axis=1, kind="stable")
            held = np.cumsum(self.size[order], axis=1) - self.size[order]
            row, col = np.nonzero((held < k) & (self.size[order] > 0))
            yield few[s + row], order[row, col]

    def pairs(self, q: np.ndarray, kth: np.ndarray | None, k: int):
        if kth is None:
            yield from self._home(q, k)
            return
        cells = len(self.size)
        done = np.sort(np.concatenate([row * cells + cell for row, cell in self._home(q, k)]))
        for row, cell in self.boxes.near(q, kth):
            name = row * cells + cell
            new = done[np.minimum(np.searchsorted(done, name), len(done) - 1)] != name
            yield row[new], cell[new]


def _visits(cells, k: int, first: bool, count: bool):
    """Query rows for each cell they visit, or only how many visit each cell."""
    def run(batches):
        c = cells.value
        total = np.zeros(len(c.size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _vectors(batch.column("q_vec"))
            kth = None if first else batch.column("kth").to_numpy(zero_copy_only=False)
            for row, cell in c.pairs(vec, kth, k):
                total += np.bincount(cell, minlength=len(total))
                if not count:
                    for a in range(0, len(row), 10_000):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(n).take(pa.array(row[a:a + 10_000])) for n in CARRIED[first]]
                            + [pa.array(cell[a:a + 10_000].astype(np.int32))], [*CARRIED[first], "cell"])
        if count:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.flatnonzero(total).astype(np.int32)),
                                              "n": pa.array(total[total > 0])})
    return run


def _best(k: int):
    """As ``_block``; what the allocators keep of a block would add up beside those of other blocks."""
    block = _block(k)

    def run(key, test: pa.Table, train: pa.Table) -> pa.Table:
        out = block(key, test, train)
        give_back()
        return out
    return run


def _block(k: int):
    """The k nearest train rows of a block for every query row of the block."""
    empty = pa.Table.from_pydict({c: pa.array([], t) for c, t in (
        ("qid", pa.int64()), ("qrow", pa.int64()), ("truth", pa.float64()), ("tid", pa.int64()),
        ("dist", pa.float64()), ("label", pa.float64()))})

    def run(key, test: pa.Table, train: pa.Table) -> pa.Table:
        if not test.num_rows or not train.num_rows:
            return empty
        q, t = _vectors(test["q_vec"]), _vectors(train["t_vec"])
        tid, label = train["t_id"].to_numpy(), train["t_label"].to_numpy()
        out = []

        def found(rows, cols, exact):
            of = test.select(["q_id", "q_row", "q_truth"]).take(pa.array(rows))
            out.append(pa.Table.from_arrays(
                [*of.columns, pa.array(tid[cols]), pa.array(exact), pa.array(label[cols])], empty.column_names))

        if q.shape[1] <= FEW_DIMENSIONS:
            kth = test["kth"].to_numpy(zero_copy_only=False) if "kth" in test.column_names else np.full(len(q), np.inf)
            found(*search(q, t, tid, label, k, kth))
            return pa.concat_tables(out)
        kk = min(k, len(t))
        norm = np.einsum("ij,ij->i", t, t).max()
        step = max(1, BLOCK_ENTRIES // len(t))
        for s in range(0, len(q), step):
            qs = q[s:s + step]
            fast = squared_distances(qs, t)
            # every true neighbour is among the candidates within the rounding error of `fast`
            tol = 1e-9 * (np.einsum("ij,ij->i", qs, qs) + norm) + 1e-12
            kth = np.partition(fast, kk - 1, axis=1)[:, kk - 1]
            near = fast <= (kth + tol)[:, None]
            del fast
            # queries whose candidates together hold a bounded number of components; a query has at most len(t) candidates
            filled = np.cumsum(near.sum(axis=1)) * q.shape[1] // BLOCK_ENTRIES
            first = np.flatnonzero(np.r_[True, filled[1:] != filled[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(qs)], strict=True):
                rows, cols = np.nonzero(near[a:b])
                diff = qs[a + rows]
                diff -= t[cols]
                exact = np.einsum("ij,ij->i", diff, diff)
                del diff
                order = np.lexsort((label[cols], tid[cols], exact, rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < kk
                found(s + a + rows[keep], cols[keep], exact[keep])
        return pa.concat_tables(out)
    return run


def _meet(queries: DataFrame, visits: dict, train: DataFrame, cells: Cells | BoxCells, k: int, block_rows: int) -> DataFrame:
    """The k best rows of every block of a cell for each query that visits the cell."""
    shape = [(c, math.ceil(int(cells.size[c]) / block_rows), math.ceil(n / block_rows)) for c, n in visits.items()]
    # at most MAX_PIVOTS rows
    shape = F.broadcast(queries.sparkSession.createDataFrame(shape, "cell int, tbs int, qbs int"))

    def dealt(rows, key, own, blocks, other, others):
        return (rows.join(shape, "cell").withColumn(own, F.pmod(F.xxhash64(*key), F.col(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("tbs", "qbs"))

    # rows that are equal in id differ in their row number, so copies spread too
    te = dealt(queries, ["q_row"], "qb", "qbs", "tb", "tbs")
    tr = dealt(train.drop("far"), ["t_row"], "tb", "tbs", "qb", "qbs").drop("t_row")
    return te.groupBy("cell", "tb", "qb").cogroup(tr.groupBy("cell", "tb", "qb")).applyInArrow(_best(k), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qrow").orderBy("dist", "tid", "label")
    return found.withColumn("nb_rank", F.row_number().over(order)).where(F.col("nb_rank") <= k)


def neighbours(train: DataFrame, test: DataFrame, k: int, block_rows: int = 20_000, pivots: int | None = None,
               report: dict | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``train(id, vec, label)`` of every row of ``test(id, vec[, truth])``.

    Euclidean; ties by id, then label. Gives ``qid, qrow, truth, tid, dist (squared),
    label, nb_rank``; ``qrow`` names the query row, as ids may repeat. ``report``
    takes the number of rows and of compared pairs."""
    train = cut_lineage(train.select(F.col("id").cast("long"), F.col("vec").cast("array<double>"),
                                     F.col("label").cast("double")))
    truth = F.col("truth").cast("double") if "truth" in test.columns else F.lit(None).cast("double")
    # row numbers of a checkpoint do not move
    test = cut_lineage(test.select(F.col("id").cast("long").alias("q_id"), truth.alias("q_truth"),
                                   F.col("vec").cast("array<double>").alias("q_vec"))).select(
        "q_id", F.monotonically_increasing_id().alias("q_row"), "q_truth", "q_vec")
    copies = Window.partitionBy("vec").orderBy("id", "label")
    train = cut_lineage(train.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k).drop("nth"))
    n = train.count()
    spark = train.sparkSession
    if not n:
        return spark.createDataFrame([], FOUND + ", nb_rank int")
    width = len(train.first().vec)
    boxed = 0 < width <= FEW_DIMENSIONS
    placed_as = "t_id long, t_vec array<double>, t_label double, cell int, far double"
    if boxed:
        cuts = choose_boxes(train, n, pivots or min(MAX_BOXES, math.ceil(max(math.sqrt(n), 2 * n / block_rows))))
        count, deal = cuts.leaves, _deal(spark.sparkContext.broadcast(cuts))
        ends = [f(F.get("t_vec", F.lit(i))).alias(f"{name}{i}") for i in range(width) for f, name in ((F.min, "a"), (F.max, "b"))]
    else:
        centres = choose_pivots(train, n, pivots or min(MAX_PIVOTS, math.ceil(math.sqrt(n))))
        count, deal = len(centres), _assign(spark.sparkContext.broadcast(centres))
        ends = [F.min("far").alias("a0"), F.max("far").alias("b0")]
    placed = cut_lineage(train.mapInArrow(deal, placed_as)).withColumn("t_row", F.monotonically_increasing_id())
    size = np.zeros(count, np.int64)
    low, high = (np.full((count, width if boxed else 1), v) for v in (np.inf, -np.inf))
    # one row for each cell
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect():
        size[row.cell] = row.n
        for i in range(low.shape[1]):
            low[row.cell, i], high[row.cell, i] = row[f"a{i}"], row[f"b{i}"]
    cells = BoxCells(cuts, size, low, high) if boxed else Cells(centres, size, np.where(size > 0, low[:, 0], 0.0),
                                                                np.where(size > 0, high[:, 0], 0.0))
    told = spark.sparkContext.broadcast(cells)

    def searched(queries, first):
        def go(count, schema):
            return queries.mapInArrow(_visits(told, k, first, count), schema)

        visits = {r.cell: r.n for r in go(True, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        if report is not None:
            report["pairs"] = report.get("pairs", 0) + sum(int(size[c]) * v for c, v in visits.items())
        return _meet(go(False, QUERY + (", cell int" if first else ", kth double, cell int")), visits, placed, cells, k, block_rows)

    close = cut_lineage(_top(searched(test, True), k).drop("nb_rank"))
    kth = close.groupBy(F.col("qrow").alias("q_row")).agg(F.max("dist").alias("kth"))
    further = searched(test.join(kth, "q_row").select("q_id", "q_row", "q_truth", "q_vec", "kth"), False)
    if report is not None:
        report.update(train=n, test=test.count())
    return _top(close.union(further), k)
