"""Exact order statistics without a global sort or an unbounded group.

``value_positions`` turns a (possibly grouped) numeric column into one row
per distinct ``(group, value)`` with its tie count ``t`` and ``start``, the
number of smaller values in the group. From it follow average ranks (ties),
exact quantiles with linear interpolation, and ordinal positions.

Plan, all lazy:

1. ``groupBy(group, value).count()`` - partial aggregation, so a value or
   group holding a third of the rows costs one row per task.
2. Bucket ids are a pure function of the value: literal boundaries taken from
   approximate quantiles of a seeded sample (computed once on the driver: a
   few hundred doubles, more only for very large data), so recomputing a lost
   task cannot move a value to another bucket. The sample only balances
   buckets; results use every row.
3. Per ``(group, bucket)`` totals - a small table - give bucket offsets by a
   window partitioned by group over at most ``buckets`` rows per group.
4. Inside a bucket a window over the *distinct* values gives the cumulative
   counts; the bucket count grows with the data (about ``ROWS_PER_BUCKET``
   rows per bucket), so that window stays bounded, and a hot value is a
   single row there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.operators.joins import broadcast_if_rows, sized_broadcast
from quarry.operators.selection import quantiles
from quarry.session import cut_lineage

MIN_BUCKETS = 64
# Boundaries only balance the buckets (like the sample behind Spark's range
# partitioner); every count and position is computed over all rows.
BOUNDARY_SAMPLE = 0.05
BOUNDARY_SEED = 17
GRID = 256                  # quantiles taken in the sizing pass
ROWS_PER_BUCKET = 2_000_000  # bound on the rows (hence distinct values) of one bucket
CASE_LIMIT = 64             # up to this many boundaries a literal CASE, else binary search


def _boundaries(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Sorted literal bucket boundaries for ``value``.

    One pass over a seeded sample returns its size and a grid of approximate
    quantiles; the bucket count is the larger of ``MIN_BUCKETS`` and the
    estimated rows / ``ROWS_PER_BUCKET`` (so a bucket - and the window over
    it - stays bounded however large the data), and only beyond the grid a
    second, finer pass is made."""
    sample = df.sample(withReplacement=False, fraction=BOUNDARY_SAMPLE, seed=BOUNDARY_SEED)
    probs = [i / GRID for i in range(1, GRID)]
    row = sample.agg(F.count(F.lit(1)).alias("n"),
                     F.percentile_approx(value, probs, 4 * GRID).alias("q")).first()
    if row is None or not row["n"] or row["q"] is None:
        return []
    est_rows = row["n"] / BOUNDARY_SAMPLE
    want = buckets or max(MIN_BUCKETS, math.ceil(est_rows / ROWS_PER_BUCKET))
    if want <= GRID:
        grid = row["q"]
        qs = [grid[min(GRID - 2, round(i * GRID / want) - 1)] for i in range(1, want)]
    else:
        qs = sample.approxQuantile(value, [i / want for i in range(1, want)], 1.0 / (4 * want))
    return sorted({float(q) for q in qs if q is not None})


def bucket_of(value_col, bounds: list[float]):
    """Number of boundaries below the value (bucket index 0..len(bounds)):
    a literal CASE for a few boundaries, a vectorised binary search over the
    literal boundary array otherwise. Either way a pure function of the value."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= CASE_LIMIT:
        expr = F.when(value_col <= F.lit(bounds[0]), F.lit(0))
        for i, b in enumerate(bounds[1:], start=1):
            expr = expr.when(value_col <= F.lit(b), F.lit(i))
        return expr.otherwise(F.lit(len(bounds)))
    edges = np.asarray(bounds, dtype=np.float64)

    @F.pandas_udf("int")
    def search(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=np.float64), side="left"),
                         dtype="int32")

    return search(value_col)


def value_positions(df: DataFrame, value: str, by: list[str] | None = None,
                    buckets: int | None = None) -> DataFrame:
    """One row per distinct ``(by..., value)``: ``t`` copies, ``start`` smaller
    values in the group, ``n`` group size. NULL and NaN values are left out."""
    by = list(by or [])
    v = F.col(value)
    clean = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*by, v.cast("double").alias("x"))
    bounds = _boundaries(clean, "x", buckets)
    counted = (clean.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("t"))
               .withColumn("b", bucket_of(F.col("x"), bounds)))
    per_bucket = counted.groupBy(*by, "b").agg(F.sum("t").alias("bt"))
    wb = Window.partitionBy(*by).orderBy("b") if by else Window.orderBy("b")
    offsets = per_bucket.select(
        *by, "b",
        (F.sum("bt").over(wb) - F.col("bt")).alias("boff"),
        F.sum("bt").over(Window.partitionBy(*(by or [F.lit(0)]))).alias("n"))
    inner = Window.partitionBy(*by, "b").orderBy("x")
    return (counted.join(sized_broadcast(offsets), [*by, "b"])
            .select(*by, "x", "t", "n",
                    (F.col("boff") + F.sum("t").over(inner) - F.col("t")).alias("start")))


def average_ranks(positions: DataFrame) -> DataFrame:
    """1-based average rank of each distinct value (ties share the mean rank)."""
    return positions.withColumn("rank", F.col("start") + (F.col("t") + 1) / 2.0)


ROWS_PER_RANGE = 2_000_000  # values of a range that are ranked in one task (some 50 bytes each)
BLOCK_ROWS = 1 << 18        # rows that go through the shuffles as one block
SAMPLED = 20_000            # rows, at least, that tell how to cut the values into ranges of about equal size


def _blocks(batches, size: int):
    """The rows of a task in tables of ``size`` rows, however Spark cut them into batches."""
    held, many = [], 0
    for batch in batches:
        while many + batch.num_rows >= size:
            take = size - many
            yield pa.Table.from_batches([*held, batch.slice(0, take)])
            held, many, batch = [], 0, batch.slice(take)
        if batch.num_rows:
            held.append(batch)
            many += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _cut(bounds: dict, key: int, values: np.ndarray) -> np.ndarray:
    """Range of each value: greater values never lie in lower ranges."""
    return np.searchsorted(bounds.get(key, np.zeros(0)), values, side="left")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _rank_range(key, pieces):
    """Average ranks within a range; a piece holds the distinct values of a block in order, and how often each occurs."""
    values = [np.frombuffer(v, np.float64) for v in pieces["payload"].to_pylist()]
    times = [np.frombuffer(c, np.int32) if c else np.ones(len(v), np.int32)
             for c, v in zip(pieces["times"].to_pylist(), values, strict=True)]
    _, at = np.unique(np.concatenate(values), return_inverse=True)
    t = np.bincount(at, np.concatenate(times))
    rank = (np.cumsum(t) - t + (t + 1) / 2)[at]
    ends = np.cumsum([len(v) for v in values])
    ranked = [r.tobytes() for r in np.split(rank, ends[:-1])]
    return pieces.select(["row_block", "key", "range"]).append_column("payload", pa.array(ranked, pa.binary()))


def ranked_blocks(frozen: DataFrame, parts, finish, schema: str, rows: int, ranges: int) -> DataFrame:
    """What ``finish(table, ranks)`` makes of every block of rows of ``frozen``, a checkpoint with row numbers ``__row``.

    ``parts(table)`` gives the values of a block (finite or infinite doubles) by the integer key within which they are
    ranked; ``ranks`` the 1-based average ranks over all rows, each an array as long as its values.

    Blocks, not rows, are shuffled: a block sends the distinct values of each key, in order and cut into ``ranges``, with
    their counts. A range is ranked in one task, and its ranks return to their blocks with the blocks' own rows, in the
    second shuffle. No join by value, and a value that many rows share is one value of each block. Ranges are cut
    by a sample of the rows, which only balances them; the driver counts the rows of each range and key."""
    context = frozen.sparkSession.sparkContext
    size = BLOCK_ROWS

    def sampled(batches):
        for table in _blocks(batches, size):
            for key, v in parts(table).items():
                yield pa.RecordBatch.from_pydict({"key": np.full(len(v), key, np.int64), "value": v})

    share = min(1.0, max(SAMPLED, 200 * ranges) / max(rows, 1))
    drawn = frozen if share == 1.0 else frozen.sample(False, share, BOUNDARY_SEED)
    seen = drawn.mapInArrow(sampled, "key long, value double").toPandas()
    bounds = {}
    for key, v in seen.groupby("key")["value"]:
        v = np.sort(v.to_numpy())
        bounds[int(key)] = np.unique(v[np.arange(1, ranges) * len(v) // ranges])
    told = context.broadcast(bounds)

    def counted(batches):
        n: dict = {}
        for table in _blocks(batches, size):
            for key, v in parts(table).items():
                for r, m in enumerate(np.bincount(_cut(told.value, key, v))):
                    if m:
                        n[key, r] = n.get((key, r), 0) + int(m)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.int64()), pa.array([r for _, r in n], pa.int32()),
                                          pa.array(n.values(), pa.int64())], ["key", "range", "n"])

    totals = frozen.mapInArrow(counted, "key long, range int, n long").groupBy("key", "range").agg(
        F.sum("n").alias("n")).toPandas().sort_values(["key", "range"])
    totals["base"] = totals.groupby("key")["n"].cumsum() - totals["n"]
    base = context.broadcast({(int(k), int(r)): int(b) for k, r, b in zip(
        totals["key"], totals["range"], totals["base"], strict=True)})

    def pieces(batches):
        for table in _blocks(batches, size):
            block, out = table["__row"][0].as_py(), []
            for key, v in parts(table).items():
                if not len(v):
                    continue
                v = np.sort(v)
                start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                v, t = v[start], np.diff(np.r_[start, len(v)]).astype(np.int32)
                at = _cut(told.value, key, v)
                edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    out.append((block, key, int(at[a]), v[a:b].tobytes(), b"" if (t[a:b] == 1).all() else t[a:b].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                    zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["row_block", "key", "range", "payload", "times"])

    def whole(batches):
        for table in _blocks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([table["__row"][0].as_py()]), pa.array([-1], pa.int64()),
                                              pa.array([-1], pa.int32()), pa.array([_packed(table)], pa.binary())],
                                             ["row_block", "key", "range", "payload"])

    def finished(_, group):
        own = {}
        for k, r, payload in zip(group["key"].to_pylist(), group["range"].to_pylist(), group["payload"].to_pylist(), strict=True):
            own[k, r] = payload
        table = pa.ipc.open_stream(own.pop((-1, -1))).read_all()
        order: dict = {}
        for k, r in sorted(own):
            order.setdefault(k, []).append(np.frombuffer(own[k, r], np.float64) + base.value[k, r])
        ranks = {}
        for key, v in parts(table).items():
            ranks[key] = np.concatenate(order[key])[np.unique(v, return_inverse=True)[1]] if len(v) else np.zeros(0)
        return finish(table, ranks)

    sent = "row_block long, key long, range int, payload binary"
    ranked = frozen.mapInArrow(pieces, sent + ", times binary").groupBy("key", "range").applyInArrow(_rank_range, sent)
    return ranked.union(frozen.mapInArrow(whole, sent)).groupBy("row_block").applyInArrow(finished, schema)


def ranks_in_place(df: DataFrame, key: str, value: str, row: str, rows: int) -> DataFrame:
    """1-based average ranks of ``value`` (finite doubles) within the integer ``key``: ``key, row, rank``, for long
    forms of ``rows`` rows; by :func:`ranked_blocks`."""
    spark = df.sparkSession
    frozen = cut_lineage(df.select(F.col(key).cast("int").alias("key"), (F.col(value).cast("double") + 0.0).alias("value"),
                                   F.col(row).cast("long").alias("row"), F.monotonically_increasing_id().alias("__row")))

    def owned(table):
        keys = table["key"].to_numpy()
        return {int(k): np.flatnonzero(keys == k) for k in np.unique(keys)}

    def parts(table):
        v = table["value"].to_numpy()
        return {k: v[at] for k, at in owned(table).items()}

    def finish(table, ranks):
        rank = np.empty(table.num_rows)
        for k, at in owned(table).items():
            rank[at] = ranks[k]
        return table.select(["key", "row"]).append_column("rank", pa.array(rank))

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_RANGE))
    return ranked_blocks(frozen, parts, finish, "key int, row long, rank double", rows, ranges)


def median(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return quantiles(df, value, [0.5], by).drop("q").withColumnRenamed("value", "median")


FEW_CLASSES = 10_000  # classes that are numbered on the driver
FEW_BYTES = 8 << 20   # of their texts


def dense_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """0-based code of each distinct non-null value in ascending order (label
    encoding). Few classes, counted and measured first, are numbered from one small
    aggregate; beyond that the code is the global row index of the sorted distinct
    values, whatever their type and number (range-partitioned, no single-task window)."""
    from quarry.sources.files import with_row_index

    spark = df.sparkSession
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    kind = df.schema[col].dataType
    size = F.octet_length(F.col(col).cast("string")) if kind.typeName() != "boolean" else F.lit(1)
    found = distinct.withColumn("__size", size.cast("long")).limit(FEW_CLASSES + 1)
    least = found.agg(F.count(F.lit(1)), F.sum("__size"), F.sort_array(F.collect_list(F.when(
        F.col("__size") <= FEW_BYTES // FEW_CLASSES, F.col(col)))).alias("classes")).first()
    if least[0] <= FEW_CLASSES and len(least["classes"]) == least[0]:
        # at most FEW_CLASSES rows and FEW_BYTES
        rows = [(v, i) for i, v in enumerate(least["classes"])]
        return F.broadcast(spark.createDataFrame(rows, StructType([StructField(col, kind), StructField(name, IntegerType())])))
    return broadcast_if_rows(with_row_index(distinct, [col], "__code").select(
        col, F.col("__code").cast("int").alias(name)))
