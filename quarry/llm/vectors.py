"""Product codes of vectors, assigned by equal-average search.

Components become integers, vectors are cut into equal consecutive parts, and each
part position has a small codebook, refined by rounds of assignment and averaging.

Equal-average search: the entries of a codebook are sorted by their component sum.
For a part with sum s, ``(s - S)^2 / d`` bounds its squared distance to an entry
with sum S from below (d components), so entries are visited outward from s, the
nearer sum first, and the search of a part ends as soon as the bound of the next
entry strictly exceeds the best distance; entries at an equal bound can still tie
and are visited. All arithmetic is in integers: ``(s - S)^2 > best * d``.

Each round is one pass of the tasks over the written integer vectors; a task gives
the sums and counts of its entries (parts x entries rows), which add up exactly in
decimals. The driver holds codebooks only: parts x entries x dimension numbers,
whatever the number of vectors.

Edge cases: vectors that are null, empty or hold a null or non-finite component are
dropped, as are those whose length is not the table's (the most frequent length,
the longer of two as frequent) or that cannot be cut in equal parts; with fewer than
``entries`` vectors the codebooks are shorter; equal parts share an entry and ties go
to the lower index; repeated rows and ids are rows like any other (the first entries
order by id, then vector; null ids come last); a null label is a label of its own; an
empty table gives no rows; further columns are ignored. Integer components beyond
2 ** 27 would leave the range of an error sum and raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 27


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of ``book`` (ties to the lower), its squared distance, and entries compared.

    ``parts`` (n x d) and ``book`` (k x d) hold integers."""
    n, d = parts.shape
    own = book.sum(axis=1)
    order = np.argsort(own, kind="stable")
    sums, s = own[order], parts.sum(axis=1)
    up = np.searchsorted(sums, s)  # next entry above, next below
    down = up - 1
    best = np.full(n, np.iinfo(np.int64).max // max(1, d), np.int64)
    index = np.full(n, len(book), np.int64)
    alive, compared = np.arange(n), 0
    far = np.int64(1) << 40
    while len(alive):
        above = np.where(up[alive] < len(sums), sums[np.minimum(up[alive], len(sums) - 1)] - s[alive], far)
        below = np.where(down[alive] >= 0, s[alive] - sums[np.maximum(down[alive], 0)], far)
        gap = np.minimum(above, below)
        go = (gap < far) & (gap * gap <= best[alive] * d)
        alive, rise = alive[go], (above <= below)[go]
        at = order[np.where(rise, up[alive], down[alive])]
        up[alive] += rise
        down[alive] -= ~rise
        compared += len(alive)
        away = parts[alive] - book[at]
        dist = np.einsum("ij,ij->i", away, away)
        better = (dist < best[alive]) | ((dist == best[alive]) & (at < index[alive]))
        best[alive[better]], index[alive[better]] = dist[better], at[better]
    return index, best, compared


def integers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """Written ``vec_id, label, ints`` of the vectors that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.select("vec_id", "label", "embedding").where(
        F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)
        & (F.size("embedding") % parts == 0))
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return written(good.select("vec_id", "label", F.array().cast("array<int>").alias("ints")), "integers")

    def whole(x):
        value = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(value) <= LIMIT, value.cast("int")).otherwise(
            F.raise_error("component beyond 2 ** 27 / 4096").cast("int"))

    return written(good.where(F.size("embedding") == length["d"]).select(
        "vec_id", "label", F.transform("embedding", whole).alias("ints")), "integers")


def first_books(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part x entry x component) from the vectors of the smallest ids."""
    rows = ints.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    table = np.array([r.ints for r in rows], np.int64)
    return table.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _tally(books):
    def run(batches):
        held = books.value
        parts, entries, d = held.shape
        total, count = np.zeros(held.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                cut = _matrix(batch).reshape(batch.num_rows, parts, d)
                for p in range(parts):
                    index, _, _ = nearest(cut[:, p], held[p])
                    np.add.at(total[p], index, cut[:, p])
                    count[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
            "n": pa.array(count[part, entry], pa.int64()),
            "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})
    return run


def refine(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every used entry becomes the floor of its parts' mean."""
    spark = ints.sparkSession
    sent = spark.sparkContext.broadcast(books)
    d = books.shape[2]
    tallies = ints.select("ints").mapInArrow(_tally(sent), "part int, entry int, n long, total array<long>")
    sums = tallies.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(d)]).alias("total")).collect()
    out = books.copy()
    for row in sums:  # parts x entries rows
        out[row.part, row.entry] = [int(t) // row.n for t in row.total]
    sent.unpersist()
    return out


def _codes(books):
    def run(batches):
        held = books.value
        parts, _, d = held.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _matrix(batch).reshape(batch.num_rows, parts, d)
            code, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                index, dist, _ = nearest(cut[:, p], held[p])
                code[:, p] = index
                error += dist
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                pa.array([row.tobytes() for row in code], pa.binary()), pa.array(error)],
                ["vec_id", "label", "code", "error"])
    return run


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, label, code (a byte for each part), error`` of every kept vector, and the codebooks."""
    if entries > 256:
        raise ValueError("an index is one byte")
    ints = integers(vectors, parts)
    kinds = {f.name: f.dataType.simpleString() for f in ints.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"
    if ints.isEmpty():
        return ints.sparkSession.createDataFrame([], schema), None
    books = first_books(ints, parts, entries)
    for _ in range(rounds):
        books = refine(ints, books)
    sent = ints.sparkSession.sparkContext.broadcast(books)
    return ints.mapInArrow(_codes(sent), schema), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the errors summed over equal labels (nulls together)."""
    held = written(codes, "codes")
    sums = written(held.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label"), F.lit(0)).alias("value"))
    return held.withColumn("__label", key).join(
        small(sums.select(key.alias("__label"), "label_error"), 32), "__label").drop("__label")
