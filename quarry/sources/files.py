"""File sources and sinks.

All writes go below the cluster's shared checkpoint folder (see
``quarry.session.scratch_dir``), never a machine-local temp folder.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.joins import estimated_bytes
from quarry.session import cut_lineage, remove_at_exit, scratch_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; it goes when the session ends."""
    path = scratch_dir(spark, f"{label}-{uuid.uuid4().hex[:12]}")
    remove_at_exit(spark, path)
    return path


# --- S1: CSV ----------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan with a header row. An explicit schema avoids the extra pass of
    schema inference; PERMISSIVE turns malformed fields into NULL."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


TYPES = ("bigint", "double", "date", "timestamp_ntz", "boolean")  # tried in this order
BAD = "bad_record"


def infer_types(texts: DataFrame, share: float = 0.99, types=TYPES) -> dict[str, str]:
    """A type for every text column: the first that at least ``share`` of its values parse as, else string.

    One aggregate over all columns and rows, so a few bad values do not turn a
    column into text. Columns without a value stay text."""
    given = {c: F.col(f"`{c}`") for c in texts.columns}
    row = texts.agg(*[F.count(v).alias(f"{c}\tn") for c, v in given.items()],
                    *[F.count(v.try_cast(t)).alias(f"{c}\t{t}") for c, v in given.items() for t in types]).first()
    return {c: next((t for t in types if row[f"{c}\tn"] and row[f"{c}\t{t}"] >= share * row[f"{c}\tn"]), "string")
            for c in given}


def read_csv_checked(spark: SparkSession, path: str, share: float = 0.99) -> DataFrame:
    """CSV with a header, inferred types and no lost line.

    Column types come from ``infer_types``. A line that has too few or too many
    fields, or a value that does not parse, keeps what does; its text is in
    ``bad_record`` (else NULL)."""
    names = spark.read.option("header", True).csv(path).columns
    schema = StructType()
    for c in [*names, BAD]:
        schema = schema.add(c, "string")
    texts = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
             .option("columnNameOfCorruptRecord", BAD).schema(schema).csv(path))
    types = infer_types(texts.where(F.col(BAD).isNull()).drop(BAD), share)
    typed = {c: F.col(f"`{c}`").try_cast(types[c]) for c in names}
    unread = [F.col(f"`{c}`").isNotNull() & typed[c].isNull() for c in names if types[c] != "string"]
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
    bad = F.coalesce(F.col(BAD), F.when(F.array_contains(F.array(*unread, F.lit(False)), True), line))
    return texts.select(*[v.alias(c) for c, v in typed.items()], bad.alias(BAD))


# --- S6 / S8: row index and export ----------------------------------------------------

ROW_BITS = 33  # monotonically_increasing_id: partition id << 33 | row in partition


def with_row_index(df: DataFrame, order_by: list, name: str = "index") -> DataFrame:
    """0-based global row index in ``order_by`` order.

    The frame is range-partitioned and sorted by the key, rows that are equal on it
    by a hash of the whole row (so also a key that holds a third of the rows spans
    ranges), tagged with ``monotonically_increasing_id`` and checkpointed to the
    shared folder so a recomputed task cannot reshuffle the tags; the checkpoint goes
    with the last frame that reads it. The per-partition row counts
    (one row per partition) give the offsets; no single-partition window over
    the data is used. ``order_by`` should be a total order for a stable index.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    tagged = cut_lineage(df.orderBy(*order_by, tie)
                         .withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__mid"), ROW_BITS)
    counts = tagged.groupBy(part.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid"), ROW_BITS)
    return (tagged.withColumn("__pid", part)
            .join(F.broadcast(offsets), "__pid")
            .select((F.col("__off") + local).alias(name),
                    *[F.col(c) for c in df.columns]))


def export(df: DataFrame, path: str, fmt: str = "csv", index_by: list | None = None,
           single_file: bool = False, mode: str = "overwrite") -> str:
    """Write a final table for BI tools (S6, re-aimed from an Excel sheet):
    CSV with header or Parquet, optionally with a 0-based row index. One
    output file only on request (``coalesce(1)`` funnels all rows through one
    task)."""
    out = with_row_index(df, index_by) if index_by else df
    if single_file:
        out = out.coalesce(1)
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


# --- S4 / S9: year-range partitioned tables -------------------------------------------

def year_range_bucket(date_col: str, first_upper: int, last_lower: int):
    """Range partition label of a year (S4): years below ``first_upper`` fall
    into one bucket labelled ``first_upper - 1``, years from ``last_lower`` on
    into one labelled ``last_lower``, every year between into its own."""
    y = F.year(F.col(date_col))
    return F.least(F.greatest(y, F.lit(first_upper - 1)), F.lit(last_lower))


FILE_BYTES = 512 * 1024 * 1024


def write_year_partitioned(df: DataFrame, path: str, date_col: str,
                           first_upper: int, last_lower: int,
                           part_col: str = "part_year", salts: int | None = None) -> str:
    """Partitioned Parquet write, one directory per range bucket.

    Rows are clustered by (bucket, salt) before writing: each task writes one
    file into one directory, and a bucket (a year may hold a third of the
    rows) is spread over ``salts`` tasks instead of one. The salt is a hash
    of the row, so a retried task writes the same rows; by default it is
    sized from Catalyst's size estimate (about ``FILE_BYTES`` per file)."""
    if salts is None:
        size = estimated_bytes(df)
        salts = 1 if not size else max(1, -(-size // FILE_BYTES))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    (df.withColumn(part_col, year_range_bucket(date_col, first_upper, last_lower))
       .repartition(part_col, salt)
       .write.mode("overwrite").partitionBy(part_col).parquet(path))
    return path


def read_date_range(spark: SparkSession, path: str, date_col: str, start: str, end: str,
                    first_upper: int, last_lower: int, part_col: str = "part_year") -> DataFrame:
    """Inclusive date-range read (P6) that touches only the matching partition
    directories (S9): the date predicate is translated into a predicate on the
    partition column, which Spark applies as a ``PartitionFilter``."""
    lo = max(min(int(start[:4]), last_lower), first_upper - 1)
    hi = max(min(int(end[:4]), last_lower), first_upper - 1)
    table = spark.read.parquet(path)
    dtype = table.schema[date_col].dataType.typeName()
    d = F.col(date_col)
    if dtype == "date":
        cond = d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    else:  # timestamp or timestamp_ntz: half-open range of the same type
        ts = "timestamp_ntz" if dtype == "timestamp_ntz" else "timestamp"
        cond = ((d >= F.lit(start).cast(ts))
                & (d < F.date_add(F.lit(end).cast("date"), 1).cast(ts)))
    return table.where(F.col(part_col).between(lo, hi)).where(cond)


def partitions_read(df: DataFrame) -> DataFrame:
    """Evidence of pruning: the distinct files the rows came from."""
    return df.select(F.input_file_name().alias("file")).distinct()


# --- S10: point lookup ---------------------------------------------------------------

def point_lookup(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose ``col`` equals ``value``; on Parquet the equality reaches the
    scan as a pushed filter (row-group min/max skipping)."""
    return df.where(F.col(col) == F.lit(value))


# --- S3 / S5: typed tables -------------------------------------------------------------

@contextmanager
def database(spark: SparkSession, name: str, path: str | None = None):
    """A database of the session catalog with its own folder, for as long as the block runs (S3).

    Everything in it and its folder are gone afterwards, also after an error."""
    path = path or fresh_path(spark, name)
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def create_typed_table(spark: SparkSession, name: str, ddl_columns: str, path: str | None = None,
                       partition_cols: str | None = None) -> str:
    """``CREATE TABLE … USING parquet`` with CHAR/VARCHAR columns at ``path`` (else in its database's folder).
    Inserts through the table enforce lengths; CHAR is padded on read."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    part = f" PARTITIONED BY ({partition_cols})" if partition_cols else ""
    at = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {name} ({ddl_columns}) USING parquet{part}{at}")
    return name


def refused(spark: SparkSession, name: str, df: DataFrame) -> bool:
    """Whether appending ``df`` breaks a length rule of the table; nothing is appended then."""
    try:
        append_rows(spark, name, df)
    except Exception as e:
        if "EXCEED_LIMIT_LENGTH" in str(e):
            return True
        raise
    return False


def append_rows(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Append a DataFrame (or literal rows) to a typed table by position."""
    view = f"__append_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT INTO {name} SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


# --- S7: head / tail ----------------------------------------------------------------------

def head(df: DataFrame, order_by: list, n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit key (top-k per partition, then merge)."""
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: list, n: int = 5) -> DataFrame:
    """Last ``n`` rows by the key, returned in ascending order."""
    desc = [F.col(c).desc() if isinstance(c, str) else c.desc() for c in order_by]
    return df.orderBy(*desc).limit(n).orderBy(*order_by)
