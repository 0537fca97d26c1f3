"""Shared pieces: table access, shared scratch tables, connected components."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

#: A side is broadcast only after its rows were counted on a written table and
#: rows x stated width stay below this many bytes.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and reread it.

    Cuts the lineage so that a lost executor costs a reread and no
    recomputation. The folder is removed when the session's file system closes.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, lists: str | None = None) -> DataFrame:
    """Broadcast hint for a written table if its counted size is within the bound.

    ``lists`` names a column of int arrays, whose entries are counted besides the rows.
    """
    size = df.count() * row_bytes
    if lists and size <= BROADCAST_BYTES:
        size += 5 * (df.agg(F.sum(F.size(lists).cast("long"))).first()[0] or 0)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hash_fold(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, comp)``.

    ``comp`` is the smallest node reachable; nodes without an edge are absent.
    Alternating large-star and small-star rounds over written edge tables until
    every component is a star around its smallest node. Group minima are
    pre-aggregated map-side and written, so the join back is a plain one whose
    hot nodes Spark can split. Nothing is collected but whether a node is left
    that has two parents or is parent and child.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                             F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _all_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        e = written(_small_star(_large_star(e)), "edges")
    raise RuntimeError("components did not settle")


def _all_stars(e: DataFrame) -> bool:
    ends = e.select("u", F.lit(1).alias("child")).union(e.select(F.col("v").alias("u"), F.lit(0).alias("child")))
    return ends.groupBy("u").agg(F.sum("child").alias("parents"), F.min("child").alias("least")).where(
        "parents > 1 or (parents > 0 and least = 0)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = written(both.groupBy("u").agg(F.min("v").alias("m"))
                .select("u", F.least("u", "m").alias("m")), "minima")
    return both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = written(e.where("u <> v"), "down")
    m = written(down.groupBy("u").agg(F.min("v").alias("m")), "minima")
    moved = down.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def deal(entries: DataFrame, bucket: list[str], member: str, size: int | str) -> DataFrame:
    """Deal the members of each bucket (of two or more) to groups of about ``size`` (a number, or SQL over the bucket).

    A bucket of n members has s = n / size sub-buckets; a member is sent to the
    groups of its own sub-bucket with every other, so any two meet once (twice
    never). Adds ``grp``, and ``side``: whether it belongs to the later
    sub-bucket of the two; in a group with both sides only members of different
    sides are to be compared.
    """
    counts = written(entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    return (entries.join(counts, bucket)
            .withColumn("s", F.expr(f"cast((n + ({size}) - 1) div ({size}) as int)"))
            .withColumn("q", F.pmod(F.xxhash64(member, *bucket), F.col("s")).cast("int"))
            .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            .withColumn("grp", F.xxhash64(*bucket, F.least("q", "r"), F.greatest("q", "r")))
            .withColumn("side", F.col("q") > F.col("r")).drop("n", "s", "q", "r"))


def give_back() -> None:
    """Return freed memory of this worker to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run):
    """``run`` over batches; its task gives freed memory back when it ends.

    Workers serve many tasks, and what the allocators keep of one adds up beside
    the executor's heap."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def groups_of(batches, key: str = "grp"):
    """Tables of the rows of each group, from batches sorted by group; a group may span batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(key).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != group[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
