"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are ranked in seeded random order, then all rows are put in
order of fractional rank ``(2 r - 1) / (2 n_source)`` and cut into runs of equal
length. Every run holds each source in its share of the whole, and row counts of
shards differ by at most one (law ``rows``).

Ranks come from counts, without a global sort and without one task per source:
a row's random key falls into one of ``buckets`` key ranges, ranks inside a
(source, range) add to the counts of the ranges before. The number of rows
before a range of fractional ranks follows from the source sizes alone.

Edge cases: a null source is a stratum of its own; a null text has size 8 and
the checksum of the empty text; null ids and repeated rows are rows like any
other (identical rows may swap places); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

KEY_DIGITS = 3  # hex digits of the random key that name its range: 16 ** 3 ranges
LANES = 16 ** KEY_DIGITS


def interleave(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, source, rank, shard, slot`` for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("stratum"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32").cast("binary")))
    rows = rows.withColumn("lane", F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("int"))

    counts = written(rows.groupBy("stratum", "lane").agg(F.count("*").alias("n")), "lanes")
    by_lane = Window.partitionBy("stratum").orderBy("lane")
    ahead = counts.select(
        "stratum", "lane",
        (F.sum("n").over(by_lane) - F.col("n")).alias("ahead"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("n_source"))

    ranked = rows.withColumn("r", F.row_number().over(
        Window.partitionBy("stratum", "lane").orderBy("key", "doc_id", "size")))
    ranked = ranked.join(ahead, ["stratum", "lane"]).withColumn("rank", F.col("ahead") + F.col("r"))
    ranked = ranked.withColumn("span", F.expr(f"((2 * rank - 1) * {LANES}) div (2 * n_source)"))

    # rows of a source before span s: the ranks r with (2 r - 1) * LANES < 2 n s
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    before = (sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("span"))
              .groupBy("span").agg(F.sum(F.expr(f"(2 * n * span + {LANES} - 1) div {LANES} div 2")).alias("before"),
                                   F.sum("n").alias("total"))
              .select(F.col("span").cast("long").alias("span"), "before", "total"))
    place = Window.partitionBy("span").orderBy(
        (F.expr("2 * rank - 1").cast("double") / F.expr("2 * n_source").cast("double")), "stratum", "rank")
    # `before` has LANES rows at every size of the input
    placed = (ranked.withColumn("at", F.row_number().over(place)).join(F.broadcast(before), "span")
              .withColumn("pos", F.expr("before + at - 1"))
              .withColumn("shard", F.expr(f"(pos * {shards}) div total").cast("int")))
    return placed.select(
        "doc_id", "size", "text_crc32", "source", "rank", "shard",
        F.expr(f"pos - (cast(shard as bigint) * total + {shards} - 1) div {shards}").alias("slot"))
