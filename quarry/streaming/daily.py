"""Daily active users kept up to date from an append-only action log.

The batch definition (``plans.engagement.dau``) counts distinct users per
calendar day. In Structured Streaming a distinct count is kept as state: the
first action of each (user, one-day event-time window) passes a
de-duplication whose state lives until the watermark passes the window, and
those first actions are counted per window. Rows arrive in
the sink once the watermark has passed the end of their day (append mode),
so each day is written exactly once; actions later than ``lateness`` are
dropped, which is the price of bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS_SCHEMA = "user_id bigint, order_id bigint, action string, time timestamp_ntz"


def dau_stream(actions: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streaming DAU: ``(dt, dau)`` rows, one per finished day."""
    firsts = (actions.withColumn("time", F.col("time").cast("timestamp"))
              .withWatermark("time", lateness)
              .select("user_id", F.window("time", "1 day").alias("day"))
              .dropDuplicates(["user_id", "day"]))
    return (firsts.groupBy("day")
            .agg(F.count(F.lit(1)).alias("dau"))
            .select(F.to_date(F.col("day.start")).alias("dt"), "dau"))


def run_dau(spark: SparkSession, source: str, sink: str, checkpoint: str,
            lateness: str = "1 day"):
    """Process every file now in ``source`` (Parquet, ``ACTIONS_SCHEMA``) and
    append finished days to ``sink``; the checkpoint makes reruns resume
    where they stopped. Returns the finished query."""
    actions = spark.readStream.schema(ACTIONS_SCHEMA).parquet(source)
    query = (dau_stream(actions, lateness).writeStream
             .format("parquet").option("path", sink)
             .option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query
