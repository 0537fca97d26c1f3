"""Session settings every job in the library assumes.

* UTC session time zone: dates derived from ``timestamp_ntz`` columns and
  ``date_trunc`` results must not move with the host's zone.
* ANSI mode on (Spark 4 default): overflow and bad casts raise instead of
  silently producing NULL; lenient parsing is always explicit (``try_cast``).
* AQE on, with partition coalescing and skew-join splitting, so the shuffle
  partition count below is an upper bound that AQE shrinks at runtime and hot
  join keys get split across tasks.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster call it without ``master`` changes in the submit script and
    size ``shuffle_partitions`` to the data (about 128-256 MB per partition
    after AQE coalescing); the local default suits tests.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        conf["spark.driver.memory"] = "16g"  # local mode: the driver JVM runs the tasks
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the SQL-level defaults on an existing session (driver-provided)."""
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``; only when the session has none and runs
    in this process alone (tests, local runs) a fresh scratch folder is created
    and registered. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    registered = sc.getCheckpointDir()
    current = spark.conf.get("spark.checkpoint.dir", None) or registered
    if current:
        if not registered:
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quarry-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # core confs may be read-only at runtime
        pass
    return path


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the session's file system closes."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local).

    Its files are deleted once no frame refers to it (Spark's context cleaner).

    The frame is persisted for the duration of the checkpoint: writing the
    checkpoint files is a second job over the same data, which would
    otherwise recompute the whole plan. A frame that is a checkpoint already is
    not written again."""
    from pyspark import StorageLevel

    if getattr(df, "_is_checkpoint", False):
        return df
    checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = held.checkpoint(eager=True)
        out._is_checkpoint = True
        return out
    finally:
        held.unpersist()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)
