"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for.

    Adaptive execution sizes the shuffle partitions at run time and splits
    skewed join partitions, so the starting number is only an upper bound.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Spark's setting to drop a query's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder, removed when the session's JVM ends.

    Without ``spark.checkpoint.dir`` it lies in the warehouse, which all
    executors share as well, unless that is a folder of one machine: then a
    cluster has to name one. A machine's temporary folder is never used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base.rstrip('/')}/logloom-{purpose}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` from a table in the scratch folder, so that what made them runs once.

    For results that are read several times and cost much more to make than to
    read back; a lost executor does not make them again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    # The table replaces the shuffle files, so that stages do not add up on the executors' disks.
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
