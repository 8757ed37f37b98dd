"""Session settings the jobs rely on.

Only runtime SQL settings are touched, so a session handed in by a cluster keeps its own
resources, checkpoint folder and shuffle partition count. What adaptive execution starts from and
coalesces again is set here.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Address timestamps are UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot network, operator or resolver may hold a third of the rows: let the join split it
    # even when that costs one more exchange afterwards.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A broadcast table is gathered and hashed on the driver, several at a time, at a few times these bytes.
    # Runtime broadcast is decided on measured bytes. Before that Spark knows the size of files only, and key
    # columns take ten to thirty times that as rows, so only tables up to 1 MB go without a measure.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    # A table of few keys (countries, services) leaves most partitions empty; that must not keep it from being
    # broadcast, or the rows of each key meet in one task.
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    # The JVM never compiles longer methods. Cleaning a landed row takes more as one method, so it runs as several.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A task that reads files may sort all it reads before the first shuffle (the newest row of each address).
    "spark.sql.files.maxPartitionBytes": "16MB",
}
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
START_PARTITIONS = 512
"""Partitions that a shuffle starts with, at least. Adaptive execution coalesces them up to its advisory size, so what
a task sorts or hashes follows that size and not the rows over the session's partitions."""


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set(START, str(max(START_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one (tests, a laptop) gets a scratch folder; on a cluster a folder of
    one machine would lose rows, so the setting is required there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="resolvescope-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame that several steps read to the shared folder and continue from the files.

    The lineage ends at a Parquet table, so a lost executor costs a re-read, later steps prune
    columns, and joins see the real size. The table is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(location)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str | None = None, app: str = "resolvescope") -> SparkSession:
    """Local session for tests and benchmarks."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
