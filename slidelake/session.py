"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("slidelake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Where that is unset, a temporary one is made
    if all tasks run on this machine; on a cluster that is an error, as each executor would write to its own disk.
    Each application has one folder in it, which is removed when the application ends.
    """
    root = spark.conf.get("slidelake.scratch", None)
    if not root:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="slidelake-")
        root = os.path.join(base, f"slidelake-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark.conf.set("slidelake.scratch", root)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "step", folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one stage and not the whole
    chain, and pins values that must not move between two passes over the data.
    A step of a large job goes into a ``folder`` that the job discards; its shuffle
    files go as soon as it is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = os.path.join(folder, f"{label}-{uuid.uuid4().hex}") if folder else scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if folder:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if folder and before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        elif folder:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder of whose tables nothing is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
