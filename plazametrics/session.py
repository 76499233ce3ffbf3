"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    physical = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    memory = f"{max(1, min(12, physical * 6 // 10 >> 30))}g"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plazametrics")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("plazametrics.spreadTables", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back only where none is named."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="plazametrics-")
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def iterated(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many partitions as a shuffle has and written once, for repeated passes."""
    return checkpointed(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
