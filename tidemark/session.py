"""Session helpers: a local session for tests and benches, and shared staging."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, memory="8g", checkpoint_dir=None):
    """A UTC session on this machine; clusters bring their own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts lineage, so a lost executor costs a re-read and not a recomputation, and
    gives later plans exact sizes to choose joins from.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df))


def stage_path(df: DataFrame) -> str:
    """Write ``df`` once to the shared folder and return where."""
    path = f"{staging_root(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
