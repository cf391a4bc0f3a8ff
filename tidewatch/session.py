"""Session settings every operator relies on."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options: UTC clock, instants (not wall clock) from Parquet, AQE with skew handling."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", name: str = "tidewatch") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidewatch-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that spark.checkpoint.dir names.

    Where it is unset, driver and executors must be one process, which then has a folder of its own until it ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def to_wall_clock(df: DataFrame) -> DataFrame:
    """Cast instants to zone-free timestamps, the form in which results are handed out."""
    casts = {
        f.name: F.col(f"`{f.name}`").cast(T.TimestampNTZType())
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampType)
    }
    return df.withColumns(casts) if casts else df
