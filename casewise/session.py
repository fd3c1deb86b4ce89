"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on."""
    for name, value in RUNTIME_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("casewise")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_folder(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    ``spark.checkpoint.dir`` names it; without that it lies in the warehouse, which executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(work_folder(spark), f"{label}-{uuid.uuid4().hex}")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        # One process on one machine: what it staged goes with it.
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: later stages read files, so a lost executor costs a re-read and values that
    depend on the physical layout (row positions) cannot change between two uses. What was shuffled
    for it goes as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
