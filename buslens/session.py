"""Spark session settings the engine is tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Event time prints and truncates in UTC unless the caller chooses otherwise.
    "spark.sql.session.timeZone": "UTC",
    # Coalesce small and split skewed shuffle partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode, and decoding
    # many columns easily makes larger ones. With this limit such stages use the
    # split projection code instead, which measured up to four times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Quartile sketches of a few thousand signals stay in a hash table; above the
    # default of 128 groups Spark would sort the whole input instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Streaming state larger than executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app: str = "buslens", input_terabytes: float = 1.0) -> SparkSession.Builder:
    """Session builder for a cluster.

    Shuffles start with partitions of about 256 MB for the given input size;
    adaptive execution merges those that turn out small.
    """
    session = SparkSession.builder.appName(app)
    partitions = max(200, int(input_terabytes * 4096))
    session = session.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        session = session.config(key, value)
    return session


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "buslens") -> SparkSession:
    """Single-machine session for tests and measurements."""
    partitions = "8" if cores == "*" else str(cores)
    session = builder(app)
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        session = session.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="buslens-"))
    spark = (
        session
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
