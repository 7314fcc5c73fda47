"""The local Spark session of tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(master: str = "local[8]", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """UTC, ANSI, adaptive execution; a cluster brings its own session instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName("chronofold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
