"""Sessions with the settings that results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(name: str = "tidemark", cpus: int | str = "*", shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session that reports in UTC and plans adaptively. A master or memory that the environment sets is left as it is."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()
