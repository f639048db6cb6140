"""Cutting lineage between the passes of an iteration."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parts in which large tables are shuffled one after the other.
SLICES = 4


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. A local session that names none gets one of its own, as in tests; on a cluster no
    folder of this machine would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    return (base or (Path.cwd() / "spark-warehouse" / "checkpoints").as_uri()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later readers start from files that every executor sees."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


class short_shuffles:
    """Within it, shuffle files go as soon as what made them has run, not when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(_CLEANUP)
        self.conf.set(_CLEANUP, "true")

    def __exit__(self, *_) -> None:
        self.conf.set(_CLEANUP, self.before)


def stored(parts: DataFrame | Iterable[DataFrame]) -> DataFrame:
    """A compressed table in the shared folder, of one part or of several that are written one after the other. It has fewer bytes than a
    checkpoint, whose rows are as in memory, and readers take only the columns that they need."""
    parts = [parts] if isinstance(parts, DataFrame) else parts
    spark = path = schema = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_root(spark)}/stored-{uuid.uuid4().hex[:12]}"
        with short_shuffles(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_in = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing is going to read again."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_in)
        folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def slices(key: Column) -> list[Column]:
    """Conditions that part a table by a key; every row, those without a key too, is in one."""
    return [F.pmod(F.xxhash64(key), F.lit(SLICES)) == k for k in range(SLICES)]
