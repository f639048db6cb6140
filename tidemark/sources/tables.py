"""Reading and writing: fixture tables, landing feeds in text form, layered Parquet tables with atomic replacement."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What every landing table ends in.
INGEST = [T.StructField("source_batch_id", T.StringType(), False), T.StructField("ingested_at", T.TimestampNTZType(), False), T.StructField("source_file", T.StringType(), False), T.StructField("raw_line_no", T.LongType(), False), T.StructField("payload_hash", T.StringType(), False)]


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table. Its schema is read from a footer once in a session, not for every query."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


class ContractError(ValueError):
    """A feed whose columns aren't the declared ones, or a load that would double a table."""


def landing_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    r"""A bulk feed: tab-separated, \N for null, backslash escapes, a header that must be the contract's columns in order."""
    header = spark.read.text(path).limit(1).collect()
    found = header[0][0].split("\t") if header else []
    if found != list(columns):
        raise ContractError(f"columns {found}, declared {list(columns)}")
    return spark.read.schema(landing_schema(columns)).option("sep", "\t").option("nullValue", "\\N").option("header", True).option("quote", "").option("escape", "\\").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("nullValue", "\\N").option("header", True).option("quote", "").csv(path)


def with_ingest(df: DataFrame, batch: str, at: str, file: str, line: str) -> DataFrame:
    """Ingest metadata behind the source columns; the payload hash is over all of these."""
    columns = df.columns
    body = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return df.withColumns({"source_batch_id": F.lit(batch), "ingested_at": F.lit(at).cast("timestamp_ntz"), "source_file": F.lit(file), "raw_line_no": F.col(line).cast("long"), "payload_hash": F.md5(body.cast("binary"))})


#: Pointers that stay for readers who have listed them already.
KEPT_POINTERS = 10


class Store:
    """Tables of one warehouse under a root that every executor sees: <root>/<layer>/<table>/<version>, and numbered pointers to versions.

    A table is replaced by writing a new version and then the next pointer; the greatest one is in force. A pointer appears whole, by a rename
    to a name that nothing has yet: readers see the old table or the new one at any moment, a crash leaves the old one, and of two writers that
    started from the same table one fails. A table can be computed from its own last version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self, layer: str, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{layer}/{name}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[9:21]) for n in names if n.startswith("_pointer-") and n.endswith(".json"))

    def _pointer(self, layer: str, name: str, number: int):
        return self._path(f"{self.root}/{layer}/{name}/_pointer-{number:012d}.json")

    def versions(self, layer: str, name: str) -> list[str]:
        """Directories of the version in force, in the order they were appended."""
        numbers = self._pointers(layer, name)
        if not numbers:
            return []
        stream = self._fs.open(self._pointer(layer, name, numbers[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, layer: str, name: str, parts: list[str], after: int) -> None:
        fresh = self._path(f"{self.root}/{layer}/{name}/_next-{uuid.uuid4().hex}.json")
        stream = self._fs.create(fresh, True)
        stream.write(json.dumps(parts).encode())
        stream.close()
        target = self._pointer(layer, name, after + 1)
        # some file systems rename onto an existing file, so look first; those that don't say no by themselves
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise ContractError(f"{layer}.{name} was replaced meanwhile")
        for old in self._pointers(layer, name)[:-KEPT_POINTERS]:
            self._fs.delete(self._pointer(layer, name, old), False)

    def exists(self, layer: str, name: str) -> bool:
        return bool(self.versions(layer, name))

    def read(self, layer: str, name: str) -> DataFrame:
        parts = self.versions(layer, name)
        if not parts:
            raise FileNotFoundError(f"{layer}.{name}")
        return self.spark.read.parquet(*parts) if len(parts) == 1 else self.spark.read.option("mergeSchema", "false").parquet(*parts)

    def write(self, df: DataFrame, layer: str, name: str, mode: str = "replace", partition_by: Sequence[str] = ()) -> DataFrame:
        """mode: replace, append, or new, which refuses a table that has rows."""
        numbers = self._pointers(layer, name)
        before = self.versions(layer, name)
        if mode == "new" and before and self.read(layer, name).limit(1).count():
            raise ContractError(f"{layer}.{name} has rows; say replace or append")
        part = f"{self.root}/{layer}/{name}/{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(part)
        self._point(layer, name, [*before, part] if mode == "append" else [part], numbers[-1] if numbers else 0)
        return self.read(layer, name)
