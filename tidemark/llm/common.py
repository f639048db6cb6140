"""Shared plumbing of the training-data operators: tables in the shared folder, Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch. Texts differ in length by four orders of magnitude, so bytes matter more.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees. Only a local session without one (tests, notebooks) gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    if not base:
        base = (Path.cwd() / "spark-warehouse" / "shared").as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex[:12]}/{name}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_folder = path.rsplit("/", 1)[0]
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that nothing is going to read again, nor to compute again from."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._tidemark_folder)
        folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that stay small when texts are long. Sizes of batches are settings of the session, which are lowered here, never raised."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(f, schema)


def texts(column: pa.Array) -> list[str]:
    """Null is empty; bytes that are no UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") if x else "" for x in column.cast(pa.binary()).to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def attach(rows: DataFrame, known: DataFrame, key: str, copies: str) -> DataFrame:
    """rows joined with known, which has one row for each value of key that rows has, and how many rows have it.

    Rows without a key get nulls and aren't shuffled. Values above a ten-thousandth of all rows, of which there are fewer than
    10,000, go to all tasks, so a value that a third of the rows has doesn't end up in one; the others meet in a shuffle.
    """
    total = known.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()["n"]
    columns = [c for c in known.columns if c not in (key, copies)]
    often = F.col(copies) > max(256, total // 10_000)
    hot = known.filter(often).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in columns])
    marked = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    out = marked.filter("__hot is not null").select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in columns])
    out = out.unionByName(marked.filter("__hot is null").select(*rows.columns).join(known.filter(~often).select(key, *columns), key, "left").select(*rows.columns, *columns))
    return out.unionByName(rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in columns]))


def remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo. A null id counts as an empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % divisor


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal values in the first `keys` columns (integers, not null) of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and last != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def deal(rows: DataFrame, key: str, size: int, columns: list[str]) -> DataFrame:
    """(key, i, j, side, columns) of rows (key, tied, columns): every chunk of rows that aren't tied (side 0) meets every chunk of all rows (side 1), chunks having about `size` rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"), F.count(F.when(~F.col("tied"), 1)).alias("__rest")).filter("__rest > 0")
    chunks = lambda c: F.ceil(F.col(c) / size).cast("int")
    counts = counts.select(key, chunks("__n").alias("__wide"), chunks("__rest").alias("__high"))
    both = rows.join(counts, key)
    lot = lambda c: F.pmod(F.xxhash64("class"), F.col(c)).cast("int")
    rest = both.filter(~F.col("tied")).select(key, lot("__high").alias("i"), F.explode(F.sequence(F.lit(0), F.col("__wide") - 1)).alias("j"), F.lit(0).alias("side"), *columns)
    return rest.unionByName(both.select(key, F.explode(F.sequence(F.lit(0), F.col("__high") - 1)).alias("i"), lot("__wide").alias("j"), F.lit(1).alias("side"), *columns))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node reachable. Neighbours' least labels and pointer jumping, to a fixed point.

    Every round is a join and an aggregate over tables in the shared folder; only a count reaches the driver. A hub is
    a long run of one join key, which skewed joins split.
    """
    first = both = table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(b, a)).filter("a != b").distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    written = labels
    for _ in range(64):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to_node"), F.col("label").alias("to_label"))
        step = table(lower.join(jump, F.col("to") == F.col("to_node")).select("node", "old", F.least("to", "to_label").alias("label")), "labels")
        changed = step.filter("old != label").limit(1).count()
        forget(written)  # the next round reads the new labels alone
        labels, written = step.select("node", "label"), step
        if not changed:
            forget(first)
            return labels
    raise RuntimeError("components did not settle in 64 rounds")


class Forest:
    """Union-find over 0..n-1, in one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
