"""Runs, watermarks and incremental loads: what a load has taken is committed last, after the gate, and never goes back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import BEGINNING
from tidemark.operators.relational import merge_rows, once, only_new
from tidemark.sources.tables import Store

RUNS = "run_id long, mode string, status string, rows_in long, rows_out long, note string"
MARKS = "stream string, watermark_ts timestamp_ntz, run_id long"


@dataclass
class RunContext:
    """One run over a store: opened as RUNNING, closed as SUCCESS or FAILED with counts read back from the tables."""

    store: Store
    streams: tuple[str, ...]
    run_id: int = 0
    mode: str = "first"
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        spark = self.store.spark
        if not self.store.exists("meta", "load_run"):
            self.store.write(spark.createDataFrame([], RUNS), "meta", "load_run")
        if not self.store.exists("meta", "load_watermark"):
            start = datetime.strptime(BEGINNING, "%Y-%m-%d %H:%M:%S")
            self.store.write(spark.createDataFrame([(s, start, 0) for s in self.streams], MARKS), "meta", "load_watermark")
        runs = self.store.read("meta", "load_run")
        self.run_id = (runs.agg(F.max("run_id")).first()[0] or 0) + 1
        self.mode = "incremental" if runs.filter("status = 'SUCCESS'").limit(1).count() else "first"
        self._record("RUNNING", "")

    def _record(self, status: str, note: str) -> None:
        row = self.store.spark.createDataFrame([(self.run_id, self.mode, status, self.counts.get("in", 0), self.counts.get("out", 0), note)], RUNS)
        self.store.write(merge_rows(self.store.read("meta", "load_run"), row, ["run_id"]), "meta", "load_run")

    def watermark(self, stream: str) -> datetime:
        return self.store.read("meta", "load_watermark").filter(F.col("stream") == stream).first()["watermark_ts"]

    def since(self, df: DataFrame, stream: str, at: str = "ingested_at") -> DataFrame:
        """Rows that no committed run has taken. The mark is a literal, so the filter reaches the scan; the first run takes all by the same path."""
        return df.filter(F.col(at) > F.lit(self.watermark(stream)).cast("timestamp_ntz"))

    def commit(self, reached: dict[str, datetime | None], rows_in: int, rows_out: int) -> None:
        """The last step of a run. Marks only go forward, and not to nothing."""
        marks = self.store.spark.createDataFrame([(s, t, self.run_id) for s, t in reached.items() if t is not None], MARKS)
        now = self.store.read("meta", "load_watermark")
        ahead = F.col("s.watermark_ts") > F.col("t.watermark_ts")
        update = {"watermark_ts": F.greatest("t.watermark_ts", "s.watermark_ts"), "run_id": F.when(ahead, F.col("s.run_id")).otherwise(F.col("t.run_id"))}
        self.store.write(merge_rows(now, marks, ["stream"], update), "meta", "load_watermark")
        self.counts = {"in": rows_in, "out": rows_out}
        self._record("SUCCESS", "")

    def fail(self, note: str) -> None:
        self._record("FAILED", note)


def incremental_load(store: Store, landing: DataFrame, stream: str, target: tuple[str, str], keys: list[str], check: Callable[[DataFrame], None] | None = None) -> int:
    """Appends landing rows beyond the watermark to a table, each key once; checks, then commits. Returns the rows written. A failed check leaves the mark where it was."""
    run = RunContext(store, (stream,))
    layer, name = target
    batch = run.since(landing, stream)
    reached = batch.agg(F.max("ingested_at").alias("t"), F.count("*").alias("n")).first()
    fresh = only_new(store.read(layer, name), batch, keys) if store.exists(layer, name) else once(batch, keys)
    before = store.read(layer, name).count() if store.exists(layer, name) else 0
    store.write(fresh, layer, name, mode="append")
    written = store.read(layer, name).count() - before
    try:
        if check:
            check(store.read(layer, name))
    except Exception as e:
        run.fail(str(e)[:500])
        raise
    run.commit({stream: reached["t"]}, reached["n"], written)
    return written


def run_log(spark: SparkSession, root: str) -> DataFrame:
    return Store(spark, root).read("meta", "load_run")
