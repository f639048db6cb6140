"""The same loads as streams: files that land are taken in micro-batches, with the batch helpers doing the idempotent writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.relational import only_new
from tidemark.sources.tables import Store


def landing_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_once(store: Store, layer: str, name: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink. A micro-batch that is run again after a failure finds its keys there and writes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        fresh = only_new(store.read(layer, name), batch, keys) if store.exists(layer, name) else batch.dropDuplicates(list(keys))
        store.write(fresh, layer, name, mode="append")

    return sink


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes all that has landed and stops: an incremental run whose watermark is the stream's own checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extra: tumbling counts with a watermark, for a stream or a batch alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "events")
