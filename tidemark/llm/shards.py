"""Sharding by Karmarkar-Karp differencing: near-equal bytes in every shard, equal texts together.

The differencing itself is sequential, so it sees a bounded number of items: groups of equal texts that are heavy by
themselves (at most HEAVY of them can be above 1/HEAVY of all bytes) and cells, into which the light groups fall by
hash. Both are sums that Spark aggregates; which item a row belongs to follows from its text alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

CELLS, HEAVY, SLOTS = 4096, 4096, 1024


def difference(sizes: Iterable[tuple[int, int]], parts: int) -> dict[int, int]:
    """Item to part, for (item, size). Two partial partitions with the largest spreads are combined at a time, the largest part of one with the smallest of the other."""
    heap = []
    for item, size in sorted(sizes):
        sums = [0] * (parts - 1) + [size]
        heap.append((-size, item, sums, [[]] * (parts - 1) + [[item]]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, own = heapq.heappop(heap)
        _, _, b, more = heapq.heappop(heap)
        joined = sorted(((x + y, p, q) for (x, p), (y, q) in zip(zip(a, own), zip(reversed(b), reversed(more)))), key=lambda z: z[0])
        least = joined[0][0]
        # only differences matter from here on; an item list is a pair, flattened at the end
        heapq.heappush(heap, (-(joined[-1][0] - least), tie, [z[0] - least for z in joined], [(z[1], z[2]) for z in joined]))
    out: dict[int, int] = {}
    for part, tree in enumerate(heap[0][3] if heap else []):
        todo = [tree]
        while todo:
            x = todo.pop()
            for y in x:
                if isinstance(y, int):
                    out[y] = part
                else:
                    todo.append(y)
    return out


def balance(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Puts rows into shards 0 to shards - 1 so that bytes are near equal and equal texts share a shard.

    Returns id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (from 0 without gaps in a shard, by
    cell of the id's hash and then id) and grown_shard (null: this law has none). Null texts count as empty and share the empty
    text's group. Repeated rows and null ids get slots of their own. An empty table gives an empty table.
    A group of copies above 1/shards of all bytes can't be balanced away: its shard is as large as it is.
    """
    data = F.coalesce(F.col(text_column), F.lit(""))
    binary = data.cast("binary")
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), F.xxhash64(data, F.octet_length(data)).alias("group"), F.pmod(F.xxhash64(F.lit("slot"), id_column), F.lit(SLOTS)).cast("int").alias("slot_cell")
    ).withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "group"), F.lit(CELLS)).cast("int"))
    rows = table(rows, "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.first("cell").alias("cell"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = {r["group"]: (r["cell"], r["size"]) for r in groups.filter(F.col("size") * HEAVY > total).collect()}  # fewer than HEAVY
    cells = {r["cell"]: r["size"] for r in rows.groupBy("cell").agg(F.sum("size").alias("size")).collect()}  # at most CELLS
    for cell, size in heavy.values():
        cells[cell] -= size
    numbers = {g: CELLS + k for k, g in enumerate(sorted(heavy))}
    parts = difference([(c, s) for c, s in cells.items() if s] + [(numbers[g], heavy[g][1]) for g in heavy], shards)
    by_cell = F.array(*[F.lit(parts.get(c, 0)) for c in range(CELLS)])
    spark = docs.sparkSession
    placed = rows
    if heavy:
        alone = spark.createDataFrame([(g, parts[numbers[g]]) for g in heavy], "group long, own_shard int")
        placed = placed.join(F.broadcast(alone), "group", "left")
        placed = placed.withColumn("shard", F.coalesce("own_shard", F.element_at(by_cell, F.col("cell") + 1)))
    else:
        placed = placed.withColumn("shard", F.element_at(by_cell, F.col("cell") + 1))
    placed = placed.select("id", "size", "text_crc32", "group", "shard", "slot_cell")
    running = Window.partitionBy("shard").orderBy("slot_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "slot_cell").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0))).select("shard", "slot_cell", "start")
    within = Window.partitionBy("shard", "slot_cell").orderBy(F.col("id").asc_nulls_last(), "group")
    return (
        placed.join(F.broadcast(starts), ["shard", "slot_cell"])  # at most shards * SLOTS rows
        .withColumn("slot", F.col("start") + F.row_number().over(within) - 1)
        .select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
