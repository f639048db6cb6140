"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All of it is SQL over three columns (source, key, size); texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, table

#: Cells by hash that a source's documents fall into, so that no task holds a whole source.
CELLS = 4096


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight): share of all sizes, split by weight, none above max_epochs sizes.

    A source is full if the common level (words for each unit of weight) reaches its cap / weight. Full sources come
    first in the order of that ratio, so the level follows from sums up to each place: it is
    (budget - caps of those before) / (weights from there on) at the first place whose ratio it doesn't exceed; later
    places give lower values. Sources without
    words have target 0; if the budget is above all caps together, every source ends at its cap.
    The relation has one row for each source, so the windows without a key see as many rows as there are sources.
    """
    cap, ratio = F.col("source_size") * F.lit(float(max_epochs)), F.col("source_size") * F.lit(float(max_epochs)) / F.col("weight")
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sources.withColumns({"cap": cap, "ratio": ratio, "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .drop("cap", "ratio", "budget", "level")
    )


def mix_sources(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """How many words the mixture takes of each document.

    Returns id, source, size, source_size, target, taken, repeats, part and text_hash: every document of a source is taken
    `repeats` whole times, and the seeded order of the source's documents gives the fraction left: those before the
    cut once more, the one on the cut with its first `part` words. So a source's words are its target, rounded.

    Null texts have size 0 and are taken 0 times. The null source is a source of its own, the last. Null ids and repeated rows
    are ordered by what else they have; equal rows are interchangeable. An empty table gives an empty table.
    """
    size = F.coalesce(F.expr(f"regexp_count(`{text_column}`, r'{WORD}')"), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))
    cell = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(1 << 32)) * CELLS / F.lit(1 << 32)
    rows = table(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"), key.alias("key"), F.xxhash64(text_column).alias("text_hash")).withColumn("cell", F.floor(cell).cast("int")), "sizes")
    per_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    per_cell = table(per_cell, "cells")
    ranked = (
        per_cell.groupBy("source")
        .agg(F.sum("cell_size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    )
    filled = table(
        water_fill(ranked, share, max_epochs)
        .withColumn("repeats", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
        .withColumn("rest", (F.round(F.col("target")) - F.col("repeats") * F.col("source_size")).cast("long"))
        .select("source", "source_size", "target", "repeats", F.greatest("rest", F.lit(0)).cast("long").alias("rest")),
        "targets",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = per_cell.withColumn("before", F.coalesce(F.sum("cell_size").over(running), F.lit(0)))
    joined = cells.join(filled, same(cells, filled)).select(cells["source"], "cell", "source_size", "target", "repeats", (F.col("rest") - F.col("before")).alias("left"), "cell_size")
    # the cut falls into one cell of each source: only its rows need an order among themselves
    cells = joined.withColumn("cut", (F.col("left") > 0) & (F.col("left") < F.col("cell_size")))
    wide = rows.join(cells, same(rows, cells) & (rows["cell"] == cells["cell"])).select("id", rows["source"], "size", "key", "text_hash", rows["cell"], "source_size", "target", "repeats", "left", "cut")
    plain = wide.filter(~F.col("cut")).withColumn("part", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source", "cell").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    partly = wide.filter("cut").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    return plain.unionByName(partly).select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken"), "repeats", F.col("part").cast("long").alias("part"), "text_hash"
    )


def apply_mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixture itself: docs with each row as often as it is taken, the last time perhaps cut behind `part` words.

    A cut text is the beginning of the text as it is, with its own white space, up to the end of its last word. Columns are those of docs; n_chars, where
    there is one, follows a cut text. Rows are matched by id, source and text; rows that are equal in all three all take the most that one of them does.
    """
    plan = mix_sources(docs, share, max_epochs, weights, seed, id_column, text_column, source_column)
    plan = plan.groupBy(F.col(id_column).alias("__id"), F.col(source_column).alias("__source"), F.col("text_hash").alias("__hash")).agg(F.max("repeats").alias("__repeats"), F.max("part").alias("__part"), F.max("size").alias("__size"))
    whole = F.col("__repeats") + F.when((F.col("__part") >= F.col("__size")) & (F.col("__size") > 0), 1).otherwise(0)
    cut = (F.col("__part") > 0) & (F.col("__part") < F.col("__size"))
    joined = docs.join(plan, docs[id_column].eqNullSafe(F.col("__id")) & docs[source_column].eqNullSafe(F.col("__source")) & (F.xxhash64(docs[text_column]) == F.col("__hash")))
    joined = joined.withColumn("__times", F.when(F.col("__size") == 0, F.lit(0)).otherwise(whole)).withColumn("__copy", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("__times").cast("int")), F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    # the characters of the first words and of the white space before each of them
    total = lambda array, n: F.aggregate(F.slice(array, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), F.lit(0), lambda s, x: s + F.char_length(x))
    words, blanks = (F.expr(f"regexp_extract_all(`{text_column}`, r'{p}', 0)") for p in (WORD, SPACE))
    size = total(words, F.col("__part")) + total(blanks, F.col("__part") - F.col(text_column).rlike(f"^{WORD}").cast("long"))
    first = F.left(F.col(text_column), size)
    out = {text_column: F.when(F.col("__copy"), first).otherwise(F.col(text_column))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__copy"), F.length(first).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(out).select(*docs.columns)
