"""Generated and derived dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import numbered, small

#: Stages with order, service level in days and kind: fixed values.
STAGES = [(0, "NOT_APPLICABLE", 0, None, False), (1, "RECEIVED", 1, 1, False), (2, "TRIAGED", 2, 3, False), (3, "QUALIFIED", 3, 10, False), (4, "UNDERWRITING", 4, 14, False), (5, "OFFER", 5, 21, False), (6, "DUE_DILIGENCE", 6, 30, False), (7, "LEGAL", 7, 30, False), (8, "CLOSED_WON", 8, None, True), (9, "LOST", 9, None, True), (10, "STALLED", 10, None, True)]
#: Fixed holidays as month-day; the year-end shutdown runs from the first to the second day: fixed values.
HOLIDAYS = ["01-01", "03-21", "04-27", "05-01", "06-16", "08-09", "09-24", "12-16", "12-25", "12-26"]
SHUTDOWN = ("12-15", "01-10")


def dim_stage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage_sk int, stage_code string, stage_order int, sla_days int, is_terminal boolean")


def with_kinds(stages: DataFrame) -> DataFrame:
    """Adds is_won, is_lost, is_stalled and holds: a stage is open, or it is exactly one kind of closed."""
    kinds = {"is_won": "CLOSED_WON", "is_lost": "LOST", "is_stalled": "STALLED"}
    out = stages.withColumns({k: F.col("stage_code") == code for k, code in kinds.items()})
    n = sum((F.col(k).cast("int") for k in kinds), F.lit(0))
    return out.withColumn("holds", (F.col("is_terminal") == (n > 0)) & (n <= 1))


def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    return calendar(spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")))


def calendar(days: DataFrame) -> DataFrame:
    """One row for each day of a column date. The fiscal year runs from March to February and is named after the year in which it ends."""
    d = F.col("date")
    month_day = F.date_format(d, "MM-dd")
    shifted = F.add_months(d, 10)
    return days.select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).alias("date_sk"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.extract(F.lit("WEEK"), d).cast("int").alias("iso_week"),
        F.extract(F.lit("DAYOFWEEK_ISO"), d).cast("int").alias("iso_day"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.year(shifted).alias("fiscal_year"), F.quarter(shifted).alias("fiscal_quarter"), (F.extract(F.lit("DAYOFWEEK_ISO"), d) >= 6).alias("is_weekend"), month_day.isin(HOLIDAYS).alias("is_holiday"), ((month_day >= SHUTDOWN[0]) | (month_day <= SHUTDOWN[1])).alias("is_shutdown"),
    )


def junk(parts: Sequence[tuple[DataFrame, str]], sk: str) -> DataFrame:
    """All combinations of short lists of values, numbered in their own order, with an unknown member -1."""
    out = None
    for values, column in parts:
        v = small(values.select(column).distinct())
        out = v if out is None else out.crossJoin(v)
    columns = [c for _, c in parts]
    numbered = out.withColumn(sk, F.row_number().over(Window.partitionBy().orderBy(*columns)))  # a product of short lists
    unknown = out.limit(1).select(*[F.lit("Unknown").alias(c) for c in columns], F.lit(-1).alias(sk))
    return numbered.unionByName(unknown)


def with_unknown(dim: DataFrame, sk: str, values: dict) -> DataFrame:
    """dim with its unknown member; columns that aren't given are null there."""
    spark = dim.sparkSession
    row = spark.range(1).select(*[F.lit(-1 if c == sk else values.get(c)).cast(dim.schema[c].dataType).alias(c) for c in dim.columns])
    return dim.filter(F.col(sk) != -1).unionByName(row)


def type1_upsert(dim: DataFrame, latest: DataFrame, nk: str, sk: str, attributes: Sequence[str]) -> DataFrame:
    """Unseen keys are numbered on from the largest (by cells, see `numbered`), attributes of matched keys overwritten, nulls too, the rest left as it is."""
    top = dim.agg(F.coalesce(F.max(sk), F.lit(0)).alias("__top"))  # one row
    new = numbered(latest.join(dim.select(nk), nk, "left_anti"), nk, [nk], sk).join(F.broadcast(top)).withColumn(sk, (F.col("__top") + F.col(sk)).cast("long"))
    matched = F.col("s.__matched").isNotNull()
    old = dim.alias("t").join(latest.withColumn("__matched", F.lit(True)).alias("s"), nk, "left").select(F.col(nk), F.col(f"t.{sk}").alias(sk), *[F.when(matched, F.col(f"s.{a}")).otherwise(F.col(f"t.{a}")).alias(a) for a in attributes])
    return old.unionByName(new.select(nk, sk, *attributes))


def assign_parents(members: DataFrame, nk: str, tier: str, place: str, above: dict[str, str]) -> DataFrame:
    """Adds parent: of the tier above, the first by name in the same place, else the first by name at all."""
    up = members.select(F.col(nk).alias("__p"), F.col(tier).alias("__tier"), F.col(place).alias("__place"))
    local = up.groupBy("__tier", "__place").agg(F.min("__p").alias("__local"))
    anywhere = up.groupBy("__tier").agg(F.min("__p").alias("__any"))
    target = F.lit(None).cast("string")
    for low, high in above.items():
        target = F.when(F.col(tier) == low, high).otherwise(target)
    out = members.withColumn("__up", target)
    out = out.join(local, (F.col("__up") == F.col("__tier")) & (F.col(place) == F.col("__place")), "left").drop("__tier", "__place")
    out = out.join(small(anywhere), F.col("__up") == F.col("__tier"), "left")
    return out.withColumn("parent", F.coalesce("__local", "__any")).drop("__up", "__tier", "__local", "__any")
