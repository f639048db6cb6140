"""The fixture tables in the terms of the warehouse: orders are deals, their events and their parties are the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import load

#: Event types in the order of a funnel, and service levels by priority in days: fixed values.
FUNNEL = ["signup", "view", "click", "purchase", "error"]
SLA = {"1-URGENT": 60, "2-HIGH": 120, "3-MEDIUM": 240, "4-NOT SPECIFIED": 360, "5-LOW": 480}


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("deal"), F.col("o_custkey").alias("broker"), F.col("o_orderdate").cast("date").alias("received_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), (F.col("o_orderstatus") == "F").alias("is_won"), (F.col("o_orderstatus") == "P").alias("is_lost"), (F.col("o_orderstatus") == "O").alias("is_open"), F.col("o_orderpriority").alias("priority")
    )


def funnel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    order = F.array_position(F.array(*map(F.lit, FUNNEL)), F.col("event_type")).cast("int")
    return e.select("event_id", "user_id", "ts", "event_type", order.alias("stage"), "value")


#: The same in SQL, for the oracles.
DEALS_SQL = """deals AS (SELECT o_orderkey AS deal, o_custkey AS broker, CAST(o_orderdate AS DATE) AS received_date, CAST(o_totalprice AS DECIMAL(18,2)) AS value,
  o_orderstatus = 'F' AS is_won, o_orderstatus = 'P' AS is_lost, o_orderstatus = 'O' AS is_open, o_orderpriority AS priority FROM orders)"""
EVENTS_SQL = """ev AS (SELECT event_id, user_id, ts, event_type, CAST(list_position(['signup','view','click','purchase','error'], event_type) AS INTEGER) AS stage, value FROM events)"""
#: A draw from md5, as unit_draw() has it.
DRAW_SQL = "(CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296.0)"
