"""The six performance cases, each in its slow and its rewritten form (both must give the same result), and the probes of a feed's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between, in_months, month_of
from tidemark.registry import query
from tidemark.sources.tables import load

from .fixtures import DEALS_SQL, deals

_CASE1 = """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01' GROUP BY 1"""


def _by_month(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value")).orderBy("month")


@query(_CASE1)
def case1_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formatted month in the filter: neither partitions nor row groups can be skipped by it."""
    return _by_month(load(spark, sf_dir, "lineitem").filter(F.date_format("l_shipdate", "yyyy-MM").isin("1998-01", "1998-02", "1998-03")))


@query(_CASE1)
def case1_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same months as a half-open range on the bare column, which reaches the scan."""
    return _by_month(load(spark, sf_dir, "lineitem").filter(in_months(F.col("l_shipdate"), "1998-01-01", "1998-04-01")))


@query(
    """WITH b AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 1)
SELECT l_returnflag, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b)) GROUP BY 1"""
)
def case2_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's review. Its few keys are found first; the scan of the large side gets them as a broadcast filter."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    top = o.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1).select("o_custkey")
    mine = o.join(F.broadcast(top), "o_custkey", "left_semi").select("o_orderkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("day"))
    return lines.join(mine, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    """WITH d AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0 AS days FROM events)
SELECT event_type, count(days) AS transitions, round(quantile_cont(round(days, 4), 0.5), 3) AS p50, round(quantile_cont(round(days, 4), 0.9), 3) AS p90 FROM d GROUP BY 1"""
)
def case3_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time before entering each stage, by the stage entered: not the funnel's definition, which goes by the stage left."""
    days = days_between(F.col("ts"), F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 4)
    d = load(spark, sf_dir, "events").select("event_type", days.alias("days"))
    return d.groupBy("event_type").agg(F.count("days").alias("transitions"), F.round(F.percentile("days", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("days", F.lit(0.9)), 3).alias("p90"))


@query(f"WITH {DEALS_SQL} SELECT broker, count(*) AS open_deals, CAST(sum(value) AS DECIMAL(28,2)) AS open_value FROM deals WHERE is_open AND value BETWEEN 100000 AND 400000 GROUP BY 1 ORDER BY open_value DESC NULLS LAST, broker LIMIT 25")
def case4_open_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals(spark, sf_dir).filter("is_open").filter(F.col("value").between(100_000, 400_000)).groupBy("broker").agg(F.count("*").alias("open_deals"), F.sum("value").cast("decimal(28,2)").alias("open_value")).orderBy(F.desc_nulls_last("open_value"), "broker").limit(25)


_CASE5 = "SELECT count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-03-01' AND l_shipdate < TIMESTAMP '1999-03-15'"


def _fortnight(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


@query(_CASE5)
def case5_ts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fortnight(load(spark, sf_dir, "lineitem").filter(in_months(F.col("l_shipdate"), "1999-03-01", "1999-03-15")))


@query(_CASE5)
def case5b_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By date instead of time, as where tables are partitioned by it."""
    day = F.col("l_shipdate").cast("date")
    return _fortnight(load(spark, sf_dir, "lineitem").filter((day >= F.lit("1999-03-01").cast("date")) & (day < F.lit("1999-03-15").cast("date"))))


@query(
    f"""WITH {DEALS_SQL}, b AS (SELECT broker, count(*) AS n FROM deals GROUP BY 1), d AS (SELECT *, ntile(10) OVER (ORDER BY n DESC, broker) AS decile FROM b)
SELECT decile, count(*) AS brokers, CAST(sum(n) AS BIGINT) AS deals, round(CAST(sum(n) AS DOUBLE) / CAST(sum(sum(n)) OVER () AS DOUBLE), 4) AS share FROM d GROUP BY 1"""
)
def probe_broker_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of brokers by deals. Ranks follow from counts of equal n, so the window sees one row for each n and cell, not each broker."""
    b = deals(spark, sf_dir).groupBy("broker").agg(F.count("*").alias("n"))
    cells = b.groupBy("n").agg(F.count("*").alias("m"))
    before = Window.partitionBy().orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("all", F.sum("m").over(Window.partitionBy()))
    ranked = b.join(F.broadcast(starts.select("n", "start", "all")), "n").withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("n").orderBy("broker")))
    big, size = F.col("all") % 10, F.floor(F.col("all") / 10)
    edge = big * (size + 1)
    decile = F.when(F.col("rank") <= edge, F.ceil(F.col("rank") / (size + 1))).otherwise(big + F.ceil((F.col("rank") - edge) / size))
    return ranked.groupBy(decile.cast("int").alias("decile")).agg(F.count("*").alias("brokers"), F.sum("n").alias("deals")).withColumn("share", F.round(F.col("deals").cast("double") / F.sum("deals").over(Window.partitionBy()).cast("double"), 4))


@query(f"WITH {DEALS_SQL}, k AS (SELECT broker, CAST(isoyear(received_date) AS INTEGER) AS y, CAST(weekofyear(received_date) AS INTEGER) AS w, count(*) AS n FROM deals GROUP BY 1, 2, 3) SELECT count(*) AS blocks, count(*) FILTER (WHERE n > 1) AS blocks_with_more, CAST(sum(n - 1) AS BIGINT) AS candidates, max(n) AS largest FROM k")
def probe_dedupe_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("received_date")
    k = deals(spark, sf_dir).groupBy("broker", F.extract(F.lit("YEAROFWEEK"), d).alias("y"), F.extract(F.lit("WEEK"), d).alias("w")).agg(F.count("*").alias("n"))
    return k.agg(F.count("*").alias("blocks"), F.count(F.when(F.col("n") > 1, 1)).alias("blocks_with_more"), F.sum(F.col("n") - 1).alias("candidates"), F.max("n").alias("largest"))


@query(f"WITH {DEALS_SQL}, m AS (SELECT CAST(month(received_date) AS INTEGER) AS month, count(*) AS deals FROM deals GROUP BY 1) SELECT month, deals, round(CAST(deals AS DOUBLE) / avg(deals) OVER (), 4) AS season_index FROM m")
def probe_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = deals(spark, sf_dir).groupBy(F.month("received_date").alias("month")).agg(F.count("*").alias("deals"))
    return m.withColumn("season_index", F.round(F.col("deals").cast("double") / F.avg("deals").over(Window.partitionBy()), 4))


@query(f"WITH {DEALS_SQL} SELECT CASE WHEN is_won THEN 'won' WHEN is_lost THEN 'lost' ELSE 'open' END AS state, count(*) AS deals, round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 2) AS median_value FROM deals GROUP BY 1")
def probe_terminal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("is_won"), "won").when(F.col("is_lost"), "lost").otherwise("open")
    g = deals(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("deals"), F.round(F.percentile(F.col("value").cast("double"), F.lit(0.5)), 2).alias("median_value"))
    return g.withColumn("share", F.round(F.col("deals").cast("double") / F.sum("deals").over(Window.partitionBy()).cast("double"), 4))


@query(f"WITH {DEALS_SQL}, m AS (SELECT CAST(year(received_date) AS INTEGER) AS year, count(*) FILTER (WHERE month(received_date) = 1) AS january FROM deals GROUP BY 1) SELECT year, january, round(CAST(january AS DOUBLE) / nullif(lag(january) OVER (ORDER BY year), 0), 4) AS growth FROM m")
def probe_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = deals(spark, sf_dir).groupBy(F.year("received_date").alias("year")).agg(F.count(F.when(F.month("received_date") == 1, 1)).alias("january"))
    return m.withColumn("growth", F.round(F.col("january").cast("double") / F.nullif(F.lag("january").over(Window.partitionBy().orderBy("year")), F.lit(0)), 4))


@query("SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def probe_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("orders", "lineitem", "events", "customer", "part", "supplier"):
        one = load(spark, sf_dir, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag, count(*) AS lines, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY 1, 2")
def probe_channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(month_of(F.col("l_shipdate")).alias("month"), "l_returnflag").agg(F.count("*").alias("lines"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("open_lines"))
