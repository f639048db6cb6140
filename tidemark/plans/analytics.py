"""The fourteen analytical queries, over the fixture tables. Every order says where nulls go, every limit has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between, month_of, ratio
from tidemark.operators import dims, relational, scd2
from tidemark.registry import query
from tidemark.sources.tables import load

from .fixtures import DEALS_SQL, EVENTS_SQL, FUNNEL, SLA, deals, funnel_events
from .keep import kept

#: Dates from here on are typing errors that were kept; reports that read the latest date stop before.
HORIZON = "2027-01-01"


@query(
    f"""WITH {DEALS_SQL}
SELECT CAST(year(received_date) AS INTEGER) AS year, count(*) AS deals, CAST(sum(value) AS DECIMAL(28,2)) AS total_value, round(CAST(sum(value) AS DOUBLE) / count(*), 2) AS avg_value,
  count(*) FILTER (WHERE strftime(received_date, '%m-%d') >= '12-15' OR strftime(received_date, '%m-%d') <= '01-10') AS shutdown_deals,
  count(*) FILTER (WHERE is_won) AS won_deals, CAST(sum(value) FILTER (WHERE is_won) AS DECIMAL(28,2)) AS won_value, round(CAST(count(*) FILTER (WHERE is_won) AS DOUBLE) / count(*), 4) AS win_rate
FROM deals GROUP BY 1"""
)
def q01_flow_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the calendar of the days from the first deal to the last."""
    d = deals(spark, sf_dir)
    days = d.agg(F.explode(F.sequence(F.min("received_date"), F.max("received_date"))).alias("date"))
    d = d.join(F.broadcast(dims.calendar(days).select("date", "year", "is_shutdown")), F.col("received_date") == F.col("date"))  # one row a day
    return (
        d.groupBy("year")
        .agg(
            F.count("*").alias("deals"), F.sum("value").alias("total_value"), F.count(F.when(F.col("is_shutdown"), 1)).alias("shutdown_deals"), F.count(F.when(F.col("is_won"), 1)).alias("won_deals"), F.sum(F.when(F.col("is_won"), F.col("value"))).alias("won_value")
        )
        .select("year", "deals", F.col("total_value").cast("decimal(28,2)").alias("total_value"), ratio(F.col("total_value"), F.col("deals"), 2).alias("avg_value"), "shutdown_deals", "won_deals", F.col("won_value").cast("decimal(28,2)").alias("won_value"), ratio(F.col("won_deals"), F.col("deals"), 4).alias("win_rate"))
        .orderBy("year")
    )


@query(
    f"""WITH {EVENTS_SQL},
seq AS (SELECT *, lag(stage) OVER w AS from_stage, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0 AS days FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
entered AS (SELECT stage, count(DISTINCT user_id) AS users, count(*) AS entries FROM seq GROUP BY stage),
dwell AS (SELECT from_stage AS stage, quantile_cont(round(days, 4), 0.5) AS p50, quantile_cont(round(days, 4), 0.9) AS p90 FROM seq WHERE from_stage IS NOT NULL GROUP BY 1),
ranked AS (SELECT e.*, d.p50, d.p90, lag(users) OVER (ORDER BY e.stage) AS before, first_value(users) OVER (ORDER BY e.stage) AS top FROM entered e LEFT JOIN dwell d USING (stage))
SELECT ['signup','view','click','purchase','error'][stage] AS event_type, stage, users, entries,
  CASE WHEN stage < 5 THEN round(CAST(users AS DOUBLE) / before, 4) END AS from_previous, CASE WHEN stage < 5 THEN round(CAST(users AS DOUBLE) / top, 4) END AS from_first,
  CASE WHEN stage < 5 THEN round(p50, 3) END AS dwell_p50, CASE WHEN stage < 5 THEN round(p90, 3) END AS dwell_p90 FROM ranked"""
)
def q02_funnel_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who entered a stage goes by the stage entered, time spent by the stage left."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = funnel_events(spark, sf_dir).withColumns({"from_stage": F.lag("stage").over(w), "days": days_between(F.col("ts"), F.lag("ts").over(w), 4)})
    entered = seq.groupBy("stage").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("entries"))
    dwell = seq.filter("from_stage is not null").groupBy(F.col("from_stage").alias("stage")).agg(F.percentile("days", F.lit(0.5)).alias("p50"), F.percentile("days", F.lit(0.9)).alias("p90"))
    by = Window.partitionBy().orderBy("stage")  # one row for each stage
    open_ = F.col("stage") < len(FUNNEL)
    return entered.join(F.broadcast(dwell), "stage", "left").select(
        F.element_at(F.array(*map(F.lit, FUNNEL)), F.col("stage")).alias("event_type"), "stage", "users", "entries", F.when(open_, ratio(F.col("users"), F.lag("users").over(by), 4)).alias("from_previous"), F.when(open_, ratio(F.col("users"), F.first("users").over(by), 4)).alias("from_first"), F.when(open_, F.round("p50", 3)).alias("dwell_p50"), F.when(open_, F.round("p90", 3)).alias("dwell_p90")
    ).orderBy("stage")


@query(
    f"""WITH {DEALS_SQL},
q AS (SELECT CAST(year(received_date) AS INTEGER) AS year, CAST(quarter(received_date) AS INTEGER) AS quarter, count(*) AS deals, sum(value) AS value FROM deals GROUP BY 1, 2),
l AS (SELECT *, lag(value) OVER w AS previous, lag(value, 4) OVER w AS year_ago FROM q WINDOW w AS (ORDER BY year, quarter))
SELECT year, quarter, deals, CAST(value AS DECIMAL(28,2)) AS value, CAST(previous AS DECIMAL(28,2)) AS previous_value, CAST(year_ago AS DECIMAL(28,2)) AS year_ago_value,
  round((CAST(value AS DOUBLE) - CAST(previous AS DOUBLE)) / nullif(CAST(previous AS DOUBLE), 0) * 100, 2) AS qoq_pct, round((CAST(value AS DOUBLE) - CAST(year_ago AS DOUBLE)) / nullif(CAST(year_ago AS DOUBLE), 0) * 100, 2) AS yoy_pct,
  CASE WHEN year_ago IS NULL THEN 'no baseline' ELSE 'compared' END AS note FROM l"""
)
def q03_qoq_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = deals(spark, sf_dir).groupBy(F.year("received_date").alias("year"), F.quarter("received_date").alias("quarter")).agg(F.count("*").alias("deals"), F.sum("value").cast("decimal(28,2)").alias("value"))
    w = Window.partitionBy().orderBy("year", "quarter")  # one row for each quarter
    q = q.withColumns({"previous_value": F.lag("value").over(w), "year_ago_value": F.lag("value", 4).over(w)})
    change = lambda c: F.round((F.col("value").cast("double") - F.col(c).cast("double")) / F.nullif(F.col(c).cast("double"), F.lit(0.0)) * 100, 2)
    return q.withColumns({"qoq_pct": change("previous_value"), "yoy_pct": change("year_ago_value"), "note": F.when(F.col("year_ago_value").isNull(), "no baseline").otherwise("compared")}).orderBy("year", "quarter")


@query(
    f"""WITH {DEALS_SQL},
top AS (SELECT broker FROM deals WHERE is_won GROUP BY broker ORDER BY sum(value) DESC NULLS LAST, broker LIMIT 1),
m AS (SELECT CAST(date_trunc('month', received_date) AS DATE) AS month, count(*) AS deals, sum(value) AS value FROM deals WHERE is_won AND broker = (SELECT broker FROM top) AND received_date < DATE '2027-01-01' GROUP BY 1)
SELECT month, deals, CAST(value AS DECIMAL(28,2)) AS value, CAST(sum(value) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS running_value,
  round(avg(CAST(value AS DOUBLE)) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3_rows, round(avg(CAST(value AS DOUBLE)) OVER (ORDER BY month RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW), 2) AS ma3_range,
  count(*) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rows_in_frame, count(*) OVER (ORDER BY month RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS months_in_frame FROM m"""
)
def q04_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best closer's months. Frames by row count and by calendar differ where months are missing."""
    won = deals(spark, sf_dir).filter("is_won")
    top = won.groupBy("broker").agg(F.sum("value").alias("v")).orderBy(F.desc_nulls_last("v"), "broker").limit(1).select("broker")
    m = won.filter(F.col("received_date") < F.lit(HORIZON).cast("date")).join(F.broadcast(top), "broker", "left_semi").groupBy(month_of(F.col("received_date")).alias("month")).agg(F.count("*").alias("deals"), F.sum("value").cast("decimal(28,2)").alias("value"))
    m = m.withColumn("__m", F.year("month") * 12 + F.month("month"))
    w = Window.partitionBy().orderBy("__m")  # one broker's months
    rows, months = w.rowsBetween(-2, 0), w.rangeBetween(-2, 0)
    value = F.col("value").cast("double")
    return m.withColumns(
        {"running_value": F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(28,2)"), "ma3_rows": F.round(F.avg(value).over(rows), 2), "ma3_range": F.round(F.avg(value).over(months), 2), "rows_in_frame": F.count("*").over(rows), "months_in_frame": F.count("*").over(months)}
    ).drop("__m").orderBy("month")


@query(
    lambda: f"""WITH {DEALS_SQL}, {SNAPSHOT_SQL},
bound AS (SELECT max(received_date) AS d FROM deals),
b AS (SELECT cur.broker, cur.attribute AS agency, count(*) AS deals, CAST(sum(value) / 100000 AS BIGINT) AS band, sum(value) AS value FROM deals d JOIN dim hist ON hist.broker = d.broker AND CAST(received_date AS TIMESTAMP) >= hist.valid_from AND CAST(received_date AS TIMESTAMP) < hist.valid_to JOIN dim cur ON cur.broker = hist.broker AND cur.valid_to = TIMESTAMP '9999-12-31' WHERE received_date > (SELECT d - INTERVAL 1 YEAR FROM bound) GROUP BY 1, 2)
SELECT b.broker, c_name AS name, c_mktsegment AS segment, agency, deals, band, CAST(value AS DECIMAL(28,2)) AS value, rank() OVER (ORDER BY band DESC) AS rank, dense_rank() OVER (ORDER BY band DESC) AS dense_rank,
  count(*) OVER (ORDER BY band DESC RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1 AS tied_peers, ntile(4) OVER (ORDER BY band DESC, b.broker) AS quartile, round(CAST(value AS DOUBLE) / CAST(sum(value) OVER () AS DOUBLE), 6) AS share
FROM b JOIN customer ON c_custkey = b.broker ORDER BY rank, b.broker LIMIT 20"""
)
def q05_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by value in bands, so that ties occur. A deal's key is that of a version, perhaps a superseded one: it counts for who that is today, with today's agency."""
    fact, dim = by_version(spark, sf_dir)
    bound = deals(spark, sf_dir).agg(F.add_months(F.max("received_date"), -12).alias("__after"))  # one row
    d = fact.join(F.broadcast(bound), F.col("received_date") > F.col("__after"))
    d = relational.current_of_version(d.drop("broker"), dim, "broker_sk", "broker", ["broker", "attribute"])
    b = d.groupBy("broker", F.col("attribute").alias("agency")).agg(F.count("*").alias("deals"), F.sum("value").alias("value")).withColumn("band", F.round(F.col("value") / 100000, 0).cast("long"))
    b = kept(b)  # read for the ranks, the total and the rows
    total = b.agg(F.sum("value").cast("double").alias("__total"))  # one row
    ranked = relational.ranks(b, "band", ["broker"], 4).join(F.broadcast(total)).withColumn("share", F.round(F.col("value").cast("double") / F.col("__total"), 6)).withColumnRenamed("tile", "quartile")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return ranked.orderBy("rank", "broker").limit(20).join(c, F.col("broker") == F.col("c_custkey")).select("broker", "name", "segment", "agency", "deals", "band", F.col("value").cast("decimal(28,2)").alias("value"), "rank", "dense_rank", "tied_peers", "quartile", "share").orderBy("rank", "broker")


@query(
    f"""WITH {DEALS_SQL}
SELECT c_mktsegment AS segment, count(*) AS deals, count(*) FILTER (WHERE priority = '1-URGENT') AS urgent, count(*) FILTER (WHERE priority = '2-HIGH') AS high, count(*) FILTER (WHERE priority = '3-MEDIUM') AS medium, count(*) FILTER (WHERE priority = '4-NOT SPECIFIED') AS unspecified, count(*) FILTER (WHERE priority = '5-LOW') AS low,
  count(DISTINCT broker) FILTER (WHERE is_won) AS winning_brokers, round(quantile_cont(CAST(value AS DOUBLE), 0.5) FILTER (WHERE is_won), 2) AS won_median, round(quantile_cont(CAST(value AS DOUBLE), 0.5) FILTER (WHERE is_lost), 2) AS lost_median
FROM deals JOIN customer ON c_custkey = broker GROUP BY 1"""
)
def q06_pivot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    value = F.col("value").cast("double")
    return (
        deals(spark, sf_dir).join(c, F.col("broker") == F.col("c_custkey")).groupBy("segment")
        .agg(
            F.count("*").alias("deals"), *[F.count(F.when(F.col("priority") == p, 1)).alias(n) for p, n in names.items()], F.count_distinct(F.when(F.col("is_won"), F.col("broker"))).alias("winning_brokers"), F.round(F.percentile(F.when(F.col("is_won"), value), F.lit(0.5)), 2).alias("won_median"), F.round(F.percentile(F.when(F.col("is_lost"), value), F.lit(0.5)), 2).alias("lost_median")
        )
        .orderBy(F.desc("deals"), "segment")
    )


@query(
    f"""WITH {DEALS_SQL},
v AS (SELECT CAST(value AS DOUBLE) AS x, log10(CAST(value AS DOUBLE)) AS l FROM deals WHERE value > 0),
b AS (SELECT CAST(CASE WHEN l < 3.0 THEN 0 WHEN l >= 6.0 THEN 13 ELSE floor((l - 3.0) / 0.25) + 1 END AS INTEGER) AS bucket, x FROM v),
g AS (SELECT bucket, count(*) AS deals, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, avg(x) AS mean, stddev_samp(x) AS sd FROM b GROUP BY 1)
SELECT bucket, CASE WHEN bucket BETWEEN 1 AND 12 THEN round(3.0 + (bucket - 1) * 0.25, 2) END AS log_from, CASE WHEN bucket BETWEEN 1 AND 12 THEN round(3.0 + bucket * 0.25, 2) END AS log_to, deals, round(CAST(deals AS DOUBLE) / sum(deals) OVER (), 4) AS share,
  repeat('#', CAST(round(30.0 * deals / max(deals) OVER ()) AS INTEGER)) AS bar, round(p50, 2) AS p50, round(p90, 2) AS p90, round(mean, 2) AS mean, round(sd, 2) AS stddev, round(mean / p50, 4) AS mean_to_median FROM g"""
)
def q07_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value").cast("double")
    b = deals(spark, sf_dir).filter("value > 0").select(x.alias("x"), F.width_bucket(F.log10(x), F.lit(3.0), F.lit(6.0), F.lit(12)).cast("int").alias("bucket"))
    g = b.groupBy("bucket").agg(F.count("*").alias("deals"), F.percentile("x", F.lit([0.5, 0.9])).alias("p"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    every = Window.partitionBy()  # one row for each bucket
    inside = F.col("bucket").between(1, 12)
    return g.select(
        "bucket", F.when(inside, F.round(3.0 + (F.col("bucket") - 1) * 0.25, 2)).alias("log_from"), F.when(inside, F.round(3.0 + F.col("bucket") * 0.25, 2)).alias("log_to"), "deals", F.round(F.col("deals").cast("double") / F.sum("deals").over(every), 4).alias("share"),
        F.expr("repeat('#', cast(round(30.0 * deals / max(deals) over (), 0) as int))").alias("bar"), F.round(F.col("p")[0], 2).alias("p50"), F.round(F.col("p")[1], 2).alias("p90"), F.round("m", 2).alias("mean"), F.round("sd", 2).alias("stddev"), F.round(F.col("m") / F.col("p")[0], 4).alias("mean_to_median"),
    ).orderBy("bucket")


@query(
    f"""WITH {DEALS_SQL},
last AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last_touch FROM lineitem GROUP BY 1),
as_at AS (SELECT max(received_date) AS d FROM deals WHERE received_date < DATE '2027-01-01'),
t AS (SELECT priority, value, CASE priority WHEN '1-URGENT' THEN 60 WHEN '2-HIGH' THEN 120 WHEN '3-MEDIUM' THEN 240 WHEN '4-NOT SPECIFIED' THEN 360 ELSE 480 END AS sla_days, CAST((SELECT d FROM as_at) - last_touch AS INTEGER) AS idle FROM deals JOIN last ON l_orderkey = deal WHERE is_open)
SELECT priority, sla_days, count(*) AS open_deals, count(*) FILTER (WHERE idle > 2 * sla_days) AS at_risk, CAST(sum(value) AS DECIMAL(28,2)) AS open_value, CAST(coalesce(sum(value) FILTER (WHERE idle > 2 * sla_days), 0) AS DECIMAL(28,2)) AS at_risk_value,
  round(CAST(count(*) FILTER (WHERE idle > 2 * sla_days) AS DOUBLE) / count(*), 4) AS at_risk_share, max(idle) AS longest_idle FROM t GROUP BY 1, 2"""
)
def q08_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open deals idle for more than twice their service level, as at the last plausible date; both sides of the share are of one grain."""
    last = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("last_touch"))
    d = deals(spark, sf_dir)
    as_at = d.filter(F.col("received_date") < F.lit(HORIZON).cast("date")).agg(F.max("received_date").alias("as_at"))
    levels = spark.createDataFrame(list(SLA.items()), "priority string, sla_days int")
    t = d.filter("is_open").join(last, F.col("l_orderkey") == F.col("deal")).join(F.broadcast(as_at)).join(F.broadcast(levels), "priority").withColumn("idle", F.datediff("as_at", "last_touch"))
    late = F.col("idle") > 2 * F.col("sla_days")
    return (
        t.groupBy("priority", "sla_days")
        .agg(F.count("*").alias("open_deals"), F.count(F.when(late, 1)).alias("at_risk"), F.sum("value").cast("decimal(28,2)").alias("open_value"), F.coalesce(F.sum(F.when(late, F.col("value"))), F.lit(0)).cast("decimal(28,2)").alias("at_risk_value"), F.round(F.avg(late.cast("double")), 4).alias("at_risk_share"), F.max("idle").alias("longest_idle"))
        .orderBy(F.desc("open_value"), "priority")
    )


@query(
    f"""WITH {EVENTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM ev)
SELECT event_type, stage, count(*) AS definitive, CAST(sum(n) - count(*) AS BIGINT) AS suppressed, max(n) AS most, min(ts) AS earliest, max(ts) AS latest FROM r WHERE rn = 1 GROUP BY 1, 2"""
)
def q09_qualify_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitive event of each user and type: the latest. A pair of aggregates does what a window and a filter would, with a combine before the shuffle."""
    last = funnel_events(spark, sf_dir).groupBy("user_id", "event_type", "stage").agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
    return last.groupBy("event_type", "stage").agg(F.count("*").alias("definitive"), (F.sum("n") - F.count("*")).alias("suppressed"), F.max("n").alias("most"), F.min("last.ts").alias("earliest"), F.max("last.ts").alias("latest")).orderBy("stage")


@query(
    f"""WITH {DEALS_SQL},
b AS (SELECT c_mktsegment AS segment, broker, sum(value) AS value FROM deals JOIN customer ON c_custkey = broker WHERE is_open GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rn, CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY segment) AS DOUBLE) AS share FROM b WINDOW w AS (PARTITION BY segment ORDER BY value DESC NULLS LAST, broker))
SELECT segment, count(*) AS brokers, CAST(sum(value) AS DECIMAL(28,2)) AS open_value, max(broker) FILTER (WHERE rn = 1) AS top_broker, round(max(share) FILTER (WHERE rn = 1), 5) AS top1_share, round(sum(share) FILTER (WHERE rn <= 5), 5) AS top5_share, round(sum(share) FILTER (WHERE rn <= 10), 5) AS top10_share,
  round(sum(share * share) * 10000, 2) AS hhi, CASE WHEN sum(share * share) * 10000 >= 2500 THEN 'concentrated' WHEN sum(share * share) * 10000 >= 1500 THEN 'moderate' ELSE 'spread' END AS verdict FROM r GROUP BY 1"""
)
def q10_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    b = deals(spark, sf_dir).filter("is_open").join(c, F.col("broker") == F.col("c_custkey")).groupBy("segment", "broker").agg(F.sum("value").alias("value"))
    # totals first, then the ten largest of each segment as a bounded heap: no window holds a segment
    totals = b.groupBy("segment").agg(F.count("*").alias("brokers"), F.sum("value").alias("total"), F.sum(F.col("value").cast("double") * F.col("value").cast("double")).alias("squares"))
    cells = Window.partitionBy("segment", F.pmod(F.xxhash64("broker"), F.lit(64))).orderBy(F.desc_nulls_last("value"), "broker")
    first = b.withColumn("cell_rank", F.row_number().over(cells)).filter("cell_rank <= 10")
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc_nulls_last("value"), "broker"))).filter("rn <= 10")
    top = first.groupBy("segment").agg(F.max(F.when(F.col("rn") == 1, F.col("broker"))).alias("top_broker"), *[F.sum(F.when(F.col("rn") <= n, F.col("value"))).cast("double").alias(f"v{n}") for n in (1, 5, 10)])
    total = F.col("total").cast("double")
    hhi = F.col("squares") / (total * total) * 10000
    return totals.join(top, "segment").select(
        "segment", "brokers", F.col("total").cast("decimal(28,2)").alias("open_value"), "top_broker", *[F.round(F.col(f"v{n}") / total, 5).alias(f"top{n}_share") for n in (1, 5, 10)], F.round(hhi, 2).alias("hhi"), F.when(hhi >= 2500, "concentrated").when(hhi >= 1500, "moderate").otherwise("spread").alias("verdict")
    ).orderBy(F.desc("top5_share"), "segment")


@query(
    f"""WITH {DEALS_SQL},
a AS (SELECT DISTINCT broker, CAST(year(received_date) * 4 + quarter(received_date) - 1 AS INTEGER) AS q FROM deals),
f AS (SELECT broker, min(q) AS cohort FROM a GROUP BY 1),
c AS (SELECT cohort, q - cohort AS k, count(*) AS active FROM a JOIN f USING (broker) GROUP BY 1, 2),
s AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1),
b AS (SELECT max(q) AS last FROM a),
g AS (SELECT cohort, size, k, last FROM s, b, (SELECT unnest(range(0, 27)) AS k) WHERE cohort + k <= last)
SELECT CAST(cohort // 4 AS VARCHAR) || '-Q' || CAST(cohort % 4 + 1 AS VARCHAR) AS cohort, size, {", ".join(f"max(round(CAST(coalesce(active, 0) AS DOUBLE) / size * 100, 1)) FILTER (WHERE k = {k}) AS q{k}" for k in (0, 1, 2, 4, 8, 12, 16))},
  count(*) FILTER (WHERE coalesce(active, 0) = 0) AS silent_quarters FROM g LEFT JOIN c USING (cohort, k) GROUP BY 1, 2"""
)
def q11_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brokers by the quarter of their first deal. 0.0 is a quarter that was watched and silent, null one that hasn't come yet."""
    a = deals(spark, sf_dir).select("broker", (F.year("received_date") * 4 + F.quarter("received_date") - 1).alias("q")).distinct()
    first = a.groupBy("broker").agg(F.min("q").alias("cohort"))
    active = a.join(first, "broker").groupBy("cohort", (F.col("q") - F.col("cohort")).alias("k")).agg(F.count("*").alias("active"))
    size = first.groupBy("cohort").agg(F.count("*").alias("size"))
    last = a.agg(F.max("q").alias("last"))
    grid = size.join(F.broadcast(last)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(26)))).filter("cohort + k <= last")
    g = grid.join(active, ["cohort", "k"], "left").withColumn("rate", F.round(F.coalesce("active", F.lit(0)).cast("double") / F.col("size") * 100, 1))
    return (
        g.groupBy("cohort", "size")
        .agg(*[F.max(F.when(F.col("k") == k, F.col("rate"))).alias(f"q{k}") for k in (0, 1, 2, 4, 8, 12, 16)], F.count(F.when(F.coalesce("active", F.lit(0)) == 0, 1)).alias("silent_quarters"))
        .withColumn("cohort", F.concat(F.floor(F.col("cohort") / 4).cast("string"), F.lit("-Q"), (F.col("cohort") % 4 + 1).cast("string")))
        .orderBy("cohort")
    )


@query(
    lambda: f"""WITH {DEALS_SQL}, {SNAPSHOT_SQL},
m AS (SELECT DISTINCT cur.broker, CAST(year(received_date) * 12 + month(received_date) - 1 AS INTEGER) AS m FROM deals d JOIN dim hist ON hist.broker = d.broker AND CAST(received_date AS TIMESTAMP) >= hist.valid_from AND CAST(received_date AS TIMESTAMP) < hist.valid_to JOIN dim cur ON cur.broker = hist.broker AND cur.valid_to = TIMESTAMP '9999-12-31'),
r AS (SELECT broker, m, m - row_number() OVER (PARTITION BY broker ORDER BY m) AS g FROM m),
i AS (SELECT broker, min(m) AS first, max(m) AS last, count(*) AS months FROM r GROUP BY broker, g),
b AS (SELECT max(m) AS upto FROM m)
SELECT broker, make_date(first // 12, first % 12 + 1, 1) AS first_month, make_date(last // 12, last % 12 + 1, 1) AS last_month, months, count(*) OVER (PARTITION BY broker) AS streaks, (last = upto) AS is_live, upto - last AS months_since_end
FROM i, b ORDER BY months DESC, broker, first LIMIT 20"""
)
def q12_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without a gap, by person: from a deal's version to who that is today before the islands are made, so that a new version is no gap."""
    fact, dim = by_version(spark, sf_dir)
    today = relational.current_of_version(fact.drop("broker"), dim, "broker_sk", "broker", ["broker"])
    m = today.select("broker", (F.year("received_date") * 12 + F.month("received_date") - 1).alias("m"))
    at = m.agg(F.max("m").alias("at"))
    i = relational.islands(m, ["broker"], "m").withColumn("streaks", F.count("*").over(Window.partitionBy("broker")))
    date = lambda c: F.make_date(F.floor(F.col(c) / 12).cast("int"), (F.col(c) % 12 + 1).cast("int"), F.lit(1))
    return i.join(F.broadcast(at)).orderBy(F.desc("length"), "broker", "first").limit(20).select("broker", date("first").alias("first_month"), date("last").alias("last_month"), F.col("length").alias("months"), "streaks", (F.col("last") == F.col("at")).alias("is_live"), (F.col("at") - F.col("last")).alias("months_since_end"))


@query(
    """WITH RECURSIVE e AS (SELECT 'R' || r_regionkey AS node, NULL AS up, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier),
own AS (SELECT 'S' || l_suppkey AS node, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem GROUP BY 1),
t AS (SELECT node AS root, node, 0 AS depth, node AS path FROM e WHERE up IS NULL UNION ALL SELECT t.root, e.node, t.depth + 1, t.path || '>' || e.node FROM t JOIN e ON e.up = t.node),
v AS (SELECT t.*, coalesce(own.value, 0) AS value FROM t LEFT JOIN own USING (node))
SELECT root, node, depth, path, CAST(value AS DECIMAL(28,2)) AS own_value, CAST(sum(value) OVER (PARTITION BY root) AS DECIMAL(28,2)) AS group_value, count(*) OVER (PARTITION BY root) AS group_nodes, round(CAST(value AS DOUBLE) / nullif(CAST(sum(value) OVER (PARTITION BY root) AS DOUBLE), 0), 6) AS share FROM v"""
)
def q13_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations over suppliers as one adjacency list, with what each group ships."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = load(spark, sf_dir, "region").select(node("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up"))
    e = e.union(load(spark, sf_dir, "nation").select(node("N", "n_nationkey"), node("R", "n_regionkey"))).union(load(spark, sf_dir, "supplier").select(node("S", "s_suppkey"), node("N", "s_nationkey")))
    own = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value")).select(node("S", "l_suppkey").alias("node"), "value")
    t = kept(relational.tree_paths(e, "node", "up").join(own, "node", "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("decimal(28,2)")))  # the recursion runs once
    group = t.groupBy("root").agg(F.sum("value").cast("decimal(28,2)").alias("group_value"), F.count("*").alias("group_nodes"))
    return t.join(group, "root").select("root", "node", "depth", F.array_join("path", ">").alias("path"), F.col("value").alias("own_value"), "group_value", "group_nodes", F.round(F.col("value").cast("double") / F.nullif(F.col("group_value").cast("double"), F.lit(0.0)), 6).alias("share")).orderBy(F.desc("group_value"), "root", "depth", F.desc("own_value"), "node")


#: Customers by month, with the priority that most of the month's orders have: a full snapshot of what is known then.
SNAPSHOT_SQL = """snap AS (SELECT broker, month, priority AS attribute FROM (SELECT broker, CAST(date_trunc('month', received_date) AS DATE) AS month, priority, row_number() OVER (PARTITION BY broker, date_trunc('month', received_date) ORDER BY count(*) DESC, priority) AS rn FROM deals GROUP BY 1, 2, 3, date_trunc('month', received_date)) WHERE rn = 1),
chg AS (SELECT *, lag(attribute) OVER (PARTITION BY broker ORDER BY month) AS before FROM snap),
dim AS (SELECT broker, attribute, CASE WHEN month = (SELECT min(month) FROM snap) THEN TIMESTAMP '1900-01-01' ELSE CAST(month AS TIMESTAMP) END AS valid_from, coalesce(lead(CAST(month AS TIMESTAMP)) OVER (PARTITION BY broker ORDER BY month), TIMESTAMP '9999-12-31') AS valid_to FROM chg WHERE before IS DISTINCT FROM attribute)"""


def broker_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = deals(spark, sf_dir).groupBy("broker", month_of(F.col("received_date")).alias("month"), "priority").agg(F.count("*").alias("n"))
    best = per.groupBy("broker", "month").agg(F.min(F.struct((-F.col("n")).alias("n"), "priority")).alias("best"))
    return best.select("broker", "month", F.col("best.priority").alias("attribute"), F.lit(1).alias("line"))


def broker_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.versions(broker_snapshots(spark, sf_dir), "broker", "month", ["attribute"], "line")


_STORED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def by_version(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deals with the key of the broker's version at receipt (broker_sk), and the dimension: a fact and a dimension of the warehouse, built once in an application and read by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        dim = kept(scd2.with_keys(kept(broker_dim(spark, sf_dir)), "broker", "broker_sk"))
        d = deals(spark, sf_dir).withColumn("at", F.col("received_date").cast("timestamp_ntz"))
        _STORED[key] = kept(relational.point_in_time(d, dim, "broker", "broker", "at", "broker_sk").filter("broker_sk != -1")), dim
    return _STORED[key]


#: An agency is what a broker's version says, with the branch that the broker is of.
@query(
    f"""WITH {DEALS_SQL}, {SNAPSHOT_SQL},
f AS (SELECT deal, d.broker, value, dim.attribute || ' ' || CAST(d.broker % 7 AS VARCHAR) AS was, cur.attribute || ' ' || CAST(d.broker % 7 AS VARCHAR) AS now FROM deals d JOIN dim ON dim.broker = d.broker AND CAST(received_date AS TIMESTAMP) >= dim.valid_from AND CAST(received_date AS TIMESTAMP) < dim.valid_to JOIN dim cur ON cur.broker = d.broker AND cur.valid_to = TIMESTAMP '9999-12-31' WHERE is_won),
w AS (SELECT was AS attribute, count(*) AS n, sum(value) AS v FROM f GROUP BY 1), i AS (SELECT now AS attribute, count(*) AS n, sum(value) AS v FROM f GROUP BY 1)
SELECT coalesce(w.attribute, i.attribute) AS attribute, coalesce(w.n, 0) AS deals_as_was, coalesce(i.n, 0) AS deals_as_is, CAST(coalesce(w.v, 0) AS DECIMAL(28,2)) AS value_as_was, CAST(coalesce(i.v, 0) AS DECIMAL(28,2)) AS value_as_is, coalesce(i.n, 0) - coalesce(w.n, 0) AS deals_delta, CAST(coalesce(i.v, 0) - coalesce(w.v, 0) AS DECIMAL(28,2)) AS value_delta
FROM w FULL JOIN i ON w.attribute = i.attribute ORDER BY abs(coalesce(i.v, 0) - coalesce(w.v, 0)) DESC, 1 LIMIT 15"""
)
def q14_as_was(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Won deals by the agency that their broker was of at receipt and by today's. From the version's key to the person, and from there to today's version."""
    fact, dim = by_version(spark, sf_dir)
    fact = fact.filter("is_won").select("broker_sk", "value").join(dim.select("broker_sk", F.col("attribute").alias("__was"), F.col("broker").alias("__person")), "broker_sk")
    today = dim.filter("is_current").select(F.col("broker").alias("__today"), F.col("attribute").alias("__now"))
    branch = F.concat(F.lit(" "), (F.col("__person") % 7).cast("string"))
    both = fact.join(today, F.col("__person") == F.col("__today")).select("value", F.concat("__was", branch).alias("was"), F.concat("__now", branch).alias("now"))
    side = lambda c, n, v: both.groupBy(F.col(c).alias("attribute")).agg(F.count("*").alias(n), F.sum("value").alias(v))
    j = side("was", "deals_as_was", "value_as_was").join(side("now", "deals_as_is", "value_as_is"), "attribute", "full").fillna(0)
    money = lambda c: F.col(c).cast("decimal(28,2)").alias(c)
    delta = (F.col("value_as_is") - F.col("value_as_was")).cast("decimal(28,2)")
    return j.select("attribute", "deals_as_was", "deals_as_is", money("value_as_was"), money("value_as_is"), (F.col("deals_as_is") - F.col("deals_as_was")).alias("deals_delta"), delta.alias("value_delta")).orderBy(F.desc(F.abs("value_delta")), "attribute").limit(15)
