"""Scalar functions over injected text and dates, joins in their plain forms, and small generated relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import dims, relational
from tidemark.registry import query
from tidemark.sources.tables import load

from .fixtures import DEALS_SQL, DRAW_SQL, deals

#: Injected spellings, dates and amounts, by the key modulo their number: fixed values.
SPELLINGS = ["  INDUSTRIAL", "Mixed  use ", "Erf 4821 Sandton (Pty) Ltd", "Acme, Limited", "", "   ", None, "O'Neil & Sons Pty Ltd", "plain"]
DATES = ["2026-02-30", "31/02/2025", "yesterday", "2025-13-04", "0000-00-00", None, "2024-02-29", "2024-12-30 10:00:00", "2023-02-29"]
AMOUNTS = ["R 42 mil", "TBC", "see attached", "1,2 miljoen", "R42m ono", "n/a", "42", "-42.50", "100000.00", None, "1e5"]


def pick(values: list, key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def injected(spark: SparkSession, sf_dir: str, values: list) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", pick(values, F.col("o_orderkey")).alias("x"))


def injected_sql(values: list) -> str:
    return f"x AS (SELECT o_orderkey, {sql_list(values)}[CAST(o_orderkey % {len(values)} AS INTEGER) + 1] AS x FROM orders)"


@query(f"WITH {injected_sql(SPELLINGS)} SELECT o_orderkey, nullif(trim(regexp_replace(x, '\\s+', ' ', 'g')), '') AS squeezed FROM x")
def norm_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir, SPELLINGS).select("o_orderkey", S.squeeze(F.col("x")).alias("squeezed"))


@query(
    f"""WITH {injected_sql(SPELLINGS)} SELECT o_orderkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '\\s+(\\(pty\\) ltd|pty ltd|proprietary limited|limited|ltd|inc|cc)\\.?\\s*$', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS name FROM x"""
)
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir, SPELLINGS).select("o_orderkey", S.match_name(F.col("x")).alias("name"))


@query(f"WITH {injected_sql(DATES)} SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(substr(x, 1, 10) AS DATE) IS NOT NULL END AS is_date FROM x WHERE x IS DISTINCT FROM '0000-00-00'")
def is_real_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir, DATES).filter(~F.col("x").eqNullSafe("0000-00-00")).select("o_orderkey", S.is_calendar_date(F.col("x")).alias("is_date"))


@query(f"WITH {injected_sql(AMOUNTS)} SELECT o_orderkey, regexp_matches(x, '^-?\\d+(\\.\\d+)?$') AS is_number, CASE WHEN regexp_matches(x, '^-?\\d+(\\.\\d+)?$') THEN try_cast(x AS DECIMAL(18,2)) END AS amount FROM x")
def is_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return injected(spark, sf_dir, AMOUNTS).select("o_orderkey", S.is_number(x).alias("is_number"), F.when(S.is_number(x), S.money(x)).alias("amount"))


@query("SELECT o_orderkey, " + DRAW_SQL.format("'seed' || CAST(o_orderkey AS VARCHAR)") + " AS draw FROM orders")
def fn_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", S.unit_draw("seed", F.col("o_orderkey").cast("string")).alias("draw"))


@query(f"WITH {DEALS_SQL} SELECT deal, CAST(isoyear(received_date) AS VARCHAR) || '-' || lpad(CAST(weekofyear(received_date) AS VARCHAR), 2, '0') AS week FROM deals")
def iso_week_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals(spark, sf_dir).select("deal", S.iso_week(F.col("received_date")).alias("week"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    return load(spark, sf_dir, "orders").join(low, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query(
    """WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s ON c.nation = s.nation"""
)
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").fillna(0, subset=["customers", "suppliers"])


@query("SELECT r_name, p AS priority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of values, five by five."""
    p = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    return load(spark, sf_dir, "region").select("r_name").crossJoin(relational.small(p))


@query(
    f"""WITH {DEALS_SQL}, s AS (SELECT broker, deal, received_date AS a, received_date + INTERVAL 10 DAY AS b FROM deals)
SELECT x.broker, x.deal AS first_deal, y.deal AS second_deal FROM s x JOIN s y ON x.broker = y.broker AND y.deal > x.deal AND x.a < y.b AND y.a < x.b"""
)
def overlap_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one broker's ten-day intervals that overlap: the key is an equality, the overlap two inequalities."""
    s = deals(spark, sf_dir).select("broker", "deal", F.col("received_date").alias("a"), F.date_add("received_date", 10).alias("b"))
    x, y = s.alias("x"), s.alias("y")
    return x.join(y, (F.col("x.broker") == F.col("y.broker")) & (F.col("y.deal") > F.col("x.deal")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))).select("x.broker", F.col("x.deal").alias("first_deal"), F.col("y.deal").alias("second_deal"))


@query(
    f"""WITH {DEALS_SQL}, m AS (SELECT CAST(date_trunc('month', received_date) AS DATE) AS month, count(*) AS deals FROM deals GROUP BY 1)
SELECT a.month, a.deals, b.deals AS year_ago, round(CAST(a.deals AS DOUBLE) / b.deals - 1, 4) AS drift FROM m a JOIN m b ON b.month = a.month - INTERVAL 12 MONTH"""
)
def yoy_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = deals(spark, sf_dir).groupBy(S.month_of(F.col("received_date")).alias("month")).agg(F.count("*").alias("deals"))
    b = m.select(F.add_months("month", 12).alias("month"), F.col("deals").alias("year_ago"))
    return m.join(b, "month").withColumn("drift", F.round(F.col("deals").cast("double") / F.col("year_ago") - 1, 4))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return load(spark, sf_dir, "events").filter(k.isNotNull()).select("event_id", k.alias("k"), (k.cast("long") * 2).alias("twice"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def listagg_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || CAST(c_nationkey AS VARCHAR)), 1, 8)) AS BIGINT)) AS DECIMAL(38,0)) AS checksum FROM customer")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.fingerprint(load(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey"])


@query(
    """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(isodow(d) AS INTEGER) AS iso_day,
  CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end, CAST(year(d + INTERVAL 10 MONTH) AS INTEGER) AS fiscal_year, CAST(quarter(d + INTERVAL 10 MONTH) AS INTEGER) AS fiscal_quarter, isodow(d) >= 6 AS is_weekend, strftime(d, '%m-%d') IN ('01-01','03-21','04-27','05-01','06-16','08-09','09-24','12-16','12-25','12-26') AS is_holiday,
  strftime(d, '%m-%d') >= '12-15' OR strftime(d, '%m-%d') <= '01-10' AS is_shutdown FROM generate_series(DATE '2019-01-01', DATE '2027-12-31', INTERVAL 1 DAY) AS g(d)"""
)
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.dim_date(spark, "2019-01-01", "2027-12-31")


@query(
    """WITH s AS (SELECT DISTINCT o_orderstatus AS status FROM orders), p AS (SELECT DISTINCT o_orderpriority AS priority FROM orders)
SELECT status, priority, CAST(row_number() OVER (ORDER BY status, priority) AS INTEGER) AS source_sk FROM s CROSS JOIN p UNION ALL SELECT 'Unknown', 'Unknown', -1"""
)
def junk_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return dims.junk([(o.select(F.col("o_orderstatus").alias("status")), "status"), (o.select(F.col("o_orderpriority").alias("priority")), "priority")], "source_sk")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation_sk, n_name AS nation, CAST(n_regionkey AS BIGINT) AS region_sk FROM nation UNION ALL SELECT -1, 'Unknown', NULL")
def unknown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_sk"), F.col("n_name").alias("nation"), F.col("n_regionkey").cast("long").alias("region_sk"))
    return dims.with_unknown(n, "nation_sk", {"nation": "Unknown"})


@query("SELECT stage_sk, stage_code, stage_order, sla_days, is_terminal FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in s) + ")" for s in dims.STAGES) + ") AS t(stage_sk, stage_code, stage_order, sla_days, is_terminal)")
def dim_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.dim_stage(spark)


@query(
    """WITH a AS (SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier WHERE s_suppkey % 3 != 0),
old AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS agency_sk, nation, balance FROM a),
b AS (SELECT s_name AS name, s_nationkey AS nation, s_acctbal + 1 AS balance FROM supplier WHERE s_suppkey % 2 = 0)
SELECT old.name, agency_sk, coalesce(b.nation, old.nation) AS nation, round(coalesce(b.balance, old.balance), 2) AS balance FROM old LEFT JOIN b USING (name)
UNION ALL SELECT name, (SELECT max(agency_sk) FROM old) + row_number() OVER (ORDER BY substr(md5(name), 1, 3), name), nation, round(balance, 2) FROM b WHERE name NOT IN (SELECT name FROM old)"""
)
def type1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    old = s.filter("s_suppkey % 3 != 0").select("name", F.row_number().over(Window.partitionBy().orderBy("name")).cast("long").alias("agency_sk"), "nation", "balance")
    new = s.filter("s_suppkey % 2 = 0").select("name", "nation", (F.col("balance") + 1).alias("balance"))
    return dims.type1_upsert(old, new, "name", "agency_sk", ["nation", "balance"]).withColumn("balance", F.round("balance", 2))


@query(
    """WITH m AS (SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'National' WHEN 1 THEN 'Regional' ELSE 'Boutique' END AS tier, s_nationkey AS place FROM supplier)
SELECT name, tier, place, CASE tier WHEN 'Regional' THEN coalesce((SELECT min(name) FROM m u WHERE u.tier = 'National' AND u.place = m.place), (SELECT min(name) FROM m u WHERE u.tier = 'National')) WHEN 'Boutique' THEN coalesce((SELECT min(name) FROM m u WHERE u.tier = 'Regional' AND u.place = m.place), (SELECT min(name) FROM m u WHERE u.tier = 'Regional')) END AS parent FROM m"""
)
def hierarchy_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, ["National", "Regional", "Boutique"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("tier"), F.col("s_nationkey").alias("place"))
    return dims.assign_parents(m, "name", "tier", "place", {"Regional": "National", "Boutique": "Regional"})


@query(
    f"""WITH {DEALS_SQL}, m AS (SELECT n_nationkey AS nation, CAST(date_trunc('month', received_date) AS DATE) AS month, count(*) AS deals, count(*) FILTER (WHERE is_won) AS won FROM deals JOIN customer ON c_custkey = broker JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
g AS (SELECT n_nationkey AS nation, CAST(month AS DATE) AS month FROM nation CROSS JOIN (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month))
SELECT nation, month, coalesce(deals, 0) AS deals, coalesce(won, 0) AS won, coalesce(deals, 0) = 0 AS is_inactive FROM g LEFT JOIN m USING (nation, month)"""
)
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    m = deals(spark, sf_dir).join(c, F.col("broker") == F.col("c_custkey")).groupBy("nation", S.month_of(F.col("received_date")).alias("month")).agg(F.count("*").alias("deals"), F.count(F.when(F.col("is_won"), 1)).alias("won"))
    months = m.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    members = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return relational.dense_grid(members, months, m, ["nation", "month"], ["deals", "won"]).withColumn("is_inactive", F.col("deals") == 0)
