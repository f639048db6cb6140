"""Composite operators over feeds that are derived from the fixture tables, with defects injected by md5 draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import dedupe, facts, relational, scd2, sequence, staging
from tidemark.plans.keep import kept
from tidemark.registry import query
from tidemark.sources.generator import BAD_DATES, BAD_VALUES, SECTORS
from tidemark.sources.tables import load

from .analytics import SNAPSHOT_SQL, broker_dim, broker_snapshots
from .fixtures import DEALS_SQL, DRAW_SQL, deals

#: Shares of injected defects: dates, values, nulls, negatives, thousandths, in this order along one draw.
CUTS = {"date": 0.02, "value": 0.05, "null": 0.08, "negative": 0.11, "small": 0.15}


# --- slowly changing dimensions -------------------------------------------------------------------------------------


@query(f"WITH {DEALS_SQL}, {SNAPSHOT_SQL} SELECT broker, attribute, valid_from, valid_to, valid_to = TIMESTAMP '9999-12-31' AS is_current FROM dim")
def scd2_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broker_dim(spark, sf_dir).select("broker", "attribute", "valid_from", "valid_to", "is_current")


#: What tells order lines apart, in DuckDB: line numbers repeat within an order.
LINE_SQL = "(CAST(l_orderkey AS HUGEINT) * 10000000000000000000000000 + CAST(l_linenumber AS HUGEINT) * 10000000000000000000000 + CAST(l_partkey AS HUGEINT) * 10000000000 + CAST(l_suppkey AS HUGEINT))"
PART_SQL = f"""feed AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, row_number() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE) ORDER BY {LINE_SQL}) AS rn FROM lineitem),
chg AS (SELECT part, day, flag, lag(flag) OVER (PARTITION BY part ORDER BY day) AS before FROM feed WHERE rn = 1),
pdim AS (SELECT part, flag, CAST(day AS TIMESTAMP) AS valid_from, coalesce(lead(CAST(day AS TIMESTAMP)) OVER (PARTITION BY part ORDER BY day), TIMESTAMP '9999-12-31') AS valid_to FROM chg WHERE before IS DISTINCT FROM flag)"""


def line_key() -> F.Column:
    """What tells order lines apart, as one number of up to 38 digits: orders and parts below 10^12, suppliers below 10^10."""
    return F.expr("cast(cast(l_orderkey as decimal(12,0)) * 10000000000000000000000000BD + cast(l_linenumber as decimal(3,0)) * 10000000000000000000000BD + cast(l_partkey as decimal(12,0)) * 10000000000BD + cast(l_suppkey as decimal(10,0)) as decimal(38,0))")


def part_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed: what each part's shipments are flagged as, by day; the first line of a day counts."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("flag"), line_key().alias("line"))


def part_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.versions(part_feed(spark, sf_dir), "part", "day", ["flag"], "line", anchor_first=False)


@query(f"WITH {PART_SQL} SELECT part, flag, valid_from, valid_to, valid_to = TIMESTAMP '9999-12-31' AS is_current FROM pdim")
def scd2_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_dim(spark, sf_dir).select("part", "flag", "valid_from", "valid_to", "is_current")


@query(f"WITH {DEALS_SQL}, {SNAPSHOT_SQL} SELECT broker, attribute, valid_from, valid_to, valid_to = TIMESTAMP '9999-12-31' AS is_current FROM dim")
def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches one after the other, the second twice: the same dimension as from all at once."""
    feed = broker_snapshots(spark, sf_dir)
    early, late = feed.filter("month < date'1998-07-01'"), feed.filter("month >= date'1998-07-01'")
    dim = kept(scd2.versions(early, "broker", "month", ["attribute"], "line"))
    for _ in range(2):
        dim = kept(scd2.apply_batch(dim, late, "broker", "month", ["attribute"], "line"))
    return dim.select("broker", "attribute", "valid_from", "valid_to", "is_current")


@query(f"WITH {DEALS_SQL}, {SNAPSHOT_SQL} SELECT deal, d.broker, coalesce(dim.attribute, 'Unknown') AS attribute, coalesce(dim.valid_from, TIMESTAMP '1900-01-01') AS version_from FROM deals d LEFT JOIN dim ON dim.broker = d.broker AND CAST(received_date AS TIMESTAMP) >= valid_from AND CAST(received_date AS TIMESTAMP) < valid_to")
def pit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force and its attributes in one join: the fact isn't shuffled again for them."""
    dim = scd2.with_keys(kept(broker_dim(spark, sf_dir)), "broker", "sk")
    fact = deals(spark, sf_dir).select("deal", "broker", F.col("received_date").cast("timestamp_ntz").alias("at"))
    found = relational.point_in_time(fact, dim, "broker", "broker", "at", "sk", take={"attribute": "attribute", "version_from": "valid_from"})
    return found.select("deal", "broker", F.coalesce("attribute", F.lit("Unknown")).alias("attribute"), F.coalesce("version_from", scd2.stamp(S.BEGINNING)).alias("version_from"))


@query(
    f"""WITH {PART_SQL}, o AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT o.*, flag, valid_from, row_number() OVER (PARTITION BY rid ORDER BY valid_from DESC NULLS LAST) AS rn FROM o LEFT JOIN pdim ON part = l_partkey AND valid_from <= CAST(o.day AS TIMESTAMP))
SELECT l_orderkey, l_linenumber, l_partkey, flag, valid_from FROM r WHERE rn = 1"""
)
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line with the latest version of its part at or before the order's date."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("at"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return relational.latest_before(lines, part_dim(spark, sf_dir), "l_partkey", "part", "at", "valid_from", ["l_orderkey", "l_linenumber"], ["flag", "valid_from"]).drop("at")


@query(f"WITH {DEALS_SQL}, {SNAPSHOT_SQL} SELECT deal, d.broker, cur.attribute FROM deals d JOIN dim cur ON cur.broker = d.broker AND cur.valid_to = TIMESTAMP '9999-12-31'")
def two_hop_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = kept(scd2.with_keys(kept(broker_dim(spark, sf_dir)), "broker", "sk"))
    fact = relational.point_in_time(deals(spark, sf_dir).select("deal", "broker", F.col("received_date").cast("timestamp_ntz").alias("at")), dim, "broker", "broker", "at", "sk")
    return relational.current_of_version(fact, dim, "sk", "broker", ["attribute"]).select("deal", "broker", "attribute")


# --- staging --------------------------------------------------------------------------------------------------------


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals as text, some of them dirty."""
    u = S.unit_draw("dirty", F.col("deal").cast("string"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("deal") % len(values) + 1).cast("int"))
    text = F.col("value").cast("string")
    value = F.when(u < CUTS["date"], text).when(u < CUTS["value"], pick(BAD_VALUES)).when(u < CUTS["null"], F.lit(None)).when(u < CUTS["negative"], F.concat(F.lit("-"), text)).when(u < CUTS["small"], (F.col("value") / 1000).cast("decimal(18,2)").cast("string")).otherwise(text)
    return deals(spark, sf_dir).select(F.lit("batch-1.tsv").alias("source_file"), F.col("deal").alias("raw_line_no"), F.col("deal").cast("string").alias("deal_nk"), F.concat(F.lit("  "), F.col("priority"), F.lit("  ")).alias("sector_hint"), value.alias("deal_value"), F.when(u < CUTS["date"], pick(BAD_DATES)).otherwise(F.col("received_date").cast("string")).alias("received"))


_PICK = "[{0}][CAST(deal % {1} AS INTEGER) + 1]"
_D, _V = _PICK.format(", ".join(f"'{x}'" for x in BAD_DATES), len(BAD_DATES)), _PICK.format(", ".join(f"'{x}'" for x in BAD_VALUES), len(BAD_VALUES))
SUBMISSIONS_SQL = f"""{DEALS_SQL}, u AS (SELECT *, {DRAW_SQL.format("'dirty' || CAST(deal AS VARCHAR)")} AS u FROM deals),
sub AS (SELECT deal AS raw_line_no, CAST(deal AS VARCHAR) AS deal_nk, '  ' || priority || '  ' AS sector_hint, CASE WHEN u < 0.02 THEN CAST(value AS VARCHAR) WHEN u < 0.05 THEN {_V} WHEN u < 0.08 THEN NULL WHEN u < 0.11 THEN '-' || CAST(value AS VARCHAR) WHEN u < 0.15 THEN CAST(CAST(value / 1000 AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS deal_value,
  CASE WHEN u < 0.02 THEN {_D} ELSE CAST(received_date AS VARCHAR) END AS received FROM u),
cls AS (SELECT *, coalesce(regexp_matches(received, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(substr(received, 1, 10) AS DATE) IS NOT NULL, false) AS date_ok, deal_value IS NULL OR regexp_matches(trim(deal_value), '^-?\\d+(\\.\\d+)?$') AS value_ok FROM sub)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.classify(submissions(spark, sf_dir), "received", "deal_value", ["sector_hint"])


@query(f"WITH {SUBMISSIONS_SQL} SELECT raw_line_no, date_ok, value_ok, trim(sector_hint) AS sector_hint, CASE WHEN NOT date_ok THEN 'unparseable_date' WHEN NOT value_ok THEN 'unparseable_value' END AS reason FROM cls")
def stage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("raw_line_no", "date_ok", "value_ok", "sector_hint", staging.reject_reason().alias("reason"))


@query(
    f"""WITH {SUBMISSIONS_SQL} SELECT 'batch-1.tsv' AS source_file, raw_line_no, CASE WHEN NOT date_ok THEN 'unparseable_date' ELSE 'unparseable_value' END AS reason,
  '{{"deal_nk":"' || deal_nk || '","deal_value":' || coalesce('"' || deal_value || '"', 'null') || ',"received":"' || received || '"}}' AS payload FROM cls WHERE NOT date_ok OR NOT value_ok"""
)
def stage_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.rejects(classified(spark, sf_dir), ["source_file", "raw_line_no"], ["deal_nk", "deal_value", "received"])


@query(
    f"""WITH {SUBMISSIONS_SQL}, s AS (SELECT raw_line_no, abs(try_cast(trim(deal_value) AS DECIMAL(18,2))) AS value, coalesce(try_cast(trim(deal_value) AS DECIMAL(18,2)) < 0, false) AS negative, CAST(received AS DATE) AS received_date FROM cls WHERE date_ok AND value_ok)
SELECT raw_line_no, value, received_date, CASE WHEN value IS NULL OR value < 100000 THEN 'suspect' WHEN negative THEN 'repaired' ELSE 'clean' END AS quality FROM s"""
)
def grade_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = staging.staged(classified(spark, sf_dir), "received", "deal_value")
    return s.select("raw_line_no", "value", F.col("received_ts").cast("date").alias("received_date"), staging.grade(F.col("value"), F.col("value_was_negative"), F.lit(False)).alias("quality"))


@query(f"WITH {SUBMISSIONS_SQL} SELECT count(*) AS offered, count(*) FILTER (WHERE date_ok AND value_ok) AS staged, count(*) FILTER (WHERE NOT date_ok OR NOT value_ok) AS rejected, CAST(0 AS BIGINT) AS difference FROM cls")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    return staging.reconciliation(submissions(spark, sf_dir), {"staged": staging.staged(c, "received", "deal_value"), "rejected": staging.rejects(c, ["raw_line_no"], ["deal_nk"])})


@query("SELECT o_orderkey, CASE lower(trim(regexp_replace(CASE o_orderkey % 4 WHEN 0 THEN '  LOGISTICS' WHEN 1 THEN 'mixed   USE ' WHEN 2 THEN 'Shops' ELSE 'moon base' END, '\\s+', ' ', 'g'))) WHEN 'logistics' THEN 'Logistics' WHEN 'mixed use' THEN 'Mixed use' WHEN 'shops' THEN 'Shops' ELSE 'Unknown' END AS sector FROM orders")
def conform_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = ["  LOGISTICS", "mixed   USE ", "Shops", "moon base"]
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, spellings)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("sector"))
    return staging.conform(o, "sector", SECTORS, "Unknown")


# --- duplicates -----------------------------------------------------------------------------------------------------

BLOCK_SQL = f"""{DEALS_SQL}, k AS (SELECT *, CAST(broker AS VARCHAR) || '|' || CASE WHEN deal % 5 = 0 THEN 'UNKNOWN' ELSE CAST(broker % 7 AS VARCHAR) END || '|' || CAST(isoyear(received_date) AS VARCHAR) || '-' || lpad(CAST(weekofyear(received_date) AS VARCHAR), 2, '0') AS fingerprint FROM deals),
r AS (SELECT *, row_number() OVER w AS rn, first_value(deal) OVER w AS survivor, first_value(received_date) OVER w AS first_date, first_value(value) OVER w AS first_val FROM k WINDOW w AS (PARTITION BY fingerprint ORDER BY received_date, deal))"""


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deals(spark, sf_dir).withColumn("at", F.col("received_date").cast("timestamp_ntz"))
    return d.withColumn("fingerprint", dedupe.block_key([F.col("broker"), F.when(F.col("deal") % 5 != 0, F.col("broker") % 7)], F.col("received_date")))


def block_order() -> list:
    return [F.col("at").asc_nulls_last(), F.col("deal")]


@query(f"WITH {BLOCK_SQL} SELECT deal, broker, fingerprint FROM r WHERE rn = 1")
def block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.survivors(blocked(spark, sf_dir), "fingerprint", block_order()).select("deal", "broker", "fingerprint")


@query(f"WITH {BLOCK_SQL} SELECT deal AS suppressed, survivor, fingerprint, CAST(received_date - first_date AS DOUBLE) AS days_after, round((CAST(value AS DOUBLE) - CAST(first_val AS DOUBLE)) * 100 / CAST(first_val AS DOUBLE), 4) AS value_delta_pct FROM r WHERE rn > 1")
def dedupe_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.suppressed(blocked(spark, sf_dir), "fingerprint", block_order(), "deal", "at", "value")


@query("WITH h AS (SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content FROM documents) SELECT content, min(doc_id) AS survivor, count(*) AS copies FROM h GROUP BY 1")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for case and white space; aggregated before the shuffle, so a text of many copies is one row for each task."""
    h = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("binary")).alias("content"))
    return h.groupBy("content").agg(F.min("doc_id").alias("survivor"), F.count("*").alias("copies"))


# --- sequencing -----------------------------------------------------------------------------------------------------

#: Lines of an order as its stage events: the stage by line, shuffled for some by a draw, and every 97th an orphan.
STAGE_SQL = f"""d AS (SELECT o_orderkey AS deal, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 200 DAY AS received_ts FROM orders),
e0 AS (SELECT *, {DRAW_SQL.format("'stage' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)")} AS u, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, {LINE_SQL}) AS n FROM lineitem),
e AS (SELECT CAST(CASE WHEN {LINE_SQL} % 97 = 0 THEN -l_orderkey ELSE l_orderkey END AS BIGINT) AS deal, CAST({LINE_SQL} AS DECIMAL(38,0)) AS line, l_orderkey, n, CAST(l_shipdate AS TIMESTAMP) AS event_at, CAST(least(10, greatest(1, n + CASE WHEN u < 0.1 THEN -4 WHEN u < 0.2 THEN -1 WHEN u < 0.25 THEN 6 ELSE 0 END)) AS INTEGER) AS stage FROM e0),
q AS (SELECT e.*, CASE WHEN d.deal IS NULL THEN 'orphan_deal' WHEN e.event_at < d.received_ts THEN 'before_receipt' END AS reason FROM e LEFT JOIN d ON d.deal = e.deal)"""


#: What a line's key is made of.
LINE_PARTS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def stage_events(spark: SparkSession, sf_dir: str, also: Sequence[str] = ()) -> DataFrame:
    """also: further columns of the line. Lines are dealt by order before anything is made of them, so that few bytes are shuffled."""
    li = load(spark, sf_dir, "lineitem").select(*LINE_PARTS, "l_shipdate").repartition("l_orderkey")
    line = line_key()
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", line))
    u = S.unit_draw("stage", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    shift = F.when(u < 0.1, -4).when(u < 0.2, -1).when(u < 0.25, 6).otherwise(0)
    stage = F.least(F.lit(10), F.greatest(F.lit(1), n + shift)).cast("int")
    return li.select(F.when(line % 97 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("deal"), line.alias("line"), F.col("l_shipdate").alias("at"), stage.alias("stage"), "l_orderkey", n.alias("n"), *also).withColumns({"stage_order": F.col("stage"), "is_terminal": F.col("stage") >= 8})


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal"), (F.col("o_orderdate") - F.expr("interval 200 days")).alias("received_ts"))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.quarantine_before(stage_events(spark, sf_dir), received(spark, sf_dir), "deal", "at", "received_ts").filter("reason is null").drop("reason")


def in_sequence(df: DataFrame) -> DataFrame:
    return sequence.sequence(df, "deal", "at", "line", "stage_order", "is_terminal", "stage")


@query(f"WITH {STAGE_SQL} SELECT line, deal, reason FROM q WHERE reason IS NOT NULL")
def quarantine_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.quarantine_before(stage_events(spark, sf_dir), received(spark, sf_dir), "deal", "at", "received_ts").filter("reason is not null").select("line", "deal", "reason")


SEQ_SQL = f"""{STAGE_SQL}, s AS (SELECT line, deal, event_at, stage, row_number() OVER w AS event_seq, coalesce(lag(stage) OVER w, 0) AS from_stage, round((epoch_us(event_at) - epoch_us(lag(event_at) OVER w)) / 86400000000.0, 2) AS days_in_prev_stage, coalesce(stage > lag(stage) OVER w, true) AS is_forward,
  coalesce(lag(stage) OVER w >= 8, false) OR coalesce(stage <= lag(stage) OVER w - 2, false) AS is_impossible FROM q WHERE reason IS NULL WINDOW w AS (PARTITION BY deal ORDER BY event_at, line))"""


@query(f"WITH {SEQ_SQL} SELECT line, deal, stage, event_seq, from_stage, days_in_prev_stage, is_forward FROM s")
def sequence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sequence(eligible(spark, sf_dir)).select("line", "deal", "stage", "event_seq", "from_stage", "days_in_prev_stage", "is_forward")


@query(f"WITH {SEQ_SQL} SELECT line, deal, from_stage, stage FROM s WHERE is_impossible")
def anomaly_pass1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sequence(eligible(spark, sf_dir)).filter("is_impossible").select("line", "deal", "from_stage", "stage")


def settled(spark: SparkSession, sf_dir: str):
    return sequence.settle(eligible(spark, sf_dir), "deal", "at", "line", "stage_order", "is_terminal", "stage", kept)


def settled_sql(eligible: str, at: str, line: str, stage: str, order: str, terminal: str) -> str:
    """A recursive step for each pass over what is left of deals that lost an event; a deal's last pass is what is accepted."""
    before = lambda c: f"lag({c}) OVER (PARTITION BY deal ORDER BY {at}, {line})"
    return f"""pass AS (SELECT *, 1 AS pass FROM {eligible} UNION ALL
  SELECT * EXCLUDE (bad, hit, pass), pass + 1 AS pass FROM (SELECT *, bool_or(bad) OVER (PARTITION BY deal) AS hit FROM (SELECT *, coalesce({before(terminal)}, false) OR coalesce({order} <= {before(order)} - 2, false) AS bad FROM pass)) WHERE hit AND NOT bad),
final AS (SELECT * FROM pass QUALIFY pass = max(pass) OVER (PARTITION BY deal)),
accepted AS (SELECT *, row_number() OVER w AS event_seq, coalesce(lag({stage}) OVER w, 0) AS from_stage, round((epoch_us({at}) - epoch_us(lag({at}) OVER w)) / 86400000000.0, 2) AS days_in_prev_stage, coalesce({order} > lag({order}) OVER w, true) AS is_forward FROM final WINDOW w AS (PARTITION BY deal ORDER BY {at}, {line}))"""


@query(f"WITH RECURSIVE {STAGE_SQL}, ok AS (SELECT line, deal, event_at, stage, stage >= 8 AS is_terminal FROM q WHERE reason IS NULL), {settled_sql('ok', 'event_at', 'line', 'stage', 'stage', 'is_terminal')} SELECT line, deal, stage, event_seq, from_stage, days_in_prev_stage, is_forward FROM accepted")
def anomaly_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is accepted once no impossible transition is left."""
    return settled(spark, sf_dir)[0].select("line", "deal", "stage", "event_seq", "from_stage", "days_in_prev_stage", "is_forward")


@query(
    """WITH e AS (SELECT user_id, event_type, ts, event_id, CAST(list_position(['signup','view','click','purchase','error'], event_type) AS INTEGER) AS stage FROM events),
s AS (SELECT *, coalesce(stage > lag(stage) OVER w, true) AS fwd, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(ts) FILTER (WHERE stage = 1) AS signup_ts, min(ts) FILTER (WHERE stage = 2) AS view_ts, min(ts) FILTER (WHERE stage = 3) AS click_ts, min(ts) FILTER (WHERE stage = 4) AS purchase_ts, min(ts) FILTER (WHERE stage = 5) AS error_ts, count(DISTINCT stage) AS stage_count, count(*) FILTER (WHERE NOT fwd) AS reopen_count, arg_max(stage, n) AS current_stage, max(ts) AS last_event_ts FROM s GROUP BY 1"""
)
def milestone_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixtures import FUNNEL, funnel_events

    e = funnel_events(spark, sf_dir).select(F.col("user_id"), F.col("ts").alias("at"), F.col("event_id").alias("line"), "stage", F.col("stage").alias("stage_order"), (F.col("stage") > 5).alias("is_terminal"))
    seq = sequence.sequence(e, "user_id", "at", "line", "stage_order", "is_terminal", "stage")
    users = e.groupBy("user_id").agg(F.min("at").alias("first_at"))
    return sequence.milestones(seq, users, "user_id", "at", "stage", dict(enumerate(FUNNEL, 1)), "first_at").drop("first_at")


# --- facts ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS event_date_sk, CASE WHEN user_id % 10 > 0 THEN strftime(ts, '%Y-%m') ELSE '__DEFAULT__' END AS event_month FROM events")
def fact_append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping batches and a replay: each event once. Every tenth user's events are dated far off, into the default partition."""
    day = F.when(F.col("user_id") % 10 > 0, F.col("ts").cast("date")).otherwise(F.date_add(F.col("ts").cast("date"), 5000))
    rows = load(spark, sf_dir, "events").select("event_id", facts.date_key(F.col("ts").cast("date")).alias("event_date_sk"), facts.event_month(day, "2024-01", "2024-02").alias("event_month"))
    fact = rows.filter("event_id % 7 <= 3")
    fact = facts.append(fact, rows.filter("event_id % 7 >= 2"), ["event_id"])
    return facts.append(fact, rows.filter("event_id % 7 <= 5"), ["event_id"])


def snapshot_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deals as first loaded (two thirds), and all of them later, every fifth with another value and every eleventh with another date."""
    d = deals(spark, sf_dir).select("deal", "value", "received_date")
    first = d.filter("deal % 3 != 0").withColumns({"value_revision_count": F.lit(0), "first_value": F.col("value")})
    later = d.withColumns({"value": F.when(F.col("deal") % 5 == 0, F.col("value") + 100).otherwise(F.col("value")).cast("decimal(18,2)"), "received_date": F.when(F.col("deal") % 11 == 0, F.date_add("received_date", 1)).otherwise(F.col("received_date"))})
    return first, later


@query(
    f"""WITH {DEALS_SQL} SELECT deal, CAST(CASE WHEN deal % 5 = 0 THEN value + 100 ELSE value END AS DECIMAL(18,2)) AS value, CAST(CASE WHEN deal % 11 = 0 THEN received_date + INTERVAL 1 DAY ELSE received_date END AS DATE) AS received_date,
  CAST(CASE WHEN deal % 3 != 0 AND deal % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS value_revision_count, CAST(CASE WHEN deal % 3 = 0 AND deal % 5 = 0 THEN value + 100 ELSE value END AS DECIMAL(18,2)) AS first_value FROM deals"""
)
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = snapshot_batches(spark, sf_dir)
    once = facts.upsert_snapshot(first, later, "deal", "value")
    return facts.upsert_snapshot(once, later, "deal", "value")  # a replay changes nothing


@query(
    f"""WITH {DEALS_SQL} SELECT deal, 'value' AS attribute, CAST(value AS VARCHAR) AS old_value, CAST(CAST(value + 100 AS DECIMAL(18,2)) AS VARCHAR) AS new_value FROM deals WHERE deal % 3 != 0 AND deal % 5 = 0
UNION ALL SELECT deal, 'received_date', CAST(received_date AS VARCHAR), CAST(CAST(received_date + INTERVAL 1 DAY AS DATE) AS VARCHAR) FROM deals WHERE deal % 3 != 0 AND deal % 11 = 0"""
)
def restatement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = snapshot_batches(spark, sf_dir)
    return facts.restatements(first, later, "deal", ["value", "received_date"])


@query("SELECT CASE WHEN l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '2001-06-01' THEN strftime(l_shipdate, '%Y-%m') ELSE '__DEFAULT__' END AS event_month, count(*) AS rows, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY 1")
def partition_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return load(spark, sf_dir, "lineitem").select(day.alias("day"), facts.event_month(day, "1995-06", "2001-05").alias("event_month")).groupBy("event_month").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("SELECT min(m) AS declared_from, max(m) AS declared_to, count(*) AS months FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS m FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '2001-06-01')")
def declared_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_registry(spark, sf_dir).filter(F.col("event_month") != facts.DEFAULT_PARTITION).agg(F.min("event_month").alias("declared_from"), F.max("event_month").alias("declared_to"), F.count("*").alias("months"))


# --- incremental loads ----------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events")
def watermark_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads by watermark, the last a replay: the table of one load of everything."""
    from uuid import uuid4

    from tidemark.plans.control import incremental_load
    from tidemark.plans.keep import shared_root
    from tidemark.sources.tables import Store

    store = Store(spark, f"{shared_root(spark)}/incremental-{uuid4().hex[:12]}")
    landing = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("ingested_at"))
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    incremental_load(store, landing.filter(F.col("ingested_at") < middle), "events", ("int", "event"), ["event_id"])
    for _ in range(2):
        incremental_load(store, landing, "events", ("int", "event"), ["event_id"])
    return store.read("int", "event").select("event_id", "user_id", "event_type")


# --- the dense monthly aggregate ------------------------------------------------------------------------------------

_GRID_SQL = """g AS (SELECT broker, CAST(month AS DATE) AS month FROM cur CROSS JOIN (SELECT unnest(generate_series((SELECT min(CAST(date_trunc('month', received_date) AS DATE)) FROM deals), (SELECT max(CAST(date_trunc('month', received_date) AS DATE)) FROM deals), INTERVAL 1 MONTH)) AS month))
SELECT broker, month, coalesce(deals, 0) AS deals, coalesce(won, 0) AS won, CAST(coalesce(value, 0) AS DECIMAL(28,2)) AS value, coalesce(deals, 0) = 0 AS is_inactive_month FROM g LEFT JOIN a USING (broker, month)"""
_ACTIVITY_SQL = "CAST(date_trunc('month', received_date) AS DATE) AS month, count(*) AS deals, count(*) FILTER (WHERE is_won) AS won, sum(value) AS value"


def _broker_month(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    dim = kept(scd2.with_keys(kept(broker_dim(spark, sf_dir)), "broker", "sk"))
    d = deals(spark, sf_dir).withColumns({"at": F.col("received_date").cast("timestamp_ntz"), "month": S.month_of(F.col("received_date"))})
    fact = relational.point_in_time(d, dim, "broker", "broker", "at", "sk") if key == "sk" else d
    activity = fact.groupBy(key, "month").agg(F.count("*").alias("deals"), F.count(F.when(F.col("is_won"), 1)).alias("won"), F.sum("value").alias("value"))
    months = d.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    members = dim.filter("is_current").select("broker", "sk")
    grid = relational.dense_grid(members, months, activity, [key, "month"], ["deals", "won"])
    return grid.select("broker", "month", "deals", "won", F.coalesce("value", F.lit(0)).cast("decimal(28,2)").alias("value"), (F.col("deals") == 0).alias("is_inactive_month"))


@query(f"WITH {DEALS_SQL}, {SNAPSHOT_SQL}, cur AS (SELECT * FROM dim WHERE valid_to = TIMESTAMP '9999-12-31'), a AS (SELECT d.broker, {_ACTIVITY_SQL} FROM deals d JOIN cur ON cur.broker = d.broker AND CAST(received_date AS TIMESTAMP) >= cur.valid_from GROUP BY 1, 2), {_GRID_SQL}")
def broker_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current versions by month, by the version's key: what happened under an earlier version isn't in it. broker_month_person has that too."""
    return _broker_month(spark, sf_dir, "sk")


@query(f"WITH {DEALS_SQL}, {SNAPSHOT_SQL}, cur AS (SELECT * FROM dim WHERE valid_to = TIMESTAMP '9999-12-31'), a AS (SELECT broker, {_ACTIVITY_SQL} FROM deals GROUP BY 1, 2), {_GRID_SQL}")
def broker_month_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by person, whatever the version was at the time."""
    return _broker_month(spark, sf_dir, "broker")
