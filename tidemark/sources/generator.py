"""A deterministic generator of the four raw feeds, with defects at stated rates: every draw is an md5 of a seed and a key, so any size is generated in parallel and twice alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import unit_draw
from tidemark.operators.dims import STAGES

#: What generated feeds hold: regions and grades of brokers, sizes of agencies, sectors, ways in, and the spoilt values of all feeds.
REGIONS = ["Highlands", "Lake District", "Harbour", "Old Town", "Plains", "Islands"]
TIERS = ["Partner", "Lead", "Associate", "Trainee"]
AGENCY_TIERS = ["Group", "Chain", "Independent"]
SECTORS = ["Logistics", "Shops", "Offices", "Housing", "Farmland", "Mixed use", "Hotels", "Clinics"]
CHANNELS = ["web form", "letter", "call", "visit", "partner feed"]
BAD_VALUES = ["2.5 million", "unknown", "per annex B", "1.200.000,00", "EUR 900k", "-"]
BAD_DATES = ["1998-02-31", "17.03.1999", "last Tuesday", "1997-19-01"]
BAD_STAGES = ["PARKED", "AWAITING REPLY", "S-0", "IN COMMITTEE"]

#: Columns of each feed, in the order of its files.
CONTRACTS = {
    "deal_submission": ["source_message_nk", "deal_nk", "broker_nk", "broker_name", "broker_email", "property_nk", "property_name", "sector_hint", "deal_value_zar", "currency_code", "received_ts", "source_channel", "is_off_market", "submission_notes"],
    "stage_event": ["source_event_nk", "deal_nk", "stage_code", "event_ts", "actor_broker_nk", "stage_value_zar", "event_notes"],
    "broker_directory": ["snapshot_date", "broker_nk", "full_name", "broker_email", "broker_phone", "agency_code", "agency_name", "agency_tier", "agency_head_office_province", "agency_is_national", "agency_headcount_band", "region", "broker_tier", "is_active"],
    "property_register": ["property_nk", "register_event_type", "effective_date", "property_name", "suburb", "metro", "province", "sector", "sub_sector", "building_grade", "gla_sqm", "gla_sqm_band"],
}


@dataclass(frozen=True)
class Rates:
    """Shares of defects. The names say what is wrong with a row."""

    resubmitted: float = 0.05
    null_value: float = 0.012
    thousandth: float = 0.004
    bad_value: float = 0.006
    bad_date: float = 0.009
    email_noise: float = 0.015
    unknown_broker: float = 0.008
    name_only: float = 0.005
    negative: float = 0.003
    sector_noise: float = 0.01
    redelivered: float = 0.019
    impossible: float = 0.005
    unknown_stage: float = 0.0017
    orphan: float = 0.001
    before_receipt: float = 0.003
    out_of_range: float = 0.002


@dataclass(frozen=True)
class Size:
    """Numbers of things; months from the first of `start`."""

    deals: int = 2_000
    brokers: int = 60
    properties: int = 150
    months: int = 24
    start: str = "2024-01-01"


def _u(what: str, key: Column) -> Column:
    return unit_draw(f"feed:{what}:", key.cast("string"))


def _pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def _code(prefix: str, n: Column, digits: int = 6) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), digits, "0"))


def _stamp(day: Column, seconds: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("+02"))


def _base(spark: SparkSession, size: Size) -> DataFrame:
    """Deals before any defect: brokers by a power law, values log-normal by sums of draws, months by season."""
    k = F.col("id")
    month = F.floor(F.pow(_u("month", k), F.lit(0.8)) * size.months).cast("int")
    normal = (sum((_u(f"n{j}", k) for j in range(6)), F.lit(0.0)) - 3.0) * 1.4142
    return spark.range(size.deals).select(
        k, F.floor(F.pow(_u("broker", k), F.lit(3.0)) * size.brokers).cast("long").alias("b"), F.floor(_u("property", k) * size.properties).cast("long").alias("p"), F.date_add(F.add_months(F.lit(size.start).cast("date"), month), F.floor(_u("day", k) * 28).cast("int")).alias("day"), F.floor(28_800 + _u("second", k) * 32_400).cast("long").alias("second"), F.exp(normal * 1.1 + 15.5).cast("decimal(18,2)").alias("value"),
    )


def deal_submission(spark: SparkSession, size: Size = Size(), rates: Rates = Rates()) -> DataFrame:
    base = _base(spark, size)
    again = base.filter(_u("again", F.col("id")) < rates.resubmitted).withColumns({"copy": F.lit(1), "value": (F.col("value") * (1 + (_u("jitter", F.col("id")) - 0.5) * 0.04)).cast("decimal(18,2)"), "second": F.col("second") + 3600})
    rows = base.withColumn("copy", F.lit(0)).unionByName(again)
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("copy").cast("string"))
    u, name_only = _u("value", key), _u("name_only", key) < rates.name_only
    cuts, at = {}, 0.0
    for defect in ("null_value", "thousandth", "bad_value", "negative"):
        cuts[defect] = (at, at + getattr(rates, defect))
        at += getattr(rates, defect)
    hit = lambda d: (u >= cuts[d][0]) & (u < cuts[d][1])
    text = F.col("value").cast("string")
    value = F.when(hit("null_value"), F.lit(None)).when(hit("thousandth"), (F.col("value") / 1000).cast("decimal(18,2)").cast("string")).when(hit("bad_value"), _pick(BAD_VALUES, _u("which", key))).when(hit("negative"), F.concat(F.lit("-"), text)).otherwise(text)
    month = F.date_format("day", "yyyyMM")
    email = F.concat(F.lit("broker"), F.col("b").cast("string"), F.lit("@agency.example"))
    sector = _pick(SECTORS, _u("sector", F.col("p")))
    out = rows.select(
        F.concat_ws("-", F.lit("MSG"), month, F.lpad((F.col("id") * 2 + F.col("copy")).cast("string"), 8, "0")).alias("source_message_nk"), F.concat_ws("-", F.lit("DL"), month, F.lpad((F.col("id") * 2 + F.col("copy")).cast("string"), 8, "0")).alias("deal_nk"),
        F.when(_u("unknown", key) < rates.unknown_broker, _code("BRK", F.col("b") + 900_000)).otherwise(_code("BRK", F.col("b"))).alias("broker_nk"), F.concat(F.lit("Broker "), F.col("b").cast("string")).alias("broker_name"), F.when(_u("email", key) < rates.email_noise, F.concat(F.lit(" "), F.upper(email), F.lit(" "))).otherwise(email).alias("broker_email"),
        F.when(name_only, F.lit(None)).otherwise(_code("PRP", F.col("p"))).alias("property_nk"), F.concat(F.lit("Property "), F.col("p").cast("string"), F.when(name_only, F.lit(" (Pty) Ltd")).otherwise(F.lit(""))).alias("property_name"), F.when(_u("hint", key) < rates.sector_noise, F.concat(F.lit("  "), F.upper(sector))).otherwise(sector).alias("sector_hint"),
        value.alias("deal_value_zar"), F.lit("ZAR").alias("currency_code"), F.when(_u("date", key) < rates.bad_date, _pick(BAD_DATES, _u("bad_date", key))).otherwise(_stamp(F.col("day"), F.col("second"))).alias("received_ts"), _pick(CHANNELS, _u("channel", key)).alias("source_channel"), F.when(_u("off", key) < 0.2, "true").otherwise("false").alias("is_off_market"), F.lit(None).cast("string").alias("submission_notes"),
    )
    return out.select(*CONTRACTS["deal_submission"])


def stage_event(spark: SparkSession, size: Size = Size(), rates: Rates = Rates()) -> DataFrame:
    """Each deal goes some stages forward, to a terminal one for most; days between events grow by stage."""
    base = _base(spark, size).withColumn("steps", (F.floor(_u("steps", F.col("id")) * 7) + 1).cast("int"))
    walk = base.withColumn("stage", F.explode(F.concat(F.sequence(F.lit(1), F.col("steps")), F.when(_u("ends", F.col("id")) < 0.8, F.array((F.floor(_u("end", F.col("id")) * 3) + 8).cast("int"))).otherwise(F.array().cast("array<int>")))))
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("stage").cast("string"))
    place = F.when(F.col("stage") >= 8, F.col("steps") + 1).otherwise(F.col("stage"))
    day = F.date_add("day", F.floor((place - 1) * (3 + _u("pace", F.col("id")) * 9) + _u("slip", key)).cast("int"))
    day = F.when(_u("early", key) < rates.before_receipt, F.date_sub("day", 30)).otherwise(day)
    far = _u("far", key)
    stamp = F.when(far < rates.out_of_range / 2, F.lit("2019-01-01 09:00:00+02")).when(far < rates.out_of_range, F.lit("2031-01-01 09:00:00+02")).otherwise(_stamp(day, F.col("second") + place * 60))
    codes = F.array(*[F.lit(c) for _, c, *_ in STAGES])
    stage = F.when(_u("back", key) < rates.impossible, F.lit(1)).otherwise(F.col("stage"))
    code = F.when(_u("odd", key) < rates.unknown_stage, _pick(BAD_STAGES, _u("which_stage", key))).otherwise(F.element_at(codes, stage + 1))
    number = F.col("id") * 2
    deal = F.concat_ws("-", F.lit("DL"), F.date_format("day", "yyyyMM"), F.lpad(F.when(_u("orphan", key) < rates.orphan, number + 90_000_000).otherwise(number).cast("string"), 8, "0"))
    out = walk.select(F.concat_ws("-", F.lit("EVT"), key).alias("source_event_nk"), deal.alias("deal_nk"), code.alias("stage_code"), stamp.alias("event_ts"), _code("BRK", F.col("b")).alias("actor_broker_nk"), F.when(F.col("stage") >= 5, F.col("value").cast("string")).alias("stage_value_zar"), F.lit(None).cast("string").alias("event_notes"), _u("twice", key).alias("__twice"))
    return out.unionByName(out.filter(F.col("__twice") < rates.redelivered)).select(*CONTRACTS["stage_event"])


def broker_directory(spark: SparkSession, size: Size = Size()) -> DataFrame:
    """A full snapshot each month; now and then a broker's tier or agency changes for good."""
    months = spark.range(size.brokers).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(size.months - 1))).alias("m"))
    # how many months up to this one brought a change: at most one row of draws for each broker
    changes = F.size(F.filter(F.sequence(F.lit(0), F.col("m")), lambda j: _u("change", F.concat_ws("-", F.col("b").cast("string"), j.cast("string"))) < 0.03))
    rows = months.filter(F.col("m") >= F.floor(_u("joined", F.col("b")) * size.months * 0.3)).withColumn("changes", changes)
    agency = F.floor(_u("agency", F.concat_ws("-", F.col("b").cast("string"), F.floor(F.col("changes") / 2).cast("string"))) * 12).cast("long")
    tier = lambda a: _pick(AGENCY_TIERS, _u("agency_tier", a))
    return rows.select(
        F.date_format(F.add_months(F.lit(size.start).cast("date"), F.col("m")), "yyyy-MM-dd").alias("snapshot_date"), _code("BRK", F.col("b")).alias("broker_nk"), F.concat(F.lit("Broker "), F.col("b").cast("string")).alias("full_name"), F.concat(F.lit("broker"), F.col("b").cast("string"), F.lit("@agency.example")).alias("broker_email"), F.lit("+27 21 555 0100").alias("broker_phone"),
        _code("AGC", agency, 3).alias("agency_code"), F.concat(F.lit("Agency "), agency.cast("string")).alias("agency_name"), tier(agency).alias("agency_tier"), _pick(REGIONS, _u("province", agency)).alias("agency_head_office_province"), (tier(agency) == "National").cast("string").alias("agency_is_national"), F.lit("10-50").alias("agency_headcount_band"),
        _pick(REGIONS, _u("region", F.col("b"))).alias("region"), _pick(TIERS, _u("tier", F.concat_ws("-", F.col("b").cast("string"), F.col("changes").cast("string")))).alias("broker_tier"), F.lit("true").alias("is_active"),
    ).select(*CONTRACTS["broker_directory"])


def property_register(spark: SparkSession, size: Size = Size()) -> DataFrame:
    """An initial entry for each property, and a reclassification for some."""
    p = spark.range(size.properties).withColumn("kind", F.explode(F.when(_u("reclass", F.col("id")) < 0.13, F.array(F.lit("INITIAL"), F.lit("RECLASSIFY"))).otherwise(F.array(F.lit("INITIAL")))))
    key = F.when(F.col("kind") == "INITIAL", F.col("id").cast("string")).otherwise(F.concat(F.col("id").cast("string"), F.lit("r")))
    area = F.floor(200 + _u("area", F.col("id")) * 20_000)
    return p.select(
        _code("PRP", F.col("id")).alias("property_nk"), F.col("kind").alias("register_event_type"), F.date_format(F.when(F.col("kind") == "INITIAL", F.lit(size.start).cast("date")).otherwise(F.date_add(F.lit(size.start).cast("date"), F.floor(30 + _u("when", F.col("id")) * 28 * (size.months - 1)).cast("int"))), "yyyy-MM-dd").alias("effective_date"),
        F.concat(F.lit("Property "), F.col("id").cast("string")).alias("property_name"), F.lit("Suburb").alias("suburb"), F.lit("Metro").alias("metro"), _pick(REGIONS, _u("p_province", F.col("id"))).alias("province"), _pick(SECTORS, _u("sector", key)).alias("sector"), F.lit("General").alias("sub_sector"), _pick(["A", "B", "C"], _u("grade", key)).alias("building_grade"), area.cast("string").alias("gla_sqm"), F.when(area < 5000, "S").otherwise("L").alias("gla_sqm_band"),
    ).select(*CONTRACTS["property_register"])


FEEDS = {"deal_submission": deal_submission, "stage_event": stage_event, "broker_directory": broker_directory, "property_register": property_register}


def write_feeds(spark: SparkSession, path: str, size: Size = Size()) -> dict[str, int]:
    """Writes all four feeds as text and returns the rows of each, for a ledger."""
    from .tables import read_tsv, write_tsv

    out = {}
    for name, make in FEEDS.items():
        write_tsv(make(spark, size), f"{path}/{name}")
        out[name] = read_tsv(spark, f"{path}/{name}", CONTRACTS[name]).count()
    return out
