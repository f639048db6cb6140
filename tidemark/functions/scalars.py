"""Scalar functions as column expressions: all of them stay inside generated code, none is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The open ends of validity intervals. Timestamps have no infinities here, and these two survive every round trip.
BEGINNING, FOREVER = "1900-01-01 00:00:00", "9999-12-31 00:00:00"

NUMBER = r"^-?\d+(\.\d+)?$"
DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
#: Legal forms that names of one party may end on: fixed values.
LEGAL_FORMS = ["(pty) ltd", "pty ltd", "proprietary limited", "limited", "ltd", "inc", "cc"]


def unit_draw(seed: str, key: Column) -> Column:
    """A draw in [0, 1) from the first 32 bits of md5(seed + key); null keys draw null."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def squeeze(c: Column) -> Column:
    """Trimmed, runs of white space as one blank, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def match_name(c: Column) -> Column:
    """A name as it is compared: lower case, without a legal form at its end and without punctuation, squeezed."""
    forms = "|".join(f.replace("(", r"\(").replace(")", r"\)") for f in LEGAL_FORMS)
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), rf"\s+({forms})\.?\s*$", ""), r"[^a-z0-9 ]", " "))


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def is_calendar_date(c: Column) -> Column:
    """Begins with yyyy-mm-dd and that day exists. Null in, null out."""
    return F.when(c.isNotNull(), c.rlike(DATE_PREFIX) & F.substring(c, 1, 10).try_cast("date").isNotNull())


def timestamp_of(c: Column) -> Column:
    """A timestamp where the text begins with a day that exists, else null."""
    return F.when(is_calendar_date(c), c.try_cast("timestamp_ntz"))


def money(c: Column) -> Column:
    return c.try_cast("decimal(18,2)")


def iso_week(c: Column) -> Column:
    """yyyy-ww by ISO 8601: the last days of December may be in week 1 of the next year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-"), F.lpad(F.extract(F.lit("WEEK"), c).cast("string"), 2, "0"))


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b in double precision, null where b is 0 or null."""
    out = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def days_between(later: Column, earlier: Column, digits: int = 2) -> Column:
    """Days with a fraction between two timestamps, with or without a zone."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.round(micros / F.lit(86_400_000_000.0), digits)


def tracked_hash(columns: list[str]) -> Column:
    """sha256 over attributes. A null is written as a sign of its own, so that it can't be mistaken for its neighbour."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary"), 256)


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")


def in_months(c: Column, first: str, last_exclusive: str) -> Column:
    """A half-open range on the bare column, which scans can push down; a formatted month can't be."""
    return (c >= F.lit(first).cast("timestamp_ntz")) & (c < F.lit(last_exclusive).cast("timestamp_ntz"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
