"""Dates in texts and calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.settings import MONTHS

ISO = r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b"
NUMERIC = r"\b([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{2,4})\b"
NAMED = r"(?U)\b([0-9]{1,2})\.?\s+([a-zäöü]+)\.?\s+([0-9]{2,4})\b"
#: Days from 0001-01-01, counted as 1, to 1970-01-01.
EPOCH_ORDINAL = 719163


def make(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none; years under 100 are of this century."""
    y = year.try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    dash = F.lit("-")  # concat is null if a part is, unlike concat_ws
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), dash, F.lpad(month, 2, "0"), dash, F.lpad(day, 2, "0"))
    return F.when(y.between(1, 9999), text.try_cast("date"))


def parse_date(s: Column, months: dict[str, int] = MONTHS) -> Column:
    """The first ISO date, else the first numeric one, else the first with a month's name. Each is
    tried only at its first place, and the next kind if it is no date."""
    s = F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    part = lambda p, i: F.regexp_extract(s, p, i)
    month = F.try_element_at(F.create_map(*[F.lit(x) for k, v in months.items() for x in (k, str(v))]), part(NAMED, 2))
    return F.coalesce(make(part(ISO, 1), part(ISO, 2), part(ISO, 3)), make(part(NUMERIC, 3), part(NUMERIC, 2), part(NUMERIC, 1)), make(part(NAMED, 3), month, part(NAMED, 1)))


CALENDAR = r"^([0-9]{4})([0-9]{2})([0-9]{2})(T[0-9]{6}Z?)?$"


def calendar_date(s: Column) -> Column:
    """struct(day, all_day) of a calendar's date or time; the time and its zone are left out."""
    s = F.trim(s)
    day = make(F.regexp_extract(s, CALENDAR, 1), F.regexp_extract(s, CALENDAR, 2), F.regexp_extract(s, CALENDAR, 3))
    day = F.when(F.regexp_extract(s, CALENDAR, 1) >= "0100", day)  # no century is added to a calendar's year
    return F.struct(day.alias("day"), (day.isNotNull() & (F.regexp_extract(s, CALENDAR, 4) == "")).alias("all_day"))


def period(today: Column) -> Column:
    """The day's number, from 1 for 0001-01-01."""
    return F.unix_date(today) + EPOCH_ORDINAL


def effective_end() -> Column:
    return F.coalesce("date_end", "date_start")
