"""Column functions for dates and calendars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions.text import blank_to_null, col, let

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?)?"
_WEEKDAY = r"^(?i)(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+"
_CLOCKS = [r"\b(\d{1,2}:\d{2})\s*(AM|PM|am|pm)\b", r"\b(\d{1,2})\s*(AM|PM|am|pm)\b", r"\b(\d{1,2}:\d{2})\b"]


def moment(value) -> Column:
    """A literal point in time without zone."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def month_bounds(year: int, month: int | None = None) -> tuple[Column, Column]:
    """Half-open bounds of a year or of a month of it."""
    if month is None:
        return moment(f"{year:04d}-01-01 00:00:00"), moment(f"{year + 1:04d}-01-01 00:00:00")
    nxt = (year + 1, 1) if month == 12 else (year, month + 1)
    return moment(f"{year:04d}-{month:02d}-01 00:00:00"), moment(f"{nxt[0]:04d}-{nxt[1]:02d}-01 00:00:00")


def ics_datetime(c) -> Column:
    return F.date_format(col(c), "yyyyMMdd'T'HHmmss")


def ics_date(c) -> Column:
    return F.date_format(col(c), "yyyyMMdd")


def has_clock(c) -> Column:
    return (F.hour(col(c)) != 0) | (F.minute(col(c)) != 0) | (F.second(col(c)) != 0)


def clock12(c) -> Column:
    """'h:mm AM', or '' at midnight."""
    return F.when(has_clock(c), F.date_format(col(c), "h:mm a")).otherwise(F.lit(""))


def parse_date(c) -> Column:
    """ISO prefix first, then the fixed layouts in order; NULL if none fits."""
    return let(F.trim(col(c)), lambda text: F.coalesce(_iso_date(text), _laid_out_date(text))).cast("timestamp_ntz")


def _iso_date(text: Column) -> Column:
    day, clock, sec = (F.regexp_extract(text, _ISO, i) for i in (1, 2, 3))
    iso = F.concat(
        blank_to_null(day), F.lit(" "), F.coalesce(blank_to_null(clock), F.lit("00:00")),
        F.coalesce(blank_to_null(sec), F.lit(":00")),
    )
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss"))


def _laid_out_date(text: Column) -> Column:
    """Month names and day halves are brought to the case the layouts expect."""
    cased = F.initcap(F.lower(F.regexp_replace(text, _WEEKDAY, "")))
    for pattern, to in ((r"(?<=\d{4}) At ", " at "), (r"(?<=\d) ?[aA][mM]$", " AM"),
                        (r"(?<=\d) ?[pP][mM]$", " PM"), (r"(?<=\d)t(?=\d)", "T")):
        cased = F.regexp_replace(cased, pattern, to)
    layouts = [x for x in K.DATE_LAYOUTS if "EEEE" not in x]
    # no layout fits a text without a digit, so most free text is settled by one test
    return F.when(text.rlike(r"\d"), let(
        cased, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(x)) for x in layouts])))


def first_clock(text) -> Column:
    """Minutes after midnight of the first clock time, by pattern priority, NULL if none."""
    found = F.filter(F.array(*[F.regexp_extract(col(text), p, 0) for p in _CLOCKS]), lambda x: x != "")
    return let(F.get(found, F.lit(0)), _clock_minutes)


def _clock_minutes(t: Column) -> Column:
    half = F.upper(F.regexp_extract(t, r"(?i)([ap]m)$", 1))
    h = F.regexp_extract(t, r"^(\d{1,2})", 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(t, r":(\d{2})", 1).try_cast("int"), F.lit(0))
    h24 = F.when(half == "PM", h % 12 + 12).when(half == "AM", h % 12).otherwise(h)
    valid = (m < 60) & F.when(half != "", (h >= 1) & (h <= 12)).otherwise(h < 24)
    return F.when(valid, h24 * 60 + m)
