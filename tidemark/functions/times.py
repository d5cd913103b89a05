"""Dates and times; the session's zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parsed(c: Column, *formats: str) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def iso(c: Column) -> Column:
    return F.date_format(c, ISO)


def iso_parse(c: Column) -> Column:
    """ISO text with Z, an offset, or neither."""
    return F.try_to_timestamp(c)


def clock_timestamp(date: Column, clock: Column) -> Column:
    """Date and h:mm[am|pm]; other clock text is midnight, a bad date or hour NULL."""
    day = F.when(date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), date)
    text = F.lower(F.trim(F.coalesce(clock.cast("string"), F.lit(""))))
    shown = F.regexp_extract(text, r"^\d{1,2}:\d{2}(?:\s*[ap]m)?", 0)
    hour = F.coalesce(F.split_part(shown, F.lit(":"), F.lit(1)).try_cast("int"), F.lit(0))
    hour = F.when(shown.endswith("pm") & (hour != 12), hour + 12).when(shown.endswith("am") & (hour == 12), 0).otherwise(hour)
    minute = F.coalesce(F.substring(F.split_part(shown, F.lit(":"), F.lit(2)), 1, 2).try_cast("int"), F.lit(0))
    ymd = [F.split_part(day, F.lit("-"), F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    return F.try_make_timestamp(*ymd, hour, minute, F.lit(0))


def to_utc(c: Column, zone: str = "US/Eastern") -> Column:
    """Local time to UTC; an hour that a change of clocks repeats is taken as standard time, its later passing."""
    first = F.to_utc_timestamp(c, zone)
    again = [first + F.make_dt_interval(mins=F.lit(m)) for m in (60, 30)]  # by so much clocks go back
    return F.coalesce(*(F.when(F.from_utc_timestamp(t, zone) == c, t) for t in again), first)


def is_trading_time(c: Column) -> Column:
    """Sunday 22:00 to Friday 22:00."""
    day, hour = F.dayofweek(c), F.hour(c)
    return F.when(day == 7, False).when(day == 6, hour < 22).when(day == 1, hour >= 22).otherwise(True)


def us_date(c: Column) -> Column:
    return parsed(F.trim(c), "M/d/yyyy")


def long_date(c: Column) -> Column:
    """'08 February 2026', '08 Feb 2026', 'February 08, 2026', '2026-02-08'."""
    return parsed(F.trim(c), "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd")


def published_date(shown: Column, meta: Column, lastmod: Column) -> Column:
    """What the page shows after 'Published on', else its meta tag, else the sitemap's date."""
    return F.coalesce(long_date(F.regexp_replace(shown, r"(?i)^Published on\s+", "")), iso_parse(meta), iso_parse(lastmod))


def url_date(url: Column) -> Column:
    """ecb.<type>YYMMDD~, else 1 January of /date/YYYY/."""
    six = F.regexp_extract(url, r"ecb\.\w+(\d{6})~", 1)
    century = F.when(F.substring(six, 1, 2) < "50", "20").otherwise("19")
    exact = F.try_to_date(F.concat(century, six), "yyyyMMdd")
    year = F.regexp_extract(url, r"/date/(\d{4})/", 1)
    return F.coalesce(exact, F.try_to_date(F.concat(F.when(year != "", year), F.lit("0101")), "yyyyMMdd"))


def compact_timestamp(c: Column) -> Column:
    """YYYYMMDDHHMMSS to ISO text; what does not parse stays as it is."""
    text = c.cast("string")
    return F.coalesce(iso(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))), text)


def feed_date(*columns: Column) -> Column:
    """The first of several RFC-822 dates that parses, in UTC; weekday names are not looked at."""
    bare = [F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "") for c in columns]
    return F.coalesce(*(parsed(b, "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z") for b in bare))


def header_date(c: Column, year: int) -> Column:
    """A calendar's day header: 'Monday, February 12, 2024', or 'Feb 12' in ``year``."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]+day,?\s+", "")
    return F.coalesce(parsed(bare, "MMMM d, yyyy"), parsed(F.concat(bare, F.lit(f", {year}")), "MMM d, yyyy", "MMMM d, yyyy")).cast("date")


def month_key(c: Column) -> Column:
    return F.date_format(c, "MM")


def months_between(start: Column, end: Column) -> Column:
    """First days of all months from start to end, as an array."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def week_number(c: Column) -> Column:
    """ISO week of the year."""
    return F.weekofyear(c)


def week_key(c: Column) -> Column:
    """ISO year and week, as 2024-W05."""
    thursday = F.date_add(F.trunc(c, "week"), 3)
    return F.format_string("%d-W%02d", F.year(thursday), F.weekofyear(c))
