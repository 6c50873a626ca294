"""Column helpers: all are built from JVM expressions, none is a UDF."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x kept within [low, high]; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(x, high)))


def quantile(ordered: Column, p: float) -> Column:
    """Linear quantile of an ascending array without nulls; null for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, below + (above - below) * (at - low))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def clock(hour: Column) -> Column:
    """HH:MM of an hour of day, which may pass 24; the minute is rounded half to even."""
    h = hour - F.floor(hour / 24) * 24
    whole = F.floor(h)
    minute = F.bround((h - whole) * 60, 0).cast("int")
    whole = F.when(minute == 60, (whole + 1) % 24).otherwise(whole)
    return F.concat(F.lpad(whole.cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))


def minutes_of(text: Column) -> Column:
    """Minutes since midnight of an HH:MM text; null if it isn't one."""
    ok = text.rlike(r"^\d{2}:\d{2}$")
    return F.when(ok, F.split(text, ":")[0].cast("int") * 60 + F.split(text, ":")[1].cast("int"))


def valid_zone(zone: Column) -> Column:
    """The zone's name if it is one, else UTC."""
    return F.when(zone.isin(sorted(zoneinfo.available_timezones())), zone).otherwise("UTC")


def iso_local(text: Column, zone: Column) -> Column:
    """The wall time in `zone` of an ISO text: one with Z or an offset is moved there, one without is taken to be there.

    Null for a text that is no time; an unknown zone counts as UTC.
    """
    zone, utc = valid_zone(zone), F.lit("UTC")
    text = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    instant = F.convert_timezone(F.current_timezone(), utc, text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(r"[+-]\d{2}:?\d{2}$") & text.rlike(r"\d:\d"), F.convert_timezone(utc, zone, instant)).otherwise(text.try_cast("timestamp_ntz"))


def json_object(text: Column) -> Column:
    """The outer JSON object of a text that may stand in a code fence or between words; null without one."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def shortened(text: Column, most: int) -> Column:
    """Text of at most `most` characters, three dots at the end of a cut one."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def grid_cell(index: Column, columns: int = 4, most: int = 16) -> tuple[Column, Column]:
    """Column and row, both from 1, of a 1-based index into a square grid; nulls outside it."""
    ok = index.between(1, most)
    return F.when(ok, F.pmod(index - 1, F.lit(columns)) + 1), F.when(ok, F.floor((index - 1) / columns) + 1)


def behavioural_day(ts: Column, start_hour: int = 4) -> Column:
    """The date that a time belongs to when days begin at `start_hour`."""
    return F.to_date(ts - F.expr(f"INTERVAL {start_hour} HOURS"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def normal_tail(z: Column) -> Column:
    """P(N(0, 1) > z) for z >= 0, to 1e-7 (rational approximation of the error function)."""
    x = z / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x) / 2
