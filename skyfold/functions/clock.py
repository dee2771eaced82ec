"""Dates, clock times written as HHMM, time zones and holidays."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def ntz(text: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 for a zone-less or zoned timestamp, whatever the session zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", ntz(EPOCH), F.date_trunc("SECOND", ts))


def clean_clock(hhmm: Column | str) -> Column:
    """HHMM as an int with midnight written 2400 turned into 0."""
    value = (F.col(hhmm) if isinstance(hhmm, str) else hhmm).cast("int")
    return F.when(value == 2400, F.lit(0)).otherwise(value)


def clock_on(date: Column | str, hhmm: Column | str) -> Column:
    """Zone-less timestamp of an HHMM clock on a date; null when either is missing or no valid clock."""
    date = F.col(date) if isinstance(date, str) else date
    value = clean_clock(hhmm)
    hour, minute = F.floor(value / 100).cast("int"), F.pmod(value, F.lit(100)).cast("int")
    valid = value.between(0, 2359) & (minute < 60)
    return F.when(valid, date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute))


def clock_hour(hhmm: Column | str) -> Column:
    """Hour of an HHMM clock, the first two of its four digits, so 2400 stays 24."""
    return F.floor((F.col(hhmm) if isinstance(hhmm, str) else hhmm).cast("int") / 100).cast("int")


def hour_block(hhmm: Column | str) -> Column:
    """Hour block label such as ``0100-0159`` for 134."""
    hour = F.floor((F.col(hhmm) if isinstance(hhmm, str) else hhmm) / 100).cast("int")
    return F.format_string("%02d00-%02d59", hour, hour)


def to_utc(local: Column | str, zone: Column | str) -> Column:
    """Local zone-less timestamp of the given zone (a column) -> zone-less UTC timestamp."""
    local = F.col(local) if isinstance(local, str) else local
    zone = F.col(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(zone, F.lit("UTC"), local)


def local_clock_to_utc(
    df: DataFrame,
    *,
    date: str = "FL_DATE",
    sched_dep: str = "CRS_DEP_TIME",
    dep: str = "DEP_TIME",
    dep_delay: str = "DEP_DELAY",
    sched_arr: str = "CRS_ARR_TIME",
    arr: str = "ARR_TIME",
    origin_zone: str = "ORIGIN_TIMEZONE",
    dest_zone: str = "DEST_TIMEZONE",
    corrected: bool = False,
) -> DataFrame:
    """Four local clocks on one flight date -> four UTC timestamps plus four hour columns.

    Roll-over rules: a departure falls on the next day when it is earlier than scheduled although
    late, or at 2400; an arrival on the day after departure when its clock is before the departure's,
    or at 2400; a scheduled arrival on the next day when before the scheduled departure, or at 2400.

    ``corrected=True`` mends two oddities of the customary rules: an arrival that does not roll over
    is dated on the departure date rather than on the flight date, and a scheduled departure at 2400
    means the end of the flight date, not its start.
    """
    d, nxt = F.col(date).cast("date"), F.date_add(F.col(date).cast("date"), 1)
    late_past_midnight = (F.col(dep) < F.col(sched_dep)) & (F.col(dep_delay) > 0)
    arr_rolls = (F.col(arr) < F.col(dep)) | (F.col(arr) == 2400)
    sched_arr_rolls = (F.col(sched_arr) < F.col(sched_dep)) | (F.col(sched_arr) == 2400)
    # Dates, local times and UTC times are separate projections: each value is computed once and the
    # generated code stays small enough to be compiled.
    dates = {
        "_dep_date": F.when(late_past_midnight | (F.col(dep) == 2400), nxt).otherwise(d),
        "_sched_arr_date": F.when(sched_arr_rolls, nxt).otherwise(d),
        "_sched_dep_date": F.when(F.col(sched_dep) == 2400, nxt).otherwise(d) if corrected else d,
    }
    stays = F.col("_dep_date") if corrected else d
    arr_date = {"_arr_date": F.when(arr_rolls, F.date_add("_dep_date", 1)).otherwise(stays)}
    local = {
        "_dep": clock_on("_dep_date", dep),
        "_arr": clock_on("_arr_date", arr),
        "_sched_dep": clock_on("_sched_dep_date", sched_dep),
        "_sched_arr": clock_on("_sched_arr_date", sched_arr),
    }
    utc = {
        "DEP_DATETIME_UTC": to_utc("_dep", origin_zone),
        "ARR_DATETIME_UTC": to_utc("_arr", dest_zone),
        "CRS_DEP_DATETIME_UTC": to_utc("_sched_dep", origin_zone),
        "CRS_ARR_DATETIME_UTC": to_utc("_sched_arr", dest_zone),
    }
    hours = {
        "CRS_ARR_HOUR": clock_hour(sched_arr),
        "ARR_HOUR": clock_hour(arr),
        "CRS_DEP_HOUR": clock_hour(sched_dep),
        "DEP_HOUR": clock_hour(dep),
    }
    out = df.withColumns(dates).withColumns(arr_date).withColumns(local).withColumns(utc).withColumns(hours)
    return out.drop(*dates, *arr_date, *local)


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th given weekday (Monday is 0) of a month; n = -1 is the last one."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def us_holidays(years: Iterable[int]) -> list[tuple[dt.date, str]]:
    """The eleven holidays of interest per year, from their calendar rules."""
    days = []
    for y in years:
        days += [
            (dt.date(y, 1, 1), "New Year's Day"),
            (_nth_weekday(y, 1, 0, 3), "Martin Luther King Jr. Day"),
            (_nth_weekday(y, 2, 0, 3), "Presidents Day"),
            (_nth_weekday(y, 5, 0, -1), "Memorial Day"),
            (dt.date(y, 7, 4), "Independence Day"),
            (_nth_weekday(y, 9, 0, 1), "Labor Day"),
            (_nth_weekday(y, 10, 0, 2), "Columbus Day"),
            (dt.date(y, 11, 11), "Veterans Day"),
            (_nth_weekday(y, 11, 3, 4), "Thanksgiving Day"),
            (dt.date(y, 12, 24), "Christmas Eve"),
            (dt.date(y, 12, 25), "Christmas Day"),
        ]
    return days


def near_date(date: Column | str, dates: Iterable[dt.date], days: int = 2) -> Column:
    """1 when the date lies within ``days`` of any listed date, else 0.

    The list is widened to every matching day, which turns the range test into a constant set
    lookup: no join, no shuffle, and a day near two listed dates yields one row, not two.
    """
    wide = sorted({d + dt.timedelta(k) for d in dates for k in range(-days, days + 1)})
    date = (F.col(date) if isinstance(date, str) else date).cast("date")
    return F.when(date.isin(wide), F.lit(1)).otherwise(F.lit(0))
