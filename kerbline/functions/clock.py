"""Service clock: schedule text, local time, periods and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_OFFSET_S = 14_400  # fixed UTC-4 local clock
DAY_S = 86_400
BIN_S = 300

# Period label, first hour, last hour, span in minutes.
PERIODS = [("AM_peak", 6, 9, 240), ("Midday", 10, 15, 360), ("PM_peak", 16, 19, 240), ("Evening", 20, 23, 240)]
NIGHT = ("Night", 360)

# Time-of-day windows in seconds after service midnight, half open.
TOD_WINDOWS = [("am_peak", 21_600, 36_000), ("midday", 36_000, 57_600), ("pm_peak", 57_600, 72_000), ("evening", 72_000, 86_400)]

PEAK_HOURS = (7, 8, 9, 16, 17, 18, 19)


def gtfs_seconds(col: Column) -> Column:
    """'HH:MM:SS' with hours above 24 allowed -> seconds; anything else -> NULL.

    The text stands in it once: where a filter is pushed to the scan it brings the whole making of the text with it for every time it is named.
    """
    seconds = lambda text: F.aggregate(F.split(text, ":"), F.lit(0), lambda s, part: s * 60 + part.try_cast("int"))
    return F.get(F.transform(F.array(F.trim(col)), lambda text: F.when(text.rlike(r"^\d+:\d+:\d+$"), seconds(text))), F.lit(0))


def local_seconds(ts: Column, offset: int = LOCAL_OFFSET_S) -> Column:
    return ts - F.lit(offset)


def local_date(local: Column) -> Column:
    """Calendar date of local epoch seconds, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / DAY_S).cast("int")).cast("string")


def local_hour(local: Column) -> Column:
    return F.floor(F.pmod(local, F.lit(DAY_S)) / 3600).cast("int")


def is_peak(hour: Column) -> Column:
    return hour.isin(*PEAK_HOURS)


def is_weekday(day_name: Column) -> Column:
    return ~F.lower(day_name).isin("saturday", "sunday")


def iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1


def _by_hour(hour: Column, labels: list) -> Column:
    """Value of a 24-entry table; the hour expression is evaluated once."""
    return F.get(F.array(*[F.lit(v) for v in labels]), hour.cast("int"))


def period_of(hour: Column) -> Column:
    labels = [next((p for p, lo, hi, _ in PERIODS if lo <= h <= hi), NIGHT[0]) for h in range(24)]
    return _by_hour(hour, labels)


def period_minutes(hour: Column) -> Column:
    spans = [next((m for _, lo, hi, m in PERIODS if lo <= h <= hi), NIGHT[1]) for h in range(24)]
    return _by_hour(hour, spans)


def tod_window(sec: Column) -> Column:
    """Window of a schedule second; seconds above 24 h fall in the wrapped window."""
    labels = [next((w for w, lo, hi in TOD_WINDOWS if lo <= h * 3600 < hi), None) for h in range(24)]
    return _by_hour(F.floor(F.pmod(sec, F.lit(DAY_S)) / 3600), labels)


def wrap_half_day(delta: Column) -> Column:
    """Clock difference wrapped to (-12 h, 12 h]."""
    half = DAY_S // 2
    return F.lit(half) - F.pmod(F.lit(half) - delta, F.lit(DAY_S))


def parse_version_ts(col: Column) -> Column:
    """Version stamps in three formats -> UTC timestamp; the epoch when none fits."""
    core = F.split_part(col, F.lit("_"), F.lit(1))
    tries = [F.try_to_timestamp(core, F.lit(f)) for f in ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd'T'HHmmss", "yyyyMMdd")]
    return F.coalesce(*tries, F.timestamp_seconds(F.lit(0)))


def hhmm(sec: Column) -> Column:
    """Seconds -> 'HH:MM'."""
    h, m = F.floor(sec / 3600), F.floor(F.pmod(sec, F.lit(3600)) / 60)
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
