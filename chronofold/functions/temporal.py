"""Moments of local market days as UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: where the market's days are.
ZONE = "Asia/Taipei"


def local(moment: Column, zone: str = ZONE) -> Column:
    """The UTC moment at which the clock of the zone shows `moment`; the session's time zone is UTC. Null stays null."""
    return F.to_utc_timestamp(moment, zone)


def end_of_day(day: Column, zone: str = ZONE) -> Column:
    """The last microsecond of a local day."""
    return local(F.date_add(day.cast("date"), 1).cast("timestamp") - F.expr("interval 1 microsecond"), zone)


def cutoff(day: Column, hour: int = 18, zone: str = ZONE) -> Column:
    """A full hour of a local day, at which what the day's close showed is known."""
    return local(day.cast("date").cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), zone)


def local_day(moment: Column, zone: str = ZONE) -> Column:
    """The local day of a UTC moment."""
    return F.from_utc_timestamp(moment, zone).cast("date")


def known_by(available: Column, day: Column, hour: int = 18, zone: str = ZONE) -> Column:
    """Whether something was there at the day's cutoff; false for null."""
    return F.coalesce(available <= cutoff(day, hour, zone), F.lit(False))
