"""Time-of-day, time-zone and bound expressions. Stored times are naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import DAYS_PER_MONTH

ColumnLike = Column | str


def _as_column(value: ColumnLike) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clock_seconds(clock: str) -> int:
    """``HH:MM`` or ``HH:MM:SS`` as seconds after midnight."""
    parts = [int(p) for p in clock.split(":")]
    if len(parts) not in (2, 3) or not (
        0 <= parts[0] < 24 and all(0 <= p < 60 for p in parts[1:])
    ):
        raise ValueError(f"not a time of day: {clock!r}")
    return sum(p * unit for p, unit in zip(parts, (3600, 60, 1)))


def local_seconds(ts: Column, timezone: ColumnLike) -> Column:
    """Seconds after local midnight of a naive UTC timestamp in an IANA zone."""
    local = F.convert_timezone(F.lit("UTC"), _as_column(timezone), ts)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def wall_to_utc(day: Column, seconds: int, timezone: ColumnLike, day_offset: int = 0) -> Column:
    """Wall-clock time on a calendar day in an IANA zone, as naive UTC."""
    shifted = F.date_add(day, day_offset) if day_offset else day
    local = shifted.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds))
    return F.convert_timezone(_as_column(timezone), F.lit("UTC"), local)


def bound(value: Column, *, is_end: bool = False) -> Column:
    """Query bound text to naive UTC; a bare end date covers its whole day.

    Text with an offset (``Z`` or ``+hh:mm``) is converted to UTC.
    """
    text = F.trim(value)
    zoned = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$") & (F.length(text) > 10)
    moment = F.when(zoned, F.to_timestamp(text).cast("timestamp_ntz")).otherwise(
        F.to_timestamp_ntz(text)
    )
    if not is_end:
        return moment
    whole_day = moment + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return F.when(F.length(text) == 10, whole_day).otherwise(moment)


def month_horizon(today: Column, months: Column) -> Column:
    """``today`` minus a number of 30-day months."""
    return F.date_sub(today, (months * DAYS_PER_MONTH).cast("int"))
