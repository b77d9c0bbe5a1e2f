"""Local hour windows, local time and time distances.

Everything stays ``TIMESTAMP_NTZ`` (UTC, or local wall time), so no result depends on
``spark.sql.session.timeZone``. Limits are compared as intervals, exact to the microsecond;
hours as a double exist only in output columns.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = "UTC"


def hours_interval(hours: float) -> Column:
    """A constant interval of so many hours (fractions allowed)."""
    return F.make_dt_interval(secs=F.lit(hours * 3600.0))


def to_local(time_utc: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(UTC), F.lit(tz), time_utc)


def to_utc(time_local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit(UTC), time_local)


def local_hour_window(
    date: Column, hour_start: Column, hour_end: Column, tz: str
) -> tuple[Column, Column]:
    """The closed window ``hour_start:00:00 .. hour_end:59:59`` of a local date, in UTC."""
    midnight = date.cast("timestamp_ntz")
    first = midnight + F.make_dt_interval(hours=hour_start)
    last = midnight + F.make_dt_interval(hours=hour_end, mins=F.lit(59), secs=F.lit(59))
    return to_utc(first, tz), to_utc(last, tz)


def local_day_end(date: Column, tz: str) -> Column:
    """23:59:59 of a local date, in UTC."""
    return local_hour_window(date, F.lit(23), F.lit(23), tz)[1]


def time_outside(time_utc: Column, start: Column, end: Column) -> Column:
    """Interval from an instant to the nearer edge of a closed window; zero inside it."""
    return (
        F.when(time_utc < start, start - time_utc)
        .when(time_utc > end, time_utc - end)
        .otherwise(F.make_dt_interval())
    )


def as_hours(interval: Column) -> Column:
    """An interval as fractional hours."""
    seconds = interval.cast("interval second").cast("decimal(18,6)").cast("double")
    return seconds / F.lit(3600.0)
