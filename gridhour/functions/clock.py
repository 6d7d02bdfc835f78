"""UTC instants against the local business day (23, 24 or 25 hours)."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MADRID = "Europe/Madrid"


def instant(text: Column) -> Column:
    """ISO-8601 text with an offset or ``Z`` to a UTC instant; bad text is NULL."""
    return F.try_to_timestamp(text)


def local_ts(ts: Column, tz: str = MADRID) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), tz)


def local_date(ts: Column, tz: str = MADRID) -> Column:
    return F.to_date(local_ts(ts, tz))


def local_hour(ts: Column, tz: str = MADRID) -> Column:
    return F.hour(local_ts(ts, tz))


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts.cast("timestamp"))


def month_floor(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def day_start(day: Column, tz: str = MADRID) -> Column:
    """UTC instant at which a local day starts."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def day_hours(day: Column, tz: str = MADRID) -> Column:
    """Array with the 23, 24 or 25 UTC hours of a local day."""
    last = day_start(F.date_add(day, 1), tz) - F.expr("INTERVAL 1 HOUR")
    return F.sequence(day_start(day, tz), last, F.expr("INTERVAL 1 HOUR"))


def day_length(day: Column, tz: str = MADRID) -> Column:
    """Hours in a local day."""
    seconds = F.unix_timestamp(day_start(F.date_add(day, 1), tz)) - F.unix_timestamp(day_start(day, tz))
    return (seconds / F.lit(3600)).cast("int")


def weekday_features(day: Column, prefix: str = "d1") -> list[Column]:
    """Calendar features of the day after ``day`` (Monday is 0)."""
    nxt = F.date_add(day, 1)
    return [
        F.weekday(nxt).alias(f"{prefix}_dow"),
        F.month(nxt).alias(f"{prefix}_month"),
        (F.weekday(nxt) >= 5).cast("int").alias(f"{prefix}_is_weekend"),
    ]


def epoch_any_unit(x: Column) -> Column:
    """Epoch number of unknown unit: nanoseconds, milliseconds or seconds by size."""
    micros = (
        F.when(x > F.lit(10**15), F.floor(x / 1000))
        .when(x > F.lit(10**12), x * 1000)
        .otherwise(x * 1000000)
    )
    return F.timestamp_micros(micros.try_cast("bigint"))


def local_day_bounds(day: date, tz: str = MADRID) -> tuple[datetime, datetime]:
    """Half-open UTC bounds of a local day as plain values, so that a filter on the
    stored instant column is pushed into the scan."""
    zone = ZoneInfo(tz)
    start = datetime(day.year, day.month, day.day, tzinfo=zone)
    nxt = day + timedelta(days=1)
    end = datetime(nxt.year, nxt.month, nxt.day, tzinfo=zone)
    return (
        start.astimezone(timezone.utc).replace(tzinfo=None),
        end.astimezone(timezone.utc).replace(tzinfo=None),
    )


def arrival_rank(ts: Column, tie: Column) -> Column:
    """One number that orders rows by instant and, at equal instants, by a fixed hash of the
    id. As a plain decimal it fits the buffer of a hash aggregate; a struct would force every
    group to be sorted."""
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    spread = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    return micros * spread + F.shiftrightunsigned(F.xxhash64(tie), 1).cast("decimal(19,0)")
