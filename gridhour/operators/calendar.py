"""Hourly and daily calendars that know the 23- and 25-hour days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhour.functions import clock

HOUR = "INTERVAL 1 HOUR"


def hour_bounds(df: DataFrame, ts: str) -> DataFrame:
    """One row (start, end): first and last whole hour of a table."""
    t = F.col(ts).cast("timestamp")
    return df.agg(
        F.date_trunc("hour", F.min(t)).alias("start"),
        F.date_trunc("hour", F.max(t)).alias("end"),
    )


def day_bounds(df: DataFrame, day: str) -> DataFrame:
    """One row (start, end): first and last day of a table."""
    return df.agg(F.min(day).cast("date").alias("start"), F.max(day).cast("date").alias("end"))


def hourly_calendar(bounds: DataFrame, tz: str = clock.MADRID) -> DataFrame:
    """Hours of a (start, end) row with their local and UTC date and hour."""
    hours = bounds.select(F.explode(F.sequence("start", "end", F.expr(HOUR))).alias("ts_utc"))
    return hours.select(
        "ts_utc",
        clock.local_ts(F.col("ts_utc"), tz).alias("ts_local"),
        F.to_date("ts_utc").alias("date_utc"),
        clock.local_date(F.col("ts_utc"), tz).alias("date_local"),
        F.hour("ts_utc").alias("hour_utc"),
        clock.local_hour(F.col("ts_utc"), tz).alias("hour_local"),
    )


def fixed_bounds(spark, start: str, end: str) -> DataFrame:
    """(start, end) row from ISO text, for a calendar that does not follow a table."""
    return spark.range(1).select(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end"))


def day_calendar(bounds: DataFrame, name: str = "day") -> DataFrame:
    """Every day of a (start, end) row."""
    return bounds.select(F.explode(F.sequence("start", "end")).alias(name))


def expected_hours(days: DataFrame, day: str = "day", tz: str = clock.MADRID) -> DataFrame:
    """One row per expected hour of each local day; other columns are kept."""
    return days.withColumn("ts", F.explode(clock.day_hours(F.col(day), tz)))


def hours_per_day(calendar: DataFrame, day: str = "date_local") -> DataFrame:
    return calendar.groupBy(day).agg(F.count("*").alias("n_hours"))


def atypical_days(calendar: DataFrame, day: str = "date_local") -> DataFrame:
    """Local days without 24 hours: clock changes and range edges."""
    return hours_per_day(calendar, day).where(F.col("n_hours") != 24)


def clock_change_check(calendar: DataFrame, tz: str = clock.MADRID, day: str = "date_local") -> DataFrame:
    """Compare the hours present in each day with the length the time zone gives."""
    return (
        hours_per_day(calendar, day)
        .withColumn("n_expected", clock.day_length(F.col(day), tz))
        .withColumn("intact", F.col("n_hours") == F.col("n_expected"))
    )
