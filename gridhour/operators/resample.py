"""Sub-hourly readings to the hourly grain. Power averages, energy sums."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import half_up
from gridhour.operators.joins import join_groups

AGGREGATES = {"avg": F.avg, "sum": F.sum}


def to_hour(df: DataFrame, ts: str, how: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Hourly frame; ``how`` gives ``avg`` (power, price) or ``sum`` (energy) per column.

    Only hours with at least one reading appear. Partial aggregation runs before
    the shuffle, so one very long series costs no more than its number of hours.
    """
    hour = clock.hour_floor(F.col(ts)).alias("ts")
    return df.groupBy(*keys, hour).agg(*[AGGREGATES[a](c).alias(c) for c, a in how.items()])


def to_hour_by_unit(df: DataFrame, ts: str, series: str, value: str, summed: set[str]) -> DataFrame:
    """Long form of :func:`to_hour`: series named in ``summed`` are energy."""
    hour = clock.hour_floor(F.col(ts)).alias("ts")
    both = df.groupBy(series, hour).agg(F.avg(value).alias("_mean"), F.sum(value).alias("_sum"))
    picked = F.when(F.col(series).isin(*sorted(summed)), F.col("_sum")).otherwise(F.col("_mean"))
    return both.select(series, "ts", picked.alias(value))


def modal_complete_hours(df: DataFrame, ts: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hourly mean, keeping only hours with the usual number of readings.

    The usual number is the most frequent count per key (the smallest on a tie).
    Both steps aggregate counts, so their state is hours and distinct counts.
    """
    keys = list(keys)
    hour = clock.hour_floor(F.col(ts)).alias("ts")
    hours = df.groupBy(*keys, hour).agg(F.count(value).alias("n"), F.avg(value).alias(value))
    tally = hours.groupBy(*keys, "n").agg(F.count("*").alias("_hours"))
    usual = tally.groupBy(*keys).agg(
        F.max_by("n", F.struct("_hours", (-F.col("n")).alias("_small"))).alias("_usual")
    )
    if keys:
        joined = join_groups(hours, usual, keys)
    else:
        joined = hours.withColumn("_usual", usual.select("_usual").scalar())
    return joined.where(F.col("n") == F.col("_usual")).drop("_usual")


def labelled_hours(
    df: DataFrame, file: str, hour: str, value: str, n_hours: str, per_hour: str, places: int = 2
) -> DataFrame:
    """Hourly half-up mean of labelled values, all or nothing per file.

    A file counts only if it has exactly the hours 1..n, each with the expected
    number of values. Label gives the hour; position never does.
    """
    hours = df.groupBy(file, hour).agg(
        half_up(F.avg(value), places).alias(value),
        F.count(value).alias("_n"),
        F.max(n_hours).alias("_n_hours"),
        F.max(per_hour).alias("_per_hour"),
    )
    valid = hours.groupBy(file).agg(
        (
            (F.count("*") == F.max("_n_hours"))
            & (F.min(hour) == 1)
            & (F.max(hour) == F.max("_n_hours"))
            & (F.min("_n") == F.max("_per_hour"))
            & (F.max("_n") == F.max("_per_hour"))
        ).alias("_ok")
    )
    return hours.join(valid.where("_ok"), file).select(file, hour, value)


def on_local_day(df: DataFrame, ts: str, day: date, tz: str = clock.MADRID) -> DataFrame:
    """Rows of one local business day, as a plain range so the scan can skip files."""
    start, end = clock.local_day_bounds(day, tz)
    kind = dict(df.dtypes)[ts]
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def hourly_on_local_day(
    df: DataFrame, ts: str, how: dict[str, str], day: date, keys: tuple[str, ...] = (), tz: str = clock.MADRID
) -> DataFrame:
    """Hourly values of one local day, built from all their sub-hour readings.

    Local days start on a whole hour, so cutting the readings at the day's bounds
    keeps every reading of its hours; filtering readings by whole-hour stamps would not.
    """
    return to_hour(on_local_day(df, ts, day, tz), ts, how, keys)


def map_codes(
    df: DataFrame, keys: list[str], code: str, value: str, mapping: dict[str, list[str]]
) -> DataFrame:
    """Source codes to canonical columns, summing the codes of a column.

    A NULL reading of a code that is present counts as 0; a column none of whose
    codes is present stays NULL.
    """
    used = sorted({c for codes in mapping.values() for c in codes})

    def column(name: str, codes: list[str]) -> Column:
        part = F.when(F.col(code).isin(*codes), F.coalesce(F.col(value), F.lit(0.0)))
        return F.sum(part).alias(name)

    return df.where(F.col(code).isin(*used)).groupBy(*keys).agg(*[column(n, cs) for n, cs in mapping.items()])


def unmapped_codes(df: DataFrame, code: str, mapping: dict[str, list[str]]) -> DataFrame:
    """Codes in the data that no canonical column takes, NULL among them, with their row counts."""
    used = sorted({c for codes in mapping.values() for c in codes})
    return df.where(F.col(code).isNull() | ~F.col(code).isin(*used)).groupBy(code).agg(F.count("*").alias("n_rows"))


def sparse_to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long (key, column, value) readings to one wide row per key, one shuffle.

    Keys and names are unique after :func:`gridhour.operators.dedupe.keep_last`;
    ``max`` only picks the single value of each cell.
    """
    def cell(n: str) -> Column:
        mine = F.when(F.col(name) == n, F.col(value))
        return F.max(mine).alias(n)

    return df.where(F.col(name).isin(*names)).groupBy(*keys).agg(*[cell(n) for n in names])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
