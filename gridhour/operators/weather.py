"""Weather grids in long form: crop, derive, de-accumulate, average over space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhour.functions import clock, energy
from gridhour.registry import GRID_CHANNELS


def crop(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells inside the box; longitudes are brought to -180..180 first."""
    wrapped = df.withColumn("lon", energy.wrap_longitude(F.col("lon")))
    return wrapped.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def with_wind(df: DataFrame, level: str) -> DataFrame:
    return df.withColumn(f"wind{level}", energy.modulus(F.col(f"u{level}"), F.col(f"v{level}")))


def deaccumulate(
    df: DataFrame, cols: list[str], seconds: float, run: tuple[str, ...] = ("run_date",), step: str = "valid_time"
) -> DataFrame:
    """Running totals of a forecast to mean rates per second, never below 0.

    One window covers the steps of one run at one cell, a few dozen rows. The first
    step only serves as the start and is dropped.
    """
    w = Window.partitionBy(*run, "lat", "lon").orderBy(step)
    rates = [F.greatest(F.lit(0.0), (F.col(c) - F.lag(c).over(w)) / F.lit(seconds)) for c in cols]
    guarded = [
        F.when(F.col(c).isNotNull() & F.lag(c).over(w).isNotNull(), r).alias(c) for c, r in zip(cols, rates)
    ]
    out = df.select(*[c for c in df.columns if c not in cols], *guarded, F.row_number().over(w).alias("_n"))
    return out.where(F.col("_n") > 1).drop("_n")


def spatial_mean(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Plain mean over the cells of each instant (not weighted by latitude)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])


def cell_channels(df: DataFrame, keys: list[str], order: tuple[str, ...] = GRID_CHANNELS) -> DataFrame:
    """One float vector per cell with channels in a fixed order."""
    present = set(df.columns)
    return df.select(*keys, energy.channels(list(order), present).alias("channels"))


def position_in_month(df: DataFrame, ts: str) -> DataFrame:
    """0-based place of each instant within its month (at most 744 hours per window)."""
    w = Window.partitionBy(clock.month_floor(F.col(ts))).orderBy(ts)
    return df.withColumn("tensor_index", F.row_number().over(w) - 1)
