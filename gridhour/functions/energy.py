"""Derived energy quantities and their NULL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = 273.15
SECONDS_PER_HOUR = 3600.0
MM_PER_M = 1000.0


def clean_pv(total_solar: Column, thermal_solar: Column) -> Column:
    """Photovoltaic output: total minus solar thermal, never below 0.

    ``greatest`` skips NULL, so both inputs are guarded explicitly.
    """
    known = total_solar.isNotNull() & thermal_solar.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), total_solar - thermal_solar))


def dispatchable_hydro(reservoir: Column, pumped: Column) -> Column:
    """Only the pumped part is optional; a missing reservoir stays missing."""
    return reservoir + F.coalesce(pumped, F.lit(0.0))


def self_consumption(load_with: Column, load_without: Column) -> Column:
    return load_with - load_without


def net_flow(*flows: Column) -> Column:
    """Sum of the borders; one missing border makes the total missing."""
    out = flows[0]
    for f in flows[1:]:
        out = out + f
    return out


def generation_from_load(load: Column, net: Column) -> Column:
    return load - net


def imports(flow: Column) -> Column:
    return F.when(flow.isNotNull(), F.greatest(F.lit(0.0), flow))


def exports(flow: Column) -> Column:
    return F.when(flow.isNotNull(), F.greatest(F.lit(0.0), -flow))


def disagreement(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def to_celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(KELVIN)


def joules_to_watts(j: Column, seconds: float = SECONDS_PER_HOUR) -> Column:
    return j / F.lit(seconds)


def metres_to_mm(m: Column) -> Column:
    return m * F.lit(MM_PER_M)


def modulus(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wrap_longitude(lon: Column) -> Column:
    """0..360 degrees to -180..180."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def channels(cols: list[str], present: set[str]) -> Column:
    """Fixed-order channel vector; channels that are not present are NaN."""
    return F.array(
        *[(F.col(c) if c in present else F.lit(float("nan"))).cast("float") for c in cols]
    )
