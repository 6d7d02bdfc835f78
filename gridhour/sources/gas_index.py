"""Gas index sheets, landed as CSV with their original headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhour.functions.numbers import half_up
from gridhour.operators.dedupe import keep_first

# The delivery-day header and what the price header must and must not hold.
DAY_COLUMN = "Delivery day"
WANTED = ("MIBGAS", "INDEX")
UNWANTED = ("LNG", "AVB", "VTP", "-PT", "PVB", "LAST", "AVERAGE", "VOLUME")


def price_column(columns: list[str]) -> str | None:
    """First header that names the index and none of its variants."""
    for c in columns:
        up = c.upper()
        if all(w in up for w in WANTED) and not any(u in up for u in UNWANTED):
            return c
    return None


def clean(df: DataFrame, order: list[str], name: str = "gas_mibgas") -> DataFrame:
    """(fecha, price): day-first dates, numbers, bad rows out, first row per day kept."""
    price = price_column(df.columns)
    if price is None:
        raise ValueError(f"no gas index column among {df.columns}")
    text = F.trim(F.col(f"`{DAY_COLUMN}`").cast("string"))
    day = F.coalesce(
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(text, F.lit("d/M/yyyy")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    value = half_up(F.col(f"`{price}`").try_cast("double"), 3)
    rows = df.select(F.to_date(day).alias("fecha"), value.alias(name), *order)
    good = rows.where(F.col("fecha").isNotNull() & F.col(name).isNotNull() & ~F.isnan(name))
    return keep_first(good, ["fecha"], order).select("fecha", name)
