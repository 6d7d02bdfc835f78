"""Indicator JSON documents: ``indicator.values[]`` to readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.functions import clock, labels
from gridhour.registry import AGGREGATE_GEOS, OFF_PENINSULA_NAMES, PENINSULA_GEO_ID
from gridhour.sources.schemas import INDICATOR


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one JSON object per line, with a fixed schema (no inference pass)."""
    return spark.read.schema(INDICATOR).json(path)


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """Documents held in a text column; the other columns are kept."""
    return df.withColumn("indicator", F.from_json(text, INDICATOR)["indicator"]).drop(text)


def flatten(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per value: UTC instant, value, geography. NULL values are dropped."""
    keep = keep or []
    # The outer form on purpose: for a plain explode Spark adds a size filter below it, which
    # parses every document a second time. Empty documents fall out with the NULL values.
    rows = documents.select(
        *keep, F.col("indicator.id").alias("indicator_id"), F.explode_outer("indicator.values").alias("v")
    )
    when = clock.instant(F.coalesce("v.datetime_utc", "v.datetime"))
    return rows.select(
        *keep,
        "indicator_id",
        when.alias("ts"),
        F.col("v.value").alias("value"),
        F.col("v.geo_id").alias("geo_id"),
        F.col("v.geo_name").alias("geo_name"),
    ).where(F.col("value").isNotNull() & F.col("ts").isNotNull())


def peninsular(readings: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Readings of the peninsular system; some feeds leave the geography empty."""
    geo = F.col("geo_id")
    return readings.where((geo == PENINSULA_GEO_ID) | geo.isNull() if allow_missing else geo == PENINSULA_GEO_ID)


def geo_kind(geo_id: Column, geo_name: Column) -> Column:
    """Total, island or African system by name, or peninsular region."""
    name = F.coalesce(F.lower(geo_name), F.lit(""))
    return (
        F.when(geo_id.isin(*AGGREGATE_GEOS), "aggregate")
        .when(name.rlike("|".join(OFF_PENINSULA_NAMES)), "off_peninsula")
        .otherwise("peninsular")
    )


def regions_wide(readings: DataFrame, day: str, names: list[str], total: str = "regions_total") -> DataFrame:
    """Daily mean per region as columns plus their sum, NULL counting as 0."""
    cells = [F.avg(F.when(F.col("geo_name") == n, F.col("value"))).alias(labels_to_column(n)) for n in names]
    wide = readings.groupBy(day).agg(*cells)
    summed = F.lit(0.0)
    for n in names:
        summed = summed + F.coalesce(F.col(labels_to_column(n)), F.lit(0.0))
    return wide.withColumn(total, summed)


def labels_to_column(name: str) -> str:
    """Column-safe form of a region name."""
    plain = name.lower().translate(str.maketrans(labels.ACCENTED, labels.PLAIN))
    return "".join(ch if ch.isalnum() else "_" for ch in plain)
