"""Table scans and sinks."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.functions import labels
from gridhour.functions.clock import month_floor
from gridhour.functions.numbers import nan_to_null
from gridhour.registry import AUDIT_COLUMNS, SOURCE_ZONES, TableSpec
from gridhour.session import instants_as_micros, spread_writers
from gridhour.sources.schemas import AUDIT, conform

log = logging.getLogger(__name__)


def scan(spark: SparkSession, path: str, time_col: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Parquet scan of the time column and the registered columns; all when none are given."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return without_nan(df.select(time_col, *columns) if columns else df)


def without_nan(df: DataFrame) -> DataFrame:
    """Missing values that other tools wrote as NaN become NULL, so that counts and merges
    see them as missing."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def scan_all(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Named parquet tables below a root; a missing one is skipped with a warning."""
    found = {}
    for name in names:
        try:
            found[name] = without_nan(spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("table %s is missing below %s and is left out", name, root)
    return found


def between(df: DataFrame, ts: str, start: str, end: str, last_day: bool = True) -> DataFrame:
    """Rows from ``start`` to ``end`` (dates). The last day is included whole; with
    ``last_day=False`` the range stops at its midnight, both ends included.

    Bounds take the type of the column, so the filter reaches the parquet reader.
    """
    kind = dict(df.dtypes)[ts]
    lo = F.lit(start).cast(kind)
    if not last_day:
        return df.where(F.col(ts).between(lo, F.lit(end).cast(kind)))
    return df.where((F.col(ts) >= lo) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast(kind)))


def normalize_time(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rename the time column by grain, prefix the others, drop audit columns."""
    key = "date_local" if spec.grain == "daily" else "ts_utc"
    kind = "date" if spec.grain == "daily" else "timestamp"
    kept = [c for c in df.columns if c != spec.time_col and c not in AUDIT_COLUMNS]
    return df.select(
        F.col(spec.time_col).cast(kind).alias(key), *[F.col(c).alias(f"{spec.prefix}_{c}") for c in kept]
    )


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source_df", F.lit(name))


def write_hourly(df: DataFrame, path: str, ts: str) -> None:
    """Parquet by month; a rerun replaces only the months it holds.

    Spark rebalances the writers by month, splitting large months; rows are sorted by time
    inside each file, so range filters skip row groups.
    """
    monthly = df.withColumn("month", F.date_format(month_floor(F.col(ts)), "yyyy-MM"))
    with instants_as_micros(df.sparkSession):
        (
            spread_writers(monthly, "month", [ts])
            .sortWithinPartitions("month", ts)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .parquet(path)
        )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def audit_row(spark: SparkSession, name: str, started: Column, ended: Column, rows: int, state: str, message: str = "") -> DataFrame:
    """One audit record of a run."""
    return spark.range(1).select(
        F.lit(name).alias("pipeline"),
        started.cast("timestamp").alias("fecha_inicio"),
        ended.cast("timestamp").alias("fecha_fin"),
        F.lit(rows).cast("bigint").alias("registros"),
        F.lit(state).alias("estado"),
        F.lit(message).alias("mensaje"),
        (ended.cast("timestamp").cast("double") - started.cast("timestamp").cast("double")).alias("duracion_seg"),
    )


def append_audit(record: DataFrame, path: str) -> None:
    conform(record, AUDIT).write.mode("append").parquet(path)


def discover_prices(df: DataFrame, ts: str) -> tuple[list[str], list[str]]:
    """Price columns ``{zone}_{source}`` of a table, and the columns that are ignored.

    The table rules: a new zone is a new column and needs no change here.
    """
    used, ignored = [], []
    for c in df.columns:
        if c == ts:
            continue
        source = next((s for s in labels.PRICE_SOURCES if c.endswith(f"_{s}") and c != f"_{s}"), None)
        zone = c[: -len(source) - 1].upper() if source else None
        known = source is not None and (source not in SOURCE_ZONES or zone in SOURCE_ZONES[source])
        (used if known else ignored).append(c)
    return used, ignored


def prices_long(df: DataFrame, ts: str) -> DataFrame:
    """Discovered price columns as (ts, zone, source, price) rows."""
    used, _ = discover_prices(df, ts)
    same = df.select(ts, *[F.col(c).cast("double").alias(c) for c in used])
    long = same.unpivot(ts, used, "column_name", "price").where(F.col("price").isNotNull())
    return long.select(
        ts,
        "column_name",
        labels.price_zone(F.col("column_name")).alias("zone"),
        labels.price_source(F.col("column_name")).alias("source"),
        "price",
    )


def daily_close(df: DataFrame, date_col: str, close_col: str, name: str) -> DataFrame:
    """Landed close series of one ticker: NaN and unparsable closes are dropped."""
    close = F.col(close_col).try_cast("double")
    return (
        df.select(F.col(date_col).try_cast("date").alias("fecha"), close.alias(name))
        .where(F.col(name).isNotNull() & ~F.isnan(name) & F.col("fecha").isNotNull())
    )
