"""Day-ahead market result files: one text per delivery day.

A file counts as a whole or not at all. Values belong to the hour their header label
names; the labels come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions import clock, labels
from gridhour.functions.numbers import half_up, number_from_text
from gridhour.operators import dedupe

# How the price lines of the two zones begin, without accents.
SPANISH_LINE = "precio marginal en el sistema espanol"
PORTUGUESE_LINE = "precio marginal en el sistema portugues"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) rows; files are a few kilobytes, so one row each is fine."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _price_line(lines: Column, key: str) -> Column:
    """Numbers of the first line that has the key text and any number."""
    matching = F.filter(lines, lambda ln: labels.plain_lower(ln).contains(key))
    numbers = F.transform(
        matching,
        lambda ln: F.filter(F.transform(F.split(ln, ";"), number_from_text), lambda x: x.isNotNull()),
    )
    return _first(F.filter(numbers, lambda a: F.size(a) > 0))


def _header(lines: Column) -> Column:
    """Labels of the first header line: all ``H..Q..`` or all plain numbers."""
    candidates = F.transform(
        F.filter(lines, lambda ln: ln.startswith(";")),
        lambda ln: F.filter(F.transform(F.split(ln, ";"), lambda t: F.upper(F.trim(t))), lambda t: t != ""),
    )
    return _first(
        F.filter(
            candidates,
            lambda a: (F.size(a) > 0)
            & (F.forall(a, lambda t: t.startswith("H") & t.contains("Q")) | F.forall(a, lambda t: t.rlike("^\\d+$"))),
        )
    )


def parse(files: DataFrame, text: str = "text", expected: str | None = None, tz: str = clock.MADRID) -> DataFrame:
    """Parsed form of each file with the reason if it is rejected."""
    keep = [c for c in files.columns if c != text]
    lines = F.transform(F.split(F.col(text), "\\r?\\n"), lambda ln: F.trim(ln))
    read = files.select(*keep, lines.alias("lines"))
    token = _first(F.filter(F.transform(F.split(F.col("lines")[0], ";"), lambda t: F.trim(t)), lambda t: t.rlike("^\\d{2}/\\d{2}/\\d{4}$")))
    read = read.select(
        *keep,
        F.to_date(F.try_to_timestamp(token, F.lit("dd/MM/yyyy"))).alias("delivery"),
        _price_line(F.col("lines"), SPANISH_LINE).alias("es"),
        _price_line(F.col("lines"), PORTUGUESE_LINE).alias("pt"),
        _header(F.col("lines")).alias("header"),
    )
    n = F.size("es")
    read = read.withColumn("n_hours", clock.day_length(F.col("delivery"), tz)).withColumn(
        "per_hour", F.when(n == F.col("n_hours") * 4, 4).when(n == F.col("n_hours"), 1)
    ).withColumn("hours", F.transform("header", labels.header_hour))
    whole = (
        F.forall(F.sequence(F.lit(1), F.col("n_hours")), lambda h: F.size(F.filter("hours", lambda x: x == h)) == F.col("per_hour"))
        & (F.size(F.array_distinct("header")) == F.size("header"))
    )
    wrong_day = F.col("delivery").isNull()
    if expected is not None:
        wrong_day = wrong_day | (F.col("delivery") != F.col(expected))
    outside = lambda v: ~v.between(*reg.PRICE_RANGE)
    same_size = F.coalesce(F.size("pt") == n, F.lit(False))
    reason = (
        F.when(wrong_day, "other delivery date")
        .when(F.col("es").isNull(), "no price line")
        .when(F.col("header").isNull() | (F.size("header") != n), "header missing or of other length")
        .when(F.col("per_hour").isNull(), "number of values fits neither format")
        .when(~F.coalesce(whole, F.lit(False)), "labels do not cover the day")
        .when(F.exists("es", outside) | F.coalesce(F.exists("pt", outside) & same_size, F.lit(False)), "price out of range")
    )
    return read.withColumn("reason", reason).withColumn("pt", F.when(same_size, F.col("pt")))


def rejected(parsed: DataFrame) -> DataFrame:
    kept = [c for c in parsed.columns if c not in ("es", "pt", "header", "hours", "per_hour", "n_hours")]
    return parsed.where(F.col("reason").isNotNull()).select(*kept)


def newest_versions(parsed: DataFrame, version: str = "file") -> DataFrame:
    """Of the accepted files of a delivery day the one with the greatest version."""
    return dedupe.keep_last(parsed.where(F.col("reason").isNull()), ["delivery"], [version])


def hourly_prices(parsed: DataFrame, file: str = "file", tz: str = clock.MADRID, places: int = 2) -> DataFrame:
    """Half-up hourly means of the accepted files, keyed by UTC instant."""
    blank = F.transform("es", lambda _: F.lit(None).cast("decimal(18,6)"))
    cells = F.arrays_zip("hours", F.col("es").alias("es"), F.coalesce("pt", blank).alias("pt"))
    rows = parsed.where(F.col("reason").isNull()).select(file, "delivery", F.explode(cells).alias("c"))
    return (
        rows.groupBy(file, "delivery", F.col("c.hours").alias("hour"))
        .agg(half_up(F.avg("c.es"), places).alias("es_omie"), half_up(F.avg("c.pt"), places).alias("pt_omie"))
        .withColumn("ts", F.timestamp_add("HOUR", F.col("hour") - 1, clock.day_start(F.col("delivery"), tz)))
    )
