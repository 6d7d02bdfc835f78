"""Text labels: market-file headers, zone and source names, contract names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations of the contract labels, January first.
CONTRACT_MONTHS = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]

# Price sources that end a price column name.
PRICE_SOURCES = ("esios", "entsoe", "omie")

# Accented letters and their plain form.
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"


def plain_lower(text: Column) -> Column:
    """Lower case without accents, for matching."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def header_hour(label: Column) -> Column:
    """``H23Q1`` or ``23`` to 23; anything else NULL."""
    digits = F.coalesce(
        F.nullif(F.regexp_extract(label, "^H(\\d+)Q\\d*$", 1), F.lit("")),
        F.nullif(F.regexp_extract(label, "^(\\d+)$", 1), F.lit("")),
    )
    return digits.try_cast("int")


def header_quarter(label: Column) -> Column:
    """``H23Q1`` to 1; hourly labels have no quarter."""
    return F.nullif(F.regexp_extract(label, "^H\\d+Q(\\d+)$", 1), F.lit("")).try_cast("int")


def _source_pattern(sources: tuple[str, ...]) -> str:
    return "^(.+)_(" + "|".join(sources) + ")$"


def price_zone(name: Column, sources: tuple[str, ...] = PRICE_SOURCES) -> Column:
    """Zone part of ``{zone}_{source}``; the zone may hold underscores."""
    return F.upper(F.nullif(F.regexp_extract(name, _source_pattern(sources), 1), F.lit("")))


def price_source(name: Column, sources: tuple[str, ...] = PRICE_SOURCES) -> Column:
    return F.nullif(F.regexp_extract(name, _source_pattern(sources), 2), F.lit(""))


def contract_delivery(label: Column) -> Column:
    """First day of the delivery month of ``Dic-26``; unknown labels are NULL.

    Plain string functions, each part used once: the optimizer copies this expression into
    every filter that mentions the delivery, so it must stay cheap.
    """
    dash = F.instr(label, "-")
    names = F.array(*[F.lit(m) for m in CONTRACT_MONTHS])
    month = F.nullif(F.array_position(names, F.trim(F.substring(label, F.lit(1), dash - 1))), F.lit(0))
    year = F.trim(F.substring(label, dash + 1, F.length(label))).try_cast("smallint")
    return F.add_months(F.lit("2000-01-01").cast("date"), (year * 12 + month - 1).cast("int"))


def contract_label(delivery: Column) -> Column:
    """Inverse of :func:`contract_delivery`."""
    names = F.array(*[F.lit(m) for m in CONTRACT_MONTHS])
    return F.concat(F.element_at(names, F.month(delivery)), F.lit("-"), F.date_format(delivery, "yy"))


def eligible(rule: Column, delivery: Column, day: Column) -> Column:
    """May this contract be the front one on that day?

    ``front_december``: December contracts of this year or later.
    ``next_month``: any delivery after the current month.
    """
    december = (F.month(delivery) == 12) & (F.year(delivery) >= F.year(day))
    monthly = F.trunc(delivery, "month") > F.trunc(day, "month")
    return F.when(rule == "front_december", december).when(rule == "next_month", monthly).otherwise(F.lit(False))
