"""Number rules: rounding, ranges, NULL-aware sums, text parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int = 2) -> Column:
    """Price rounding: ties go away from zero."""
    return F.round(c, places)


def half_even(c: Column, places: int = 2) -> Column:
    """Presentation rounding of float frames: ties go to the even digit."""
    return F.bround(c, places)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def within(c: Column, low: float, high: float) -> Column:
    """The value if it lies in the sane range, else NULL."""
    return F.when(c.between(low, high), c)


def zero_to_null(c: Column) -> Column:
    """For quantities that can never be exactly zero."""
    return F.nullif(c, F.lit(0).cast("double"))


def percent(part: Column, total: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, total)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# Rules over many columns are SQL text: one parsed expression instead of a chain of calls.


def none_null(cols: list[str]) -> Column:
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def sum_null_as_zero(cols: list[str]) -> Column:
    """Row sum where NULL counts as 0; a row of NULLs gives 0."""
    return F.expr(" + ".join(f"coalesce(`{c}`, 0.0D)" for c in cols))


def sum_if_any(cols: list[str]) -> Column:
    """Row sum that is NULL only when every input is NULL."""
    return F.when(F.coalesce(*cols).isNotNull(), sum_null_as_zero(cols))


def row_mean(cols: list[str]) -> Column:
    """Row mean that skips NULL."""
    present = F.expr(" + ".join(f"CAST(`{c}` IS NOT NULL AS INT)" for c in cols))
    return F.try_divide(sum_null_as_zero(cols), present)


def number_from_text(text: Column) -> Column:
    """Number with a decimal comma or point; with both, the point groups thousands.

    Text with letters, empty text and anything unparsable is NULL.
    """
    t = F.trim(text)
    both = t.contains(",") & t.contains(".")
    plain = F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
        F.replace(t, F.lit(","), F.lit("."))
    )
    usable = (t != "") & ~t.rlike("\\p{L}")
    return F.when(usable, plain).try_cast("decimal(18,6)")


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins: label i for values up to edges[i]."""
    out = F.when(c <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c <= edge, label)
    return out
