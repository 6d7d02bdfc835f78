"""Runs of instants as intervals: missing hours from-to, and step values that hold until the next.

Both work in time buckets, so no window ever sees a whole series, and neither writes a row for
each hour or day that an interval covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhour.functions.numbers import all_of


def _present(df: DataFrame, ts: str, cols: list[str], keys: list[str]) -> DataFrame:
    """Hours in which a column has a value, once each."""
    hour = F.date_trunc("hour", F.col(ts)).alias("_t")
    long = df.select(*keys, hour, *[F.col(c).isNotNull().alias(c) for c in cols]).unpivot([*keys, "_t"], cols, "column_name", "_has")
    return long.where(F.col("_has") & F.col("_t").isNotNull()).groupBy(*keys, "column_name", "_t").agg(F.lit(1).alias("_one")).drop("_one")


def missing_intervals(
    df: DataFrame, ts: str, cols: list[str], start: Column | None = None, end: Column | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``column_name, from_ts, to_ts, n`` of every maximal run of hours without a value.

    The range is that of the table (of each key) or ``start`` to ``end``, both included. Gaps inside
    a month come from the previous present hour of the month, gaps across months from the last
    and first present hours of the months that have any: a month without a value is no row, so
    a gap over several months is one interval. A column without any value is one gap.
    """
    keys = list(keys)
    by = [*keys, "column_name"]
    here = _present(df, ts, cols, keys).withColumn("_m", F.date_trunc("month", "_t"))
    hour = F.expr("INTERVAL 1 HOUR")
    in_month = Window.partitionBy(*by, "_m").orderBy("_t")
    inner = here.withColumn("_p", F.lag("_t").over(in_month)).select(*by, F.col("_p").alias("_a"), F.col("_t").alias("_b"))
    months = here.groupBy(*by, "_m").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    # a row for each month of a series
    across = Window.partitionBy(*by).orderBy("_m")
    edges = months.withColumn("_p", F.lag("_last").over(across)).select(*by, F.col("_p").alias("_a"), F.col("_first").alias("_b"))
    low = F.date_trunc("hour", F.min(ts) if start is None else F.first(start.cast("timestamp")))
    high = F.date_trunc("hour", F.max(ts) if end is None else F.first(end.cast("timestamp")))
    span = df.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
    series = span.withColumn("column_name", F.explode(F.array(*[F.lit(c) for c in cols])))
    ends = months.groupBy(*by).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    ends = ends.select(*[F.col(k).alias(f"_e_{k}") for k in by], "_first", "_last")
    outer = series.join(ends, all_of([F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in by]), "left")
    before, after = F.col("_low") - hour, F.col("_high") + hour
    outer = outer.select(*by, F.explode(F.array(
        F.struct(before.alias("_a"), F.coalesce(F.col("_first"), after).alias("_b")),
        F.struct(F.coalesce(F.col("_last"), after).alias("_a"), after.alias("_b")),
    )).alias("_x")).select(*by, "_x._a", "_x._b")
    gaps = reduce(DataFrame.unionByName, [inner, edges, outer]).where(F.col("_a").isNotNull())
    n = F.timestamp_diff("HOUR", F.col("_a"), F.col("_b")) - 1
    found = gaps.select(*by, (F.col("_a") + hour).alias("from_ts"), (F.col("_b") - hour).alias("to_ts"), n.alias("n")).where(F.col("n") > 0)
    if start is None and end is None:
        return found
    # hours outside the range are no gaps of it
    inside = found.join(series.select(*[F.col(k).alias(f"_e_{k}") for k in by], "_low", "_high"), all_of([F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in by]))
    cut = inside.withColumns({"from_ts": F.greatest("from_ts", "_low"), "to_ts": F.least("to_ts", "_high")})
    return cut.select(*by, "from_ts", "to_ts", (F.timestamp_diff("HOUR", F.col("from_ts"), F.col("to_ts")) + 1).alias("n")).where(F.col("n") > 0)


def expanded(gaps: DataFrame) -> DataFrame:
    """The hours of intervals, one row each."""
    hours = F.explode(F.sequence("from_ts", "to_ts", F.expr("INTERVAL 1 HOUR"))).alias("ts")
    return gaps.select(*[c for c in gaps.columns if c not in ("from_ts", "to_ts", "n")], hours)


def step_intervals(steps: DataFrame, start: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``_from, _until, value``: each known value holds from its instant to the next one's.

    The last interval is open. Values of a series are few; the window runs per key and year, and
    the first of a year follows the last of the year before through one row a year.
    """
    keys = list(keys)
    known = steps.where(F.col(value).isNotNull() & F.col(start).isNotNull()).select(*keys, F.col(start).cast("timestamp").alias("_from"), F.col(value)).withColumn("_y", F.year("_from"))
    in_year = Window.partitionBy(*keys, "_y").orderBy("_from")
    firsts = known.groupBy(*keys, "_y").agg(F.min("_from").alias("_first"))
    firsts = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_y")))
    firsts = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_y").alias("_yy"), "_next")
    same = all_of([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_y") == F.col("_yy")])
    joined = known.withColumn("_until", F.lead("_from").over(in_year)).join(firsts, same)
    return joined.select(*keys, "_from", F.coalesce("_until", "_next").alias("_until"), F.col(value))


def level_at(points: DataFrame, ts: str, steps: DataFrame, start: str, value: str, keys: tuple[str, ...] = (), name: str | None = None) -> DataFrame:
    """Points with the step value that holds at their instant, NULL before the first.

    An interval join in monthly bins: an interval is one row for each month it touches, a point
    is in one month, and within the month the interval is found by its bounds. No row a day or
    hour is made. Instants of a series are unique among ``steps``.
    """
    keys, name = list(keys), name or value
    newest = points.agg(F.max(ts)).scalar().cast("timestamp")
    spans = step_intervals(steps, start, value, tuple(keys))
    until = F.greatest(F.coalesce("_until", newest + F.expr("INTERVAL 1 SECOND")), F.col("_from"))
    last = F.coalesce(until - F.expr("INTERVAL 1 MICROSECOND"), F.col("_from"))
    bins = F.sequence(F.date_trunc("month", "_from"), F.greatest(F.date_trunc("month", last), F.date_trunc("month", "_from")), F.expr("INTERVAL 1 MONTH"))
    binned = spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_from", "_until", F.col(value).alias("_value"), F.explode(bins).alias("_bin"))
    at = F.col(ts).cast("timestamp")
    inside = (F.col("_from") <= at) & (F.col("_until").isNull() | (at < F.col("_until")))
    same = all_of([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.date_trunc("month", at) == F.col("_bin"), inside])
    return points.join(binned, same, "left").select(*[points[c] for c in points.columns], F.col("_value").alias(name))
