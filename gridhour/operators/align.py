"""Daily alignment: statistics per local day, day shifts, fills and expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import row_mean
from gridhour.operators import calendar
from gridhour.operators.joins import join_groups

STATS = {"mean": "avg", "min": "min", "max": "max"}


def daily_stats(
    df: DataFrame,
    ts: str,
    cols: list[str],
    stats: tuple[str, ...] = ("mean", "min", "max"),
    keys: tuple[str, ...] = (),
    tz: str = clock.MADRID,
    day: str = "fecha",
    prefix: str = "",
    shift: int = 0,
) -> DataFrame:
    """``{prefix}{column}_{stat}`` per local day, all columns in one pass.

    ``shift`` moves the day the row is filed under. It is part of the grouping key, so the
    result stays partitioned by its day and can be joined without another shuffle.

    Wide aggregate lists are SQL text: one parsed expression each instead of several
    round trips to the JVM per column.
    """
    aggs = [F.expr(f"{STATS[s]}(`{c}`) AS `{prefix}{c}_{s}`") for c in cols for s in stats]
    when = clock.local_date(F.col(ts), tz)
    return df.groupBy(*keys, (F.date_add(when, shift) if shift else when).alias(day)).agg(*aggs)


def pivot_hours(
    df: DataFrame, ts: str, value: str, prefix: str = "price_h", tz: str = clock.MADRID, day: str = "fecha"
) -> DataFrame:
    """One column per local hour. Of the two 02:00 of an autumn day the first is kept;
    the spring day has no 02:00. The hour list is fixed, so no job looks for it."""
    cells = [
        F.expr(f"min_by(`{value}`, `{ts}`) FILTER (WHERE _h = {h} AND `{value}` IS NOT NULL) AS `{prefix}{h:02d}`")
        for h in range(24)
    ]
    keyed = df.withColumns({"_h": clock.local_hour(F.col(ts), tz), day: clock.local_date(F.col(ts), tz)})
    return keyed.groupBy(day).agg(*cells)


def shift_days(df: DataFrame, day: str, days: int) -> DataFrame:
    """Move rows along the calendar by changing their key."""
    return df.withColumn(day, F.date_add(day, days))


def next_day_target(wide: DataFrame, day: str = "fecha") -> DataFrame:
    """Row D holds the values of D+1 for every calendar day; a missing D+1 gives NULL.

    A key shift plus an equi-join instead of ``lead``: gaps cannot pull a later day in.
    """
    days = calendar.day_calendar(calendar.day_bounds(wide, day), day)
    return days.join(shift_days(wide, day, -1), day, "left")


def lag_block(df: DataFrame, lags: dict[int, str], day: str = "fecha") -> DataFrame:
    """Lagged copies side by side: the value of day X lands on X + k, named ``{c}_{suffix}``.

    Each row is emitted once per lag and regrouped by its new day: one scan and one
    shuffle, where separate copies joined on all days would take one join per lag.
    """
    cols = [c for c in df.columns if c != day]
    copies = df.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in lags])))
    moved = copies.withColumn(day, F.date_add(F.col(day), F.col("_k")))
    cells = [
        F.expr(f"max(`{c}`) FILTER (WHERE _k = {k}) AS `{c}_{suffix}`") for k, suffix in lags.items() for c in cols
    ]
    return moved.groupBy(day).agg(*cells)


def forward_fill(
    df: DataFrame, order: str, cols: list[str], keys: tuple[str, ...] = (), bucket: Column | None = None
) -> DataFrame:
    """Carry the last known value forward along ``order``.

    Works in two levels. Inside a time bucket (a month by default) a window fills what it
    can; the last value of each bucket is then carried over the far shorter list of
    buckets and fills the start of the next ones. A long series is so spread over many
    tasks instead of being sorted in one.
    """
    keys = list(keys)
    bucket = clock.month_floor(F.col(order)) if bucket is None else bucket
    df = df.withColumn("_b", bucket)
    part = [*keys, "_b"]
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in cols]
    )
    # One row per bucket: months of the range, at most a few thousand per key.
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*part, *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in cols])
    filled = df.select(
        *[c for c in df.columns if c not in cols],
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in cols],
    )
    joined = join_groups(filled, carried, part, "left")
    out = [F.coalesce(F.col(c), F.col(f"_in_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns if c != "_b"]
    return joined.select(*out)


def expand_steps(df: DataFrame, day: str, until: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each observation covers the days up to the one before the next observation;
    the last one reaches ``until``.

    The next observation is looked up within and across year buckets, as in
    :func:`forward_fill`; observations of one key and year are at most 366.
    """
    keys = list(keys)
    part = [*keys, "_y"]
    df = df.withColumn("_y", F.year(day))
    heads = df.groupBy(*part).agg(F.min(day).alias("_head"))
    later = Window.partitionBy(*keys).orderBy("_y")
    heads = heads.withColumn("_next_year", F.lead("_head").over(later)).drop("_head")
    inside = Window.partitionBy(*part).orderBy(day)
    stepped = join_groups(df.withColumn("_next", F.lead(day).over(inside)), heads, part, "left")
    last = F.coalesce(F.date_sub(F.coalesce("_next", "_next_year"), 1), until)
    covered = stepped.withColumn("_days", F.when(last >= F.col(day), F.sequence(F.col(day), last)))
    plain = [c for c in df.columns if c not in (day, "_y")]
    return covered.select(F.explode("_days").alias(day), *plain)


def expand_month(df: DataFrame, month: str, today: Column, day: str = "day") -> DataFrame:
    """A monthly value on each day of its month, not past ``today``."""
    first = F.trunc(F.col(month), "month")
    last = F.least(F.last_day(F.col(month)), today)
    days = F.when(last >= first, F.sequence(first, last))
    return df.withColumn(day, F.explode(days)).drop(*([month] if month != day else []))


def row_stats(df: DataFrame, cols: list[str], name: str, keep: list[str]) -> DataFrame:
    """Mean, minimum and maximum over several columns of a row, skipping NULL."""
    return df.select(
        *keep,
        row_mean(cols).alias(f"{name}_mean"),
        F.least(*cols).alias(f"{name}_min"),
        F.greatest(*cols).alias(f"{name}_max"),
    )


def day_gaps(df: DataFrame, day: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Days since the previous observation of the key.

    Windows run per key and year (at most 366 rows); the first day of a year looks
    at the last day of the previous year that has data.
    """
    keys = list(keys)
    part = [*keys, "_y"]
    df = df.withColumn("_y", F.year(day))
    ends = df.groupBy(*part).agg(F.max(day).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_y")
    ends = ends.withColumn("_prev_end", F.lag("_end").over(earlier)).drop("_end")
    inside = Window.partitionBy(*part).orderBy(day)
    prev = F.coalesce(F.lag(day).over(inside), F.col("_prev_end"))
    return join_groups(df, ends, part, "left").withColumn("gap_days", F.datediff(F.col(day), prev)).drop("_y", "_prev_end")


def typical_step(gaps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and most frequent gap with a name for the step."""
    keys = list(keys)
    known = gaps.where(F.col("gap_days").isNotNull())
    tally = known.groupBy(*keys, "gap_days").agg(F.count("*").alias("n"))
    out = tally.groupBy(*keys).agg(
        F.sum("n").alias("n_gaps"),
        (F.sum(F.col("gap_days") * F.col("n")) / F.sum("n")).alias("mean_gap"),
        F.max_by("gap_days", F.struct("n", (-F.col("gap_days")).alias("_s"))).alias("modal_gap"),
    )
    step = (
        F.when(F.col("mean_gap") > 25, "monthly")
        .when(F.col("mean_gap") > 5, "weekly")
        .when(F.col("mean_gap") <= 1.6, "daily")
        .otherwise("irregular")
    )
    return out.withColumn("step", step)


def split_label(day: Column, train_end: str, val_end: str) -> Column:
    """Chronological split; borders belong to the earlier part."""
    return (
        F.when(day <= F.lit(train_end).cast("date"), "train")
        .when(day <= F.lit(val_end).cast("date"), "validation")
        .otherwise("test")
    )
