"""Data-quality operators: completeness, coherence, revisions, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import add_all, all_of, none_null, percent, sum_null_as_zero
from gridhour.operators import calendar, joins, profile
from gridhour.registry import CO2_REFERENCE


def days_with_hours(df: DataFrame, ts: str, cols: list[str], keys: tuple[str, ...] = (), tz: str = clock.MADRID) -> DataFrame:
    """Rows and filled values per local day, every day of the table's range included."""
    present = df.groupBy(*keys, clock.local_date(F.col(ts), tz).alias("day")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(none_null(cols)).alias("n_complete"),
        *[F.count(c).alias(c) for c in cols],
    )
    if keys:
        span = present.groupBy(*keys).agg(F.min("day").alias("start"), F.max("day").alias("end"))
        days = span.select(*keys, F.explode(F.sequence("start", "end")).alias("day"))
    else:
        days = calendar.day_calendar(calendar.day_bounds(present, "day"))
    days = days.withColumn("n_expected", clock.day_length(F.col("day"), tz))
    zero = {c: 0 for c in ["n_rows", "n_complete", *cols]}
    return days.join(present, [*keys, "day"], "left").fillna(zero)


def day_status(df: DataFrame, ts: str, cols: list[str], keys: tuple[str, ...] = (), tz: str = clock.MADRID) -> DataFrame:
    """Is each local day complete: enough rows, and enough rows with all key columns?"""
    d = days_with_hours(df, ts, cols, keys, tz)
    whole = (F.col("n_rows") >= F.col("n_expected")) & (F.col("n_complete") >= F.col("n_expected"))
    return d.select(*keys, "day", "n_expected", "n_rows", "n_complete", whole.alias("is_complete"))


def gaps_by_column(df: DataFrame, ts: str, cols: list[str], keys: tuple[str, ...] = (), tz: str = clock.MADRID) -> DataFrame:
    """Missing hours per local day and column; a day without rows misses all of them."""
    d = days_with_hours(df, ts, cols, keys, tz)
    long = d.unpivot([*keys, "day", "n_expected"], cols, "column_name", "n_filled")
    return long.withColumn("n_missing", F.col("n_expected") - F.col("n_filled")).where(F.col("n_missing") > 0)


def policy_status(
    df: DataFrame,
    ts: str,
    cols: list[str],
    critical: dict[str, int],
    sporadic: set[str],
    tz: str = clock.MADRID,
) -> DataFrame:
    """Day verdict under a column policy.

    Critical columns may miss at most their tolerance. Sporadic columns may be empty.
    The others are recoverable: counted, but no reason to reject the day.
    """
    d = days_with_hours(df, ts, cols, (), tz)
    missing = {c: F.greatest(F.col("n_expected") - F.col(c), F.lit(0)) for c in cols}
    zero = F.lit(0)
    recoverable = [c for c in cols if c not in critical and c not in sporadic]
    critical_ok = all_of([missing[c] <= tol for c, tol in critical.items()]) if critical else F.lit(True)
    return d.select(
        "day",
        "n_expected",
        "n_rows",
        add_all([zero, *[missing[c] for c in critical]]).alias("missing_critical"),
        add_all([zero, *[missing[c] for c in recoverable]]).alias("missing_recoverable"),
        add_all([zero, *[missing[c] for c in cols if c in sporadic]]).alias("missing_sporadic"),
        critical_ok.alias("critical_ok"),
        (critical_ok & (F.col("n_rows") >= F.col("n_expected"))).alias("is_complete"),
    )


def complete_days(df: DataFrame, ts: str, col: str, tz: str = clock.MADRID) -> DataFrame:
    """Local days with at least as many values as the day has hours."""
    counted = df.groupBy(clock.local_date(F.col(ts), tz).alias("day")).agg(F.count(col).alias("n"))
    return counted.where(F.col("n") >= clock.day_length(F.col("day"), tz))


def source_coherence(df: DataFrame, base: str, others: list[str], tol: float = 0.001) -> DataFrame:
    """Hours with all sources, hours in which each differs from the base, largest gap."""
    full = df.where(none_null([base, *others]))
    gaps = [F.abs(F.col(c) - F.col(base)) for c in others]
    widest = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return full.agg(
        F.count("*").alias("n_hours"),
        *[F.count_if(g > tol).alias(f"n_diff_{c}") for c, g in zip(others, gaps)],
        F.max(widest).alias("max_diff"),
    )


def pair_difference(winner: DataFrame, loser: DataFrame, w_cols: list[str], l_cols: list[str]) -> DataFrame:
    """Hours of two sources with the absolute difference of their row sums."""
    a = winner.select("ts", sum_null_as_zero(w_cols).alias("winner"))
    b = loser.select("ts", sum_null_as_zero(l_cols).alias("loser"))
    pair = joins.pair_on_key(a, b, ["ts"])
    return pair.withColumn("diff_abs", F.abs(F.col("winner") - F.col("loser"))).withColumn("day", F.to_date("ts"))


def flag_above_quantile(pairs: DataFrame, prob: float = 0.99, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mark hours whose difference exceeds its own exact quantile."""
    limit = profile.quantile_columns(pairs, "diff_abs", {"threshold": prob}, keys)
    if keys:
        marked = joins.join_groups(pairs, limit, list(keys))
    else:
        marked = pairs.withColumn("threshold", limit.select("threshold").scalar())
    return marked.withColumn("suspect", F.col("diff_abs") > F.col("threshold"))


def pair_summary(marked: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n_hours"),
        F.max("threshold").alias("threshold"),
        F.count_if("suspect").alias("n_suspect"),
        percent(F.count_if("suspect"), F.count("*")).alias("pct_suspect"),
    )


def worst_days(marked: DataFrame, n: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Top days by flagged hours: a report of n rows, of each group with its place, by design."""
    days = marked.where("suspect").groupBy(*keys, "day").agg(
        F.count("*").alias("n_suspect"), F.avg("diff_abs").alias("diff_mean"), F.max("diff_abs").alias("diff_max")
    )
    if not keys:
        return days.orderBy(F.desc("n_suspect"), "day").limit(n)
    # tasks drop all but their first n days of a group before these meet
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_suspect"), "day"))
    return days.withColumn("place", place).where(F.col("place") <= n)


def zone_spread(long: DataFrame, base: DataFrame, zone: str, ts: str, value: str, split_tol: float = 1.0) -> DataFrame:
    """Each zone against a base series on their common hours."""
    pair = long.join(base.select(ts, F.col(value).alias("_base")), ts)
    pair = pair.where(F.col(value).isNotNull() & F.col("_base").isNotNull())
    d = F.col(value) - F.col("_base")
    return pair.groupBy(zone).agg(
        F.count("*").alias("n"),
        F.corr(F.col(value), F.col("_base")).alias("corr"),
        F.avg(d).alias("spread_mean"),
        F.stddev_samp(d).alias("spread_std"),
        percent(F.count_if(F.abs(d) > split_tol), F.count("*")).alias("pct_split"),
    )


def revised_after_publication(stored: DataFrame, live: DataFrame, ts: str, col: str, tol: float = 0.5, tz: str = clock.MADRID) -> DataFrame:
    """Hours compared and hours that changed since they were stored, per local day.

    Every live value counts as compared when its hour is stored.
    """
    pair = joins.compare_values(stored, live, [ts], [col], tol).where(F.col(f"new_{col}").isNotNull())
    return pair.groupBy(clock.local_date(F.col(ts), tz).alias("day")).agg(
        F.count("*").alias("n_compared"), F.count_if(F.col(f"diff_{col}")).alias("n_revised")
    )


def off_grid_hours(df: DataFrame, ts: str, step: int = 3) -> DataFrame:
    """Rows at hours that do not belong to an n-hourly table."""
    off = F.hour(ts) % step != 0
    return df.agg(
        F.count_if(off).alias("n_off_grid"),
        F.count("*").alias("n_rows"),
        percent(F.count_if(off), F.count("*")).alias("pct_off_grid"),
    )


def range_overlap(a: DataFrame, b: DataFrame, ts: str) -> DataFrame:
    """Spans of two tables and whether the first reaches into the second."""
    tag = lambda df, n: df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).withColumn("t", F.lit(n))
    both = tag(a, "a").unionByName(tag(b, "b"))
    pick = lambda n, c: F.max(F.when(F.col("t") == n, F.col(c)))
    return both.agg(
        pick("a", "lo").alias("a_first"),
        pick("a", "hi").alias("a_last"),
        pick("b", "lo").alias("b_first"),
        pick("b", "hi").alias("b_last"),
    ).withColumn("overlap", F.coalesce(F.col("a_last") >= F.col("b_first"), F.lit(False)))


def against_reference(yearly: DataFrame, year: str, value: str, reference: dict[int, float] = CO2_REFERENCE) -> DataFrame:
    """Yearly means against known reference levels, in percent."""
    ref = F.lit(None).cast("double")
    for y, level in reference.items():
        ref = F.when(F.col(year) == y, F.lit(float(level))).otherwise(ref)
    return yearly.withColumn("reference", ref).withColumn(
        "pct_deviation", F.try_divide(F.lit(100.0) * (F.col(value) - F.col("reference")), F.col("reference"))
    )


def equivalence_verdict(med_sum: Column, std_sum: Column, med_one: Column, std_one: Column, yearly_range: Column) -> Column:
    """Can two sources replace each other?"""
    return (
        F.when((F.abs(med_sum) < 50) & (std_sum < 200), "equivalent_to_sum")
        .when((F.abs(med_one) < 50) & (std_one < 200), "equivalent_to_one")
        .when(yearly_range < 150, "stable_offset")
        .otherwise("not_equivalent")
    )


def break_verdict(mean_before: Column, jump: Column) -> Column:
    """A series breaks when it agreed before the date and jumps at it."""
    return F.coalesce((F.abs(mean_before) < 150) & (F.abs(jump) > 300), F.lit(False))


def additivity(df: DataFrame, total: str, parts: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Residual between a total and the sum of its parts; NULL optional parts count as 0."""
    cells = [F.coalesce(F.col(p), F.lit(0.0)) if p in optional else F.col(p) for p in parts]
    return df.withColumn("parts_sum", add_all(cells)).withColumn("residual", F.col(total) - F.col("parts_sum"))


def frozen_years(df: DataFrame, ts: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Does a series hold one single value in a year? One value means minimum = maximum."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.year(ts).alias("year")).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.min(value) == F.max(value)).alias("frozen"),
    )


def has_next_day(snapshots: DataFrame, cols: list[str], run: str = "run_date", target: str = "target_date") -> DataFrame:
    """Does each snapshot hold a value for the day after it was taken?"""
    known = F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    hit = (F.datediff(target, run) == 1) & known
    return snapshots.groupBy(run).agg((F.count_if(hit) > 0).alias("has_next_day"))


def hours_of(df: DataFrame, ts: str, cond: Column, tz: str = clock.MADRID) -> DataFrame:
    """Local hours at which a suspicious condition occurs."""
    return profile.value_counts(df.where(cond).withColumn("hour_local", clock.local_hour(F.col(ts), tz)), "hour_local")


def genuine_nulls(df: DataFrame, baseline: str, cols: list[str]) -> DataFrame:
    """NULL share of each column beyond the share its grain explains."""
    share = lambda c: F.avg(F.col(c).isNull().cast("int"))
    one = df.agg(share(baseline).alias("_base"), *[share(c).alias(c) for c in cols])
    return one.unpivot(["_base"], cols, "column_name", "null_share").select(
        "column_name", "null_share", (F.col("null_share") - F.col("_base")).alias("genuine_share")
    )


def table_inventory(tables: dict[str, DataFrame], superseded: dict[str, str]) -> DataFrame:
    """Rows per table with the reason why it is superseded, if it is."""
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(superseded.get(name)).cast("string").alias("superseded_by")
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)
