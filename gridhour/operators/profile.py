"""Column profiles and statistics that stay exact and distributed on very large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import any_of, band, percent
from gridhour.operators.joins import join_groups

#: Rank error of a quantile sketch is at most one in so many.
ACCURACY = 10_000
#: A bracket reaches this many rank errors to either side of the wanted rank.
BRACKET = 4
#: Rows of a group meet its brackets in so many parts.
PARTS = 256


def to_long(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids, column_name, value) rows of several numeric columns."""
    ids = ids or []
    same = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return same.unpivot(ids, cols, "column_name", "value")


def column_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, non-NULL and NULL values per column; one pass over the table.

    The single wide row of counts is turned to long form afterwards, so the table itself
    is never multiplied.
    """
    aggs = [F.count(c).alias(c) for c in cols]
    one = df.agg(F.count("*").alias("n_rows"), *aggs)
    return one.unpivot(["n_rows"], cols, "column_name", "n_values").withColumn(
        "n_nulls", F.col("n_rows") - F.col("n_values")
    )


def coverage(df: DataFrame, ts: str, cols: list[str]) -> DataFrame:
    """Per column: filled rows and their share, with the span of the table."""
    aggs = [F.count(c).alias(c) for c in cols]
    one = df.agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *aggs)
    long = one.unpivot(["n_rows", "first_ts", "last_ts"], cols, "column_name", "n_values")
    return long.withColumn("pct_filled", percent(F.col("n_values"), F.col("n_rows")))


def null_bands(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL share per column with a level: up to 5 %, up to 20 %, above."""
    share = column_counts(df, cols).withColumn("pct_null", percent(F.col("n_nulls"), F.col("n_rows")))
    return share.withColumn("level", band(F.col("pct_null"), [5.0, 20.0, 100.0], ["ok", "review", "alert"]))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles, one row per group and probability.

    Spark's own exact percentile keeps every distinct value of a group in one task. Here a
    first pass brackets each wanted rank between two values by mergeable sketches whose rank
    error is at most ``1 / accuracy``. A second pass counts the values outside the brackets,
    one row per gap, and keeps those inside as (value, count); only these are put in order,
    at most ``8 / accuracy`` of a group's rows for each probability, however its values lie.
    The input is read twice. A rank outside its bracket would be an error, never a wrong value.
    Rows meet the brackets in ``PARTS`` parts of each group, so no task has to sort a large group;
    groups of at most ``accuracy`` rows have no bracket and are opened whole.

    NULL and NaN do not count; groups of other values give no row; a NULL group is a group.
    """
    by = list(by)
    probs = sorted({float(p) for p in probs})
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    reach = BRACKET / accuracy
    ends = [e for p in probs for e in (max(0.0, p - reach), min(1.0, p + reach))]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.percentile_approx("v", ends, accuracy).alias("e")
    )
    # a small group is opened whole, as there one rank is more than the reach
    brackets = sketch.where(F.col("n") > accuracy)

    def end(i: int) -> Column:
        return {0.0: F.col("v0"), 1.0: F.col("v1")}.get(ends[i], F.col("e")[i]).alias(f"e{i}")

    brackets = brackets.select(*by, *[end(i) for i in range(len(ends))])
    if by:
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)))
        copies = brackets.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        placed = join_groups(dealt, copies, [*by, "_part"], "left")
    else:
        # one row of bounds, read back as a scalar: no join on a constant key
        bound = brackets.select(F.struct("*").alias("b")).scalar()
        placed = rows.select("v", bound.alias("b")).select("v", "b.*")
    pairs = [(F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}")) for i in range(len(probs))]
    inside = F.col("e0").isNull() | any_of([(F.col("v") >= lo) & (F.col("v") <= hi) for lo, hi in pairs])
    passed = [F.when(F.col("v") > hi, hi) for _, hi in pairs]
    last = F.greatest(*passed) if len(passed) > 1 else passed[0]
    # a gap stands right after the end of the last bracket before it
    counted = placed.groupBy(*by, F.when(inside, F.col("v")).otherwise(last).alias("v"), (~inside).alias("gap")).agg(F.count("*").alias("c"))
    up = Window.partitionBy(*by).orderBy(F.asc_nulls_first("v"), "gap").rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*by))).withColumn("below", F.col("upto") - F.col("c"))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.lit(hi).alias("hi")) for p in probs for hi in (0, 1)])).alias("w")
    ranks = run.select(*by, "v", "gap", "below", "upto", "n", wanted).select(*by, "v", "gap", "below", "upto", "n", "w.prob", "w.hi")
    position = F.col("prob") * (F.col("n") - 1)
    rank = F.when(F.col("hi") == 1, F.ceil(position)).otherwise(F.floor(position))
    hits = ranks.where((F.col("below") <= rank) & (rank < F.col("upto")))
    sure = F.when(F.col("gap"), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col("v"))
    found = hits.withColumn("v", sure).groupBy(*by, "prob", "n").agg(
        F.min(F.when(F.col("hi") == 0, F.col("v"))).alias("lo"), F.min(F.when(F.col("hi") == 1, F.col("v"))).alias("up")
    )
    part = position - F.floor(position)
    return found.select(*by, "prob", (F.col("lo") + (F.col("up") - F.col("lo")) * part).alias("q"))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles as columns, one row per group."""
    rows = exact_quantiles(df, value, sorted(set(named.values())), by)
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for n, p in named.items()])


def describe(df: DataFrame, cols: list[str], percentiles: dict[str, float], ids: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles per column."""
    by = [*ids, "column_name"]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in cols
    ]
    # The moments come from one wide pass; only the quantiles need the long form.
    basic = df.groupBy(*ids).agg(F.array(*cells).alias("cells")).select(*ids, F.explode("cells").alias("x"))
    basic = basic.select(*ids, "x.*")
    quantiles = quantile_columns(to_long(df, cols, list(ids)), "value", percentiles, tuple(by))
    return join_groups(basic, quantiles, by, "left")


def iqr_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values outside 1.5 interquartile ranges per column.

    The outliers of all columns are counted in one pass over the table as it is, against one
    row of quartiles.
    """
    quart = quantile_columns(to_long(df, cols), "value", {"q1": 0.25, "q3": 0.75}, ("column_name",))
    limits = quart.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("q1", "q3")))).alias("m")).scalar()

    def outside(c: str) -> Column:
        q, v = F.col("m")[c], F.col(c).cast("double")
        reach = F.lit(1.5) * (q["q3"] - q["q1"])
        return F.count_if((v < q["q1"] - reach) | (v > q["q3"] + reach))

    cells = [F.struct(F.lit(c).alias("column_name"), F.max(F.col("m")[c]).alias("q"), outside(c).alias("n_outliers")) for c in cols]
    one = df.select(*cols, limits.alias("m")).agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x"))
    return one.where("x.q IS NOT NULL").select("x.column_name", "x.q.q1", "x.q.q3", "x.n_outliers")


def constant_columns(df: DataFrame, cols: list[str], min_values: int = 100) -> DataFrame:
    """Columns with a single value over more than ``min_values`` filled rows.

    One value means minimum = maximum, so no distinct sets are built.
    """
    return _extremes(df, cols).where((F.col("lo") == F.col("hi")) & (F.col("n_values") > min_values)).select(
        "column_name", F.col("lo").alias("constant_value"), "n_values"
    )


def empty_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns that are NULL in every row of a non-empty table."""
    return column_counts(df, cols).where((F.col("n_rows") > 0) & (F.col("n_values") == 0)).select(
        "column_name", "n_rows"
    )


def _extremes(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(F.col(c).cast("double")).alias("lo"),
            F.max(F.col(c).cast("double")).alias("hi"),
            F.count(c).alias("n_values"),
        )
        for c in cols
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")


def distinct_counts(df: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact distinct values per column.

    (group, column, value) triples are made unique first and then counted, so no task has
    to hold the values of one group.
    """
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(by), cols, "column_name", "value"
    )
    unique = long.where(F.col("value").isNotNull()).groupBy(*by, "column_name", "value").agg(F.count("*").alias("c"))
    return unique.groupBy(*by, "column_name").agg(F.count("*").alias("n_distinct"), F.sum("c").alias("n_values"))


def key_bitmaps(df: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of whole-number columns as mergeable bitmaps: ``column_name, bucket, bits, n_values``.

    A row holds 32,768 neighbouring numbers of a group and column in 4 KB, so dense keys cost a bit
    a value instead of a row, and stored bitmaps of parts merge to those of the whole.
    """
    same = df.select(*by, *[F.col(c).cast("bigint").alias(c) for c in cols])
    long = same.unpivot(list(by), cols, "column_name", "value").where(F.col("value").isNotNull())
    bucket = F.bitmap_bucket_number("value").alias("bucket")
    return long.groupBy(*by, "column_name", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits"), F.count("*").alias("n_values"))


def count_bitmaps(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact distinct values per group and column from the bitmaps of finer groups."""
    merged = parts.groupBy(*by, "column_name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n_values").alias("n_values"))
    return merged.groupBy(*by, "column_name").agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"), F.sum("n_values").alias("n_values"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def zero_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of exact zeros over all rows, NULL rows included in the total."""
    one = df.agg(*[F.avg(F.coalesce((F.col(c) == 0).cast("int"), F.lit(0))).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "zero_share")


def conditional_describe(df: DataFrame, value: str, other: str) -> DataFrame:
    """Statistics of a column where another one is missing and where it is not."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(other).isNull().alias("other_missing")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def missing_together(df: DataFrame, missing: str, present: str) -> DataFrame:
    """Rows where one column is missing although the other has a value."""
    return df.agg(F.count_if(F.col(missing).isNull() & F.col(present).isNotNull()).alias("n_missing_while_present"))


def monthly_mean(df: DataFrame, ts: str, cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, clock.month_floor(F.col(ts)).alias("month")).agg(*[F.avg(c).alias(c) for c in cols])


def yearly_summary(df: DataFrame, ts: str, cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(*aggs)


def residual_summary(df: DataFrame, residual: Column, by: list[Column]) -> DataFrame:
    """Signed and absolute statistics of a residual; rows where it is NULL do not count."""
    r = df.withColumn("_r", residual).where(F.col("_r").isNotNull())
    return r.groupBy(*by).agg(
        F.avg("_r").alias("mean"),
        F.stddev_samp("_r").alias("std"),
        F.min("_r").alias("min"),
        F.max("_r").alias("max"),
        F.avg(F.abs("_r")).alias("mean_abs"),
        F.count("*").alias("n"),
    )


def hour_profile(df: DataFrame, ts: str, cols: list[str], tz: str = clock.MADRID) -> DataFrame:
    """Mean per local hour of the day."""
    return df.groupBy(clock.local_hour(F.col(ts), tz).alias("hour_local")).agg(*[F.avg(c).alias(c) for c in cols])


def daily_coverage(df: DataFrame, ts: str, cols: list[str]) -> DataFrame:
    """Share of hours with a value per UTC day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in cols]
    )


def before_after(df: DataFrame, day: str, a: str, b: str, cut: str) -> DataFrame:
    """Agreement of two series before and from a date on; the last column is the jump."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    late = F.col(day) >= F.lit(cut).cast("date")
    early = ~late

    def on(side: Column, c: str) -> Column:
        return F.when(side, F.col(c))

    return both.agg(
        F.count("*").alias("n"),
        F.corr(on(early, a), on(early, b)).alias("corr_before"),
        F.corr(on(late, a), on(late, b)).alias("corr_after"),
        F.avg(on(early, "_d")).alias("mean_before"),
        F.avg(on(late, "_d")).alias("mean_after"),
        F.stddev_samp(on(early, "_d")).alias("std_before"),
        F.stddev_samp(on(late, "_d")).alias("std_after"),
    ).withColumn("jump", F.col("mean_after") - F.col("mean_before"))


def sustained_break(monthly: DataFrame, month: str, value: str, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """First month from which all later months exceed the threshold in size; failing that,
    the first month that exceeds it at all.

    A month starts the sustained part when it comes after the last calm month, so two
    aggregations are enough and no window is needed.
    """
    m = monthly.where(F.col(value).isNotNull()).withColumn("_x", F.abs(value) > threshold)
    calm = m.groupBy(*keys).agg(F.max(F.when(~F.col("_x"), F.col(month))).alias("_calm"))
    if keys:
        joined = join_groups(m, calm, list(keys))
    else:
        joined = m.withColumn("_calm", calm.select("_calm").scalar())
    after = F.col("_x") & (F.col("_calm").isNull() | (F.col(month) > F.col("_calm")))
    return joined.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(after, F.col(month))), F.min(F.when(F.col("_x"), F.col(month)))).alias("break_month"),
        F.min(F.when(after, F.col(month))).isNotNull().alias("sustained"),
    )


def share_from(df: DataFrame, day: str, split: str, cut: str) -> DataFrame:
    """Rows of each split and the share of them at or after a date."""
    return df.groupBy(split).agg(
        F.count("*").alias("n"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.avg((F.col(day) >= F.lit(cut).cast("date")).cast("int")).alias("share_after"),
    )


def mean_range(yearly: DataFrame, value: str) -> DataFrame:
    """Largest minus smallest yearly mean."""
    return yearly.agg((F.max(value) - F.min(value)).alias("mean_range"))
