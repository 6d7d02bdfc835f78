"""One row per key, chosen by an explicit order.

All of these are aggregations: Spark reduces each key inside every map task first,
so a key with a third of all rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a hash aggregation can update in place.
FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _whole(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.unix_date(c).cast("long") if isinstance(kind, T.DateType) else F.col(c).cast("long")


def _order_key(df: DataFrame, order: list[str]) -> Column | None:
    """One number that sorts like the columns, NULL first; none if a hash aggregation has no such type.

    Two whole numbers become one of 38 digits: the second has its 64 bits, the first what is
    left, which microseconds need until the year 9999.
    """
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 1 and isinstance(kinds[0], WHOLE):
        return F.coalesce(_whole(df, order[0]), F.lit(-(1 << 63)))
    if len(order) == 2 and all(isinstance(k, WHOLE) for k in kinds) and not isinstance(kinds[0], T.LongType):
        first = F.coalesce(_whole(df, order[0]), F.lit(-(10**18) + 1)).cast("decimal(18,0)")
        second = F.coalesce(_whole(df, order[1]), F.lit(-(1 << 63))).cast("decimal(19,0)") + F.lit(str(1 << 63)).cast("decimal(19,0)")
        return (first * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + second.cast("decimal(20,0)")).cast("decimal(38,0)")
    return None


def _pick(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chooser = F.max_by if last else F.min_by
    key = _order_key(df, order)
    if key is not None and all(isinstance(df.schema[c].dataType, FIXED) for c in rest):
        # column by column from the same rows in the same sequence, so all come from one row
        keyed = df.withColumn("_order", key)
        return keyed.groupBy(*keys).agg(*[chooser(c, "_order").alias(c) for c in rest]).select(*df.columns)
    row = chooser(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key; ``order`` must break all ties."""
    return _pick(df, keys, order, last=True)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earliest row per key."""
    return _pick(df, keys, order, last=False)


def top_one(df: DataFrame, group: list[str], measure: str, ties: list[str]) -> DataFrame:
    """Row with the largest measure per group; ties go to the smallest ``ties``."""
    rest = [c for c in df.columns if c not in group]
    row = F.min_by(F.struct(*rest), F.struct((-F.col(measure)).alias("_m"), *ties)).alias("_row")
    return df.groupBy(*group).agg(row).select(*group, *[F.col("_row")[c].alias(c) for c in rest])


def collisions(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Keys that carry several values further apart than the tolerance."""
    spread = F.max(value) - F.min(value)
    return (
        df.groupBy(*keys)
        .agg(F.count(value).alias("n_values"), spread.alias("spread"))
        .where(F.col("spread") > tol)
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row; empty for a proper key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """Fail early if a key repeats; returns the frame unchanged."""
    bad = repeated_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: key {keys} repeats, e.g. {bad[0].asDict()}")
    return df


def combine_versions(df: DataFrame, keys: list[str], version: str, cols: list[str]) -> DataFrame:
    """Per cell, the value of the best (smallest) version that has one."""
    best = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c)
        for c in cols
    ]
    return df.groupBy(*keys).agg(*best)
