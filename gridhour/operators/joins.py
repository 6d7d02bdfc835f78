"""Joins of tables with different grain, and set-like comparisons of keys.

No broadcast hints: Spark broadcasts a side by itself when its measured size is below
the threshold and shuffles otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import all_of, any_of


def left_with_suffix(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Left join; columns the left side already has get the suffix."""
    renamed = right.select(
        *on, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in on]
    )
    return left.join(renamed, on, "left")


def spread_daily(hourly: DataFrame, daily: DataFrame, day: str, suffix: str = "") -> DataFrame:
    """Daily facts repeated over the hours of their day."""
    return left_with_suffix(hourly, daily, [day], suffix)


def at_exact_instant(base: DataFrame, df: DataFrame) -> DataFrame:
    """Hourly and 3-hourly tables: only the hours they really have, nothing held or filled."""
    return base.join(df, "ts_utc", "left")


def at_local_midnight(base: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily tables: only on local hour 00 of their day.

    Hour 0 is part of the key, so rows of other hours find no partner but still spread
    over all partitions (a NULL key would put 23 of 24 rows in one).
    """
    placed = daily.withColumn("hour_local", F.lit(0))
    return base.join(placed, ["date_local", "hour_local"], "left")


JOIN_BY_GRAIN = {"hourly": at_exact_instant, "3h": at_exact_instant, "daily": at_local_midnight}


def join_grains(base: DataFrame, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Fold (grain, table) pairs onto a calendar."""
    return reduce(lambda acc, t: JOIN_BY_GRAIN[t[0]](acc, t[1]), tables, base)


def outer_blocks(blocks: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of blocks that share a unique key and no other column.

    Written as union and regroup: one shuffle for any number of blocks, where a chain of
    outer joins would shuffle once per block. Each cell has at most one value.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
    return stacked.groupBy(key).agg(*[F.expr(f"max(`{c}`) AS `{c}`") for c in stacked.columns if c != key])


def attach_blocks(base: DataFrame, blocks: list[DataFrame], key: str) -> DataFrame:
    """Left join of feature blocks with unique keys onto the keys of ``base``.

    Blocks that end in a grouping by the key are already partitioned by it, and a left join
    keeps the partitioning of its left side, so the chain adds no shuffle per block.
    """
    return reduce(lambda acc, block: acc.join(block, key, "left"), blocks, base)


def full_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "full_outer")


def pair_on_key(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of two sources that share a key; with hours, the common hours."""
    return left.join(right, on, "inner")


def first_source(primary: str, fallback: str) -> Column:
    return F.coalesce(F.col(primary), F.col(fallback))


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Attach the columns of a frame with one row per group. Rows whose key is NULL form a
    group of their own, as they do in a grouping."""
    renamed = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = all_of([F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_g_{k}" for k in keys])


def missing_keys(expected: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Expected keys that are not stored."""
    return expected.join(stored.select(*on), on, "left_anti")


def stored_only(df: DataFrame, destination: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key exists in the destination."""
    return df.join(destination.select(*on), on, "left_semi")


def orphans(df: DataFrame, destination: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key does not exist in the destination."""
    return df.join(destination.select(*on), on, "left_anti")


def keys_to_load(expected: DataFrame, stored: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Keys that are missing or have a NULL in one of the columns."""
    holes = stored.where(any_of([F.col(c).isNull() for c in cols])).select(*on)
    return missing_keys(expected.select(*on), stored, on).unionByName(holes).distinct()


def compare_values(stored: DataFrame, fresh: DataFrame, on: list[str], cols: list[str], tol: float) -> DataFrame:
    """Cells in both tables with a flag: stored NULL or further apart than the tolerance.

    A NULL fresh cell is never a difference.
    """
    pair = stored.select(*on, *[F.col(c).alias(f"old_{c}") for c in cols]).join(
        fresh.select(*on, *[F.col(c).alias(f"new_{c}") for c in cols]), on
    )
    flags = [changed(F.col(f"old_{c}"), F.col(f"new_{c}"), tol).alias(f"diff_{c}") for c in cols]
    return pair.select("*", *flags)


def changed(old: Column, new: Column, tol: float) -> Column:
    """Does the fresh value replace the stored one? Never NULL."""
    return F.coalesce(new.isNotNull() & (old.isNull() | (F.abs(old - new) > tol)), F.lit(False))


def as_known_before(snapshots: DataFrame, lead: int = 1, run: str = "run_date", target: str = "target_date") -> DataFrame:
    """The snapshot taken ``lead`` days before each target day."""
    return snapshots.where(F.datediff(target, run) == lead)


def snapshot_revision(
    snapshots: DataFrame,
    cols: list[str],
    lead: int = 1,
    back: int = 6,
    run: str = "run_date",
    target: str = "target_date",
) -> DataFrame:
    """Change between two snapshots of the same target: ``lead`` days before it, and
    ``back`` days earlier still. Targets without both snapshots are left out.

    Both snapshots are picked in one grouped pass instead of a self-join.
    """
    gap = F.datediff(target, run)
    two = snapshots.where(gap.isin(lead, lead + back)).withColumn("_late", gap == lead)
    late = [F.max(F.when(F.col("_late"), F.col(c))) for c in cols]
    early = [F.max(F.when(~F.col("_late"), F.col(c))) for c in cols]
    return (
        two.groupBy(target)
        .agg(
            *[(a - b).alias(f"revision_{c}") for a, b, c in zip(late, early, cols)],
            F.count_if(F.col("_late")).alias("_n_late"),
            F.count_if(~F.col("_late")).alias("_n_early"),
        )
        .where((F.col("_n_late") > 0) & (F.col("_n_early") > 0))
        .drop("_n_late", "_n_early")
    )


def newer_than_window(source: DataFrame, derived: DataFrame, ts: str, days: int) -> DataFrame:
    """Source rows newer than the derived table's last instant minus some days."""
    bound = derived.agg((F.max(ts) - F.make_dt_interval(F.lit(days))).alias("b")).scalar()
    return source.where(F.col(ts) > bound)


def with_local_day(df: DataFrame, ts: str, day: str = "fecha", tz: str = clock.MADRID) -> DataFrame:
    return df.withColumn(day, clock.local_date(F.col(ts), tz))
