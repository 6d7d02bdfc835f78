"""Finding what differs between two large tables without comparing all of it.

Rows of a partition are reduced to a digest that does not depend on their order. Only partitions
whose digests differ are opened, there only key ranges whose digests differ, and only rows of those
ranges are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhour.functions.numbers import all_of

#: Key ranges that a partition is cut into by a hash of the key.
RANGES = 256


def row_hash(cols: list[str], seed: str) -> Column:
    """64 bits of a row. A NULL leaves a hash as it was, so which cells are NULL is hashed too."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(F.lit(seed), nulls, *cols)


def digest(df: DataFrame, by: list[str | Column], cols: list[str]) -> DataFrame:
    """Rows, and two order-free sums of 64-bit row hashes, per group; merges inside map tasks.

    Equal multisets of rows have equal digests. Repeated rows count: a sum, unlike an exclusive or,
    does not lose pairs of equal rows.
    """
    half = lambda seed: F.sum(row_hash(cols, seed).cast("decimal(20,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), half("a").alias("sum_a"), half("b").alias("sum_b"))


def differing(stored: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose digests differ or that one side lacks."""
    a = stored.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.struct("n_rows", "sum_a", "sum_b").alias("_a"))
    b = fresh.select(*by, F.struct("n_rows", "sum_a", "sum_b").alias("_b"))
    both = b.join(a, all_of([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]), "full_outer")
    found = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
    return found.select(*[F.when(F.col("_b").isNull(), F.col(f"_k_{k}")).otherwise(F.col(k)).alias(k) for k in by])


def changed_partitions(stored: DataFrame, fresh: DataFrame, partition: str, cols: list[str]) -> list:
    """Partition values whose rows differ. One row for each differing partition reaches the driver."""
    a, b = (digest(df, [partition], cols) for df in (stored, fresh))
    return sorted((r[partition] for r in differing(a, b, [partition]).collect()), key=lambda v: (v is not None, v))


def of_partitions(df: DataFrame, partition: str, values: list) -> DataFrame:
    """Rows of some partitions; the values are constants, so a scan reads no other partition."""
    named = [v for v in values if v is not None]
    wanted = F.col(partition).isin(named) if named else F.lit(False)
    return df.where(wanted | F.col(partition).isNull() if None in values else wanted)


def table_diff(stored: DataFrame, fresh: DataFrame, partition: str, keys: list[str], cols: list[str], values: list | None = None) -> DataFrame:
    """``partition, keys, old_<c>, new_<c>, state`` of the rows that differ: added, gone or changed.

    Equals the full join of both tables, but reads rows only of partitions that differ (``values``,
    by default found from the digests of both sides) and joins only rows of key ranges that differ.
    Keys are unique on each side, NULL keys match. Values differ if their hashes do, so -0.0 and 0.0
    are equal and NaN equals NaN.
    """
    every = [*keys, *cols]
    values = changed_partitions(stored, fresh, partition, every) if values is None else values
    rng = F.pmod(row_hash(keys, "range"), F.lit(RANGES))
    a, b = (of_partitions(df, partition, values).select(partition, *every).withColumn("_range", rng) for df in (stored, fresh))
    open_ = differing(digest(a, [partition, "_range"], every), digest(b, [partition, "_range"], every), [partition, "_range"])
    open_ = open_.select(F.col(partition).alias("_p"), F.col("_range").alias("_r"))
    held = lambda df: df.join(open_, F.col(partition).eqNullSafe(F.col("_p")) & (F.col("_range") == F.col("_r")), "left_semi")
    left = held(a).select(F.col(partition).alias(f"_o_{partition}"), *[F.col(c).alias(f"_o_{c}") for c in every], row_hash(cols, "a").alias("_old"))
    right = held(b).select(F.col(partition).alias(f"_n_{partition}"), *[F.col(c).alias(f"_n_{c}") for c in every], row_hash(cols, "a").alias("_new"))
    at = [partition, *keys]
    both = left.join(right, all_of([F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in at]), "full_outer")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "changed")
    found = both.withColumn("state", state).where(F.col("state").isNotNull())
    name = [F.when(F.col("_new").isNull(), F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}")).alias(k) for k in at]
    return found.select(*name, *[x for c in cols for x in (F.col(f"_o_{c}").alias(f"old_{c}"), F.col(f"_n_{c}").alias(f"new_{c}"))], "state")
