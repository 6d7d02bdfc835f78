"""Merging fresh data into stored data under explicit policies.

``merge_frames`` is a pure function over one full outer join on unique, null-safe keys.
``merge_into_parquet`` applies it to a partitioned parquet table and rewrites only the
partitions that the fresh rows touch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.functions.numbers import all_of
from gridhour.operators import dedupe
from gridhour.operators.joins import changed
from gridhour.session import scratch_path, spread_writers

# policy: (inserts new keys, value of an existing cell)
INSERT_IGNORE = "insert_ignore"
FILL_NULL = "fill_null"
OVERWRITE_DIFFERENT = "overwrite_different"
UPSERT = "upsert"
PREFER_FRESH = "prefer_fresh"
OVERWRITE_EXISTING = "overwrite_existing"
UPDATE_ONLY = "update_only"
POLICIES = (
    INSERT_IGNORE,
    FILL_NULL,
    OVERWRITE_DIFFERENT,
    UPSERT,
    PREFER_FRESH,
    OVERWRITE_EXISTING,
    UPDATE_ONLY,
)
NO_INSERT = {OVERWRITE_EXISTING, UPDATE_ONLY}


def _cell(policy: str, old: Column, new: Column, both: Column, tol: float) -> Column:
    """Value of a cell whose key is stored; ``both`` tells that the key is fresh too."""
    if policy == INSERT_IGNORE:
        return old
    if policy == FILL_NULL:
        return F.coalesce(old, new)
    if policy == OVERWRITE_DIFFERENT:
        return F.when(changed(old, new, tol), new).otherwise(old)
    if policy in (UPSERT, OVERWRITE_EXISTING):
        return F.when(both, new).otherwise(old)
    if policy in (PREFER_FRESH, UPDATE_ONLY):
        return F.coalesce(new, old)
    raise ValueError(f"unknown policy {policy!r}; use one of {POLICIES}")


def one_per_key(fresh: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Fresh rows with unique keys: the newest by ``order``, or an error where a key repeats.

    A NULL key is a key. Grouping by the keys deals the rows as the join of the merge needs them.
    """
    if order:
        return dedupe.keep_last(fresh, keys, list(order))
    rest = [c for c in fresh.columns if c not in keys]
    one = fresh.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    unique = F.assert_true(F.col("_n") == 1, F.lit(f"the fresh rows repeat a key of {keys}")).isNull()
    return one.where(unique).select(*fresh.columns)


def merge_frames(
    stored: DataFrame,
    fresh: DataFrame,
    keys: list[str],
    policy: str,
    tol: float = 0.0,
    insert: bool | None = None,
    insert_when: Column | None = None,
    update_when: Column | None = None,
    order: list[str] | None = None,
    follow: list[str] | None = None,
) -> DataFrame:
    """Stored table after the merge. Both sides must have unique keys; NULL keys match.

    Columns that only one side has are kept (additive schema). ``insert`` overrides
    whether fresh keys that are not stored are added. ``insert_when`` and ``update_when``
    are conditions on the keys under which rows may be added or changed.

    ``order`` names columns of both sides that tell which row is newer: a fresh row that is older
    than the stored one changes no value (it may still fill a NULL), so batches may come in any
    order. ``follow`` names columns, such as the partition, that take the fresh value whenever the
    policy lets fresh values win.
    """
    order, follow = list(order or []), list(follow or [])
    insert = policy not in NO_INSERT if insert is None else insert
    old_cols = [c for c in stored.columns if c not in keys]
    new_cols = [c for c in fresh.columns if c not in keys]
    types = {**dict(fresh.dtypes), **dict(stored.dtypes)}
    a = stored.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.lit(True).alias("_s"), *[F.col(c).alias(f"_o_{c}") for c in old_cols])
    b = fresh.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.lit(True).alias("_f"), *[F.col(c).alias(f"_n_{c}") for c in new_cols])
    same = all_of([F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    joined = a.join(b, same, "full_outer" if insert else "left")
    is_stored = F.col("_s").isNotNull()
    joined = joined.withColumns({k: F.when(is_stored, F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}")) for k in keys})
    if insert_when is not None:
        joined = joined.where(is_stored | insert_when)
    both = is_stored & F.col("_f").isNotNull()
    known = [c for c in order if c in old_cols and c in new_cols]
    newer = F.struct(*[F.col(f"_n_{c}") for c in known]) >= F.struct(*[F.col(f"_o_{c}") for c in known]) if known else F.lit(True)
    allowed = newer if update_when is None else newer & update_when
    wins = both & allowed & F.lit(policy not in (INSERT_IGNORE, FILL_NULL))
    out = []
    for c in old_cols + [c for c in new_cols if c not in old_cols]:
        old = F.col(f"_o_{c}") if c in old_cols else F.lit(None).cast(types[c])
        if c not in new_cols:
            out.append(old.alias(c))
            continue
        new = F.col(f"_n_{c}").cast(types[c])
        if c in order or c in follow:
            cell = F.when(wins, new).otherwise(old)
        else:
            cell = _cell(policy, old, new, both, tol)
            if known:
                cell = F.when(newer, cell).otherwise(F.coalesce(old, new) if policy == FILL_NULL else old)
            if update_when is not None:
                cell = F.when(update_when, cell).otherwise(old)
        out.append(F.when(is_stored, cell).otherwise(new).alias(c))
    return joined.select(*keys, *out)


def change_counts(
    stored: DataFrame, fresh: DataFrame, keys: list[str], cols: list[str], tol: float, control: tuple[str, ...] = ()
) -> DataFrame:
    """Corrections per column over keys in both tables, with the control columns marked.

    A control column is expected to show 0; there a stored NULL is no alarm.
    """
    pair = stored.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols]).join(
        fresh.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols]), keys
    )

    def differs(c: str) -> Column:
        old, new = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        diff = changed(old, new, tol)
        return diff & old.isNotNull() if c in control else diff

    counts = pair.agg(*[F.count_if(differs(c)).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "n_changed").withColumn(
        "is_control", F.col("column_name").isin(*control) if control else F.lit(False)
    )


def ranged_merge(
    stored: DataFrame,
    fresh: DataFrame,
    ts: str,
    insert_between: tuple[Column, Column],
    update_between: tuple[Column, Column],
    policy: str,
    tol: float = 0.0,
) -> DataFrame:
    """Insert only inside the exact range, update inside the wider one; one join for both."""
    adds, updates = F.col(ts).between(*insert_between), F.col(ts).between(*update_between)
    return merge_frames(
        stored, fresh.where(adds | updates), [ts], policy, tol, insert=True, insert_when=adds, update_when=updates
    )


def months_to_rewrite(today: Column, settle_days: int = 5) -> Column:
    """First days of the months to reload: this one and, early in it, the previous one."""
    this = F.trunc(today, "month")
    before = F.add_months(this, -1)
    return F.when(F.dayofmonth(today) <= settle_days, F.array(before, this)).otherwise(F.array(this))


def merge_into_parquet(
    spark: SparkSession,
    path: str,
    fresh: DataFrame,
    keys: list[str],
    policy: str,
    partition: str,
    tol: float = 0.0,
    order: list[str] | None = None,
    moves: bool = True,
) -> None:
    """Merge into a parquet table laid out by ``partition`` (e.g. month).

    Reads only the partitions of the fresh rows, stages the merged rows in the shared
    folder and swaps those partitions in with a dynamic overwrite. Repeating a failed or
    finished call gives the same table. A partition value that holds most rows is split
    over several writers. Columns that only some partitions have are kept, and a policy that
    adds no keys leaves an absent table absent.

    Keys are unique: of fresh rows of one key the newest by ``order`` counts, and without an
    ``order`` a repeated key is an error. With ``order`` the table keeps these columns, and a batch
    that comes late does not undo a newer one. A key whose partition value has changed moves: its
    old partition, found by a scan of the stored keys, is rewritten too. Where the partition
    follows from the key, ``moves=False`` saves that scan.
    """
    staged_fresh = scratch_path(spark, "fresh")
    one_per_key(fresh, keys, order).write.parquet(staged_fresh)
    fresh = spark.read.schema(fresh.schema).parquet(staged_fresh)
    try:
        stored = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if policy not in NO_INSERT:
            spread_writers(fresh, partition, keys).write.partitionBy(partition).parquet(path)
        return
    fresh = fresh.withColumn(partition, F.col(partition).cast(dict(stored.dtypes)[partition]))
    values = fresh.select(F.col(partition).alias("_p"), F.lit(False).alias("_old"))
    if moves and partition not in keys:
        same = all_of([F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
        old = stored.select(F.col(partition).alias("_p"), *[F.col(k).alias(f"_o_{k}") for k in keys])
        old = old.join(fresh.select(*[F.col(k).alias(f"_n_{k}") for k in keys]), same, "left_semi")
        values = values.unionAll(old.select("_p", F.lit(True).alias("_old")))
    # written, as the stored files it was found in are replaced below
    staged_values = scratch_path(spark, "touched")
    values.groupBy("_p").agg(F.max("_old").alias("_old")).write.parquet(staged_values)
    touched = spark.read.parquet(staged_values)
    # A semi join on the partition column prunes the stored table while the query runs.
    before = stored.join(touched, F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
    merged = merge_frames(before, fresh, keys, policy, tol, order=order, follow=[partition])
    staged = scratch_path(spark, "merge")
    merged.write.parquet(staged)
    after = spark.read.schema(merged.schema).parquet(staged)
    (
        spread_writers(after, partition, keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    if moves and partition not in keys:
        # a partition that all its rows have left is not part of what was written
        left = touched.where("_old").join(after.select(F.col(partition).alias("_q")).distinct(), F.col("_p").eqNullSafe(F.col("_q")), "left_anti")
        rest = spark.createDataFrame([], stored.drop(partition).schema)
        for row in left.collect():
            rest.write.mode("overwrite").parquet(f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if row['_p'] is None else row['_p']}")
