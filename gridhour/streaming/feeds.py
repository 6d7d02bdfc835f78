"""Streams of readings and trades.

Watermarks bound the state: readings may come up to the review window late, trades up to a
few days. Sinks are idempotent, so a restarted batch leaves the same table.
"""

from __future__ import annotations


from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridhour.functions import clock
from gridhour.operators import dedupe, merge
from gridhour.session import scratch_path

REVIEW_WINDOW = "7 days"


def read_landed(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as they land in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def hourly_stream(
    readings: DataFrame, ts: str, series: str, aggs: list[Column], delay: str = REVIEW_WINDOW
) -> DataFrame:
    """Tumbling hours per series, updated while readings may still arrive."""
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, "1 hour").alias("w"), series).agg(*aggs)
    return grouped.select(F.col("w.start").alias("ts"), series, *[c for c in grouped.columns if c not in ("w", series)])


def dedupe_stream(trades: DataFrame, ts: str, key: str, delay: str = "2 days") -> DataFrame:
    """One trade per immutable id; ids are remembered for as long as they may repeat."""
    timed = trades.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark([key])


def bars_stream(trades: DataFrame, ts: str, keys: list[str], aggs: list[Column], tz: str = clock.MADRID, delay: str = "1 day") -> DataFrame:
    """Local-day bars. The watermark sits on the local clock column, which repeats an hour
    each autumn, so the delay must be at least one hour."""
    local = trades.withColumn("local_ts", clock.local_ts(F.col(ts), tz)).withWatermark("local_ts", delay)
    grouped = local.groupBy(F.window("local_ts", "1 day").alias("w"), *keys).agg(*aggs)
    rest = [c for c in grouped.columns if c not in ("w", *keys)]
    return grouped.select(F.to_date("w.start").alias("fecha"), *keys, *rest)


def closed_days(readings: DataFrame, ts: str, series: str, tz: str = clock.MADRID, delay: str = "1 day") -> DataFrame:
    """Completeness of each local day once it is closed by the watermark: hours seen
    against the length of the day. A set holds at most the 25 hours of one day."""
    local = readings.withColumn("local_ts", clock.local_ts(F.col(ts), tz)).withWatermark("local_ts", delay)
    hours = F.collect_set(F.date_trunc("hour", F.col(ts).cast("timestamp")))
    days = local.groupBy(F.window("local_ts", "1 day").alias("w"), series).agg(F.size(hours).alias("n_hours"))
    day = F.to_date("w.start")
    return days.select(
        day.alias("day"),
        series,
        "n_hours",
        clock.day_length(day, tz).alias("n_expected"),
        (F.col("n_hours") < clock.day_length(day, tz)).alias("alert"),
    )


def trade_bars(
    trades: DataFrame, ts: str, trade_id: str, keys: list[str], aggs: list[Column], tz: str = clock.MADRID, delay: str = "2 days"
) -> DataFrame:
    """Local-day bars of a trade log that repeats trades, as one append stream.

    Two stateful steps share one watermark on the local clock: ids are remembered for as long as
    they may repeat, and a day's bar is given out once, when no trade of it can come any more. A
    trade that comes later than ``delay`` is dropped, whether new or repeated.
    """
    local = trades.withColumn("local_ts", clock.local_ts(F.col(ts), tz)).withWatermark("local_ts", delay)
    once = local.dropDuplicatesWithinWatermark([trade_id])
    grouped = once.groupBy(F.window("local_ts", "1 day").alias("w"), *keys).agg(*aggs)
    rest = [c for c in grouped.columns if c not in ("w", *keys)]
    return grouped.select(F.to_date("w.start").alias("fecha"), *keys, *rest)


def closed_day_status(
    readings: DataFrame, policy: DataFrame, ts: str, column: str, value: str, tz: str = clock.MADRID, delay: str = "1 day"
) -> DataFrame:
    """Verdict on each local day under the column policy, once the watermark has closed it.

    ``policy`` is a static table ``column_name, kind, tolerance``: critical columns may miss at
    most their tolerance, recoverable and sporadic ones are counted. The stream is joined with it
    and reduced twice: to the hours of a day and column, at most 25, and from there to the day. A
    column without a single reading misses the whole day. Readings of columns that the policy does
    not name only tell that their hour has a row.
    """
    kinds = ("critical", "recoverable", "sporadic")
    totals = policy.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds]).first()
    local = readings.withColumn("local_ts", clock.local_ts(F.col(ts), tz)).withWatermark("local_ts", delay)
    known = local.join(policy, local[column] == policy["column_name"], "left").withColumn("_hour", F.date_trunc("hour", F.col(ts).cast("timestamp")))
    hours = known.groupBy(F.window("local_ts", "1 day").alias("w"), "column_name", "kind", "tolerance").agg(
        F.collect_set("_hour").alias("seen"), F.size(F.collect_set(F.when(F.col(value).isNotNull(), F.col("_hour")))).alias("filled")
    )
    length = clock.day_length(F.to_date("w.start"), tz)
    of = hours.withColumn("n_expected", length).withColumn("missing", F.greatest(F.col("n_expected") - F.col("filled"), F.lit(0)))
    bad = (F.col("kind") == "critical") & (F.col("missing") > F.col("tolerance"))
    per_kind = [a for k in kinds for a in (F.sum(F.when(F.col("kind") == k, F.col("missing")).otherwise(0)).alias(f"_m_{k}"), F.count_if(F.col("kind") == k).alias(f"_n_{k}"))]
    days = of.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.max("n_expected").alias("n_expected"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n_rows"),
        F.count_if(bad).alias("_bad"),
        *per_kind,
    )
    absent = lambda k: F.lit(totals[k]) - F.col(f"_n_{k}")
    missing = {k: (F.col(f"_m_{k}") + absent(k) * F.col("n_expected")).alias(f"missing_{k}") for k in kinds}
    # an absent critical column misses more than any tolerance below a day
    ok = (F.col("_bad") == 0) & (absent("critical") == 0)
    return days.select(
        F.to_date("d.start").alias("day"), "n_expected", "n_rows", *missing.values(), ok.alias("critical_ok"),
        (ok & (F.col("n_rows") >= F.col("n_expected"))).alias("is_complete"),
    )


def start_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every batch below ``path/batch=N``. A repeated batch replaces itself, and
    :func:`latest` reads the newest row per key. Meant for append streams; long-running
    updates belong into :func:`start_merge`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _run(stream, write, checkpoint, mode)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key written by :func:`start_versions`."""
    return dedupe.keep_last(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def start_merge(
    stream: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    policy: str,
    checkpoint: str,
    partition: str = "month",
    tol: float = 0.0,
    last_days: int | None = None,
    run_day: str | None = None,
    mode: str = "append",
    review_days: int | None = None,
) -> StreamingQuery:
    """Merge each batch into a parquet table partitioned by month.

    An aggregated stream in ``update`` mode with ``upsert`` keeps the table at the newest
    value of each key; it never grows beyond its keys. With ``fill_null`` this is the review of late data; with ``overwrite_different`` the
    re-reading of days that the source revises after publication; ``last_days`` then limits
    it to the local days up to ``run_day``, however the readings fall into batches. ``review_days``
    leaves out rows that are more days older than the newest row the table or the batch has:
    what comes later than that is no longer reviewed.

    ``order`` columns stay in the table, so that an older reading in a later batch does not undo
    a newer one. The partition must follow from the keys.
    """
    if last_days is not None and run_day is None:
        raise ValueError("last_days needs the run_day that it counts back from")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch if last_days is None else days_up_to(batch, keys[0], last_days, run_day)
        batch = batch if review_days is None else reviewed(batch, path, keys[0], review_days)
        merge.merge_into_parquet(batch.sparkSession, path, batch, keys, policy, partition, tol, order=order, moves=False)

    return _run(stream, write, checkpoint, mode)


def reviewed(batch: DataFrame, path: str, ts: str, days: int) -> DataFrame:
    """Rows of the batch at most ``days`` older than the newest row of the stored table or the batch."""
    newest = batch.agg(F.max(ts).alias("m"))
    try:
        newest = newest.unionAll(batch.sparkSession.read.parquet(path).agg(F.max(ts).alias("m")))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    bound = newest.agg((F.max("m") - F.make_dt_interval(F.lit(days))).alias("b")).scalar()
    return batch.where(F.col(ts) >= bound)


def days_up_to(readings: DataFrame, ts: str, days: int, run_day: str, tz: str = clock.MADRID) -> DataFrame:
    """Readings of the last local days up to and with ``run_day``."""
    day = clock.local_date(F.col(ts), tz)
    last = F.lit(run_day).cast("date")
    return readings.where((day <= last) & (day > F.date_sub(last, days)))


def recent_days(readings: DataFrame, ts: str, days: int = 3) -> DataFrame:
    """Filter of the last days before the newest reading of a whole table."""
    newest = readings.agg(F.max(ts).alias("m")).select("m").scalar()
    return readings.where(F.col(ts) > newest - F.make_dt_interval(F.lit(days)))


def _run(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(query: StreamingQuery) -> None:
    """Wait until everything that had landed is processed."""
    query.awaitTermination()


def state_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"state-{name}")
