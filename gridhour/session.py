"""Session helpers: one time zone, one shared folder, evenly loaded writers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def build_session(app: str = "gridhour", cores: str | None = None, extra: dict | None = None) -> SparkSession:
    """Session for tests, benches and small runs; on a cluster use the submitted one."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Instants are UTC everywhere, so the session zone must be UTC too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would vanish with its machine, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="gridhour-")
    return _LOCAL_SHARED[app]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """Fresh path below the shared folder for staged tables and stream state."""
    return os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


@contextmanager
def instants_as_micros(spark: SparkSession) -> Iterator[None]:
    """Writers inside keep instants as microseconds, which have extremes in the footers; the older
    form that Spark writes by default has none."""
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_writers(df: DataFrame, partition: str, keys: list[str], writers: int | None = None) -> DataFrame:
    """Bring the rows of each table partition to a few writers.

    With adaptive execution the rebalance hint splits and merges by measured size. Stateful
    streams run without it; there every partition value is salted over as many writers as
    the session has shuffle partitions, so a value that holds most rows never goes to one task.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", partition)
    writers = writers or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*keys), F.lit(writers))
    return df.repartition(F.col(partition), salt)
