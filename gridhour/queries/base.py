"""Query registry and the SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridhour.session import ensure_utc

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under a key with the operator ids it covers and its SQL twin."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presented(build(ensure_utc(spark), sf_dir))

        REGISTRY[name] = Query(name, ids, run, sql)
        return build

    return add


def presented(df: DataFrame) -> DataFrame:
    """Output form shared with the SQL twins: days and instants as text, counts as BIGINT,
    other numbers as doubles with four places (nudged so that sums in another order cannot
    flip a tie)."""
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = f"round(CAST({c} AS DOUBLE) + 1e-9, 4) + 0.0D"
        elif isinstance(f.dataType, T.IntegralType):
            c = f"CAST({c} AS BIGINT)"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(f.dataType, T.DateType):
            c = f"date_format({c}, 'yyyy-MM-dd')"
        out.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments --------------------------------------------------------------------------


def num(expr: str) -> str:
    """Number as :func:`presented` prints it."""
    return f"(round(CAST({expr} AS DOUBLE) + 1e-9, 4) + 0.0)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def day(expr: str) -> str:
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"


def stamp(expr: str) -> str:
    return f"strftime(CAST({expr} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"


def local(ts: str) -> str:
    return f"timezone('Europe/Madrid', timezone('UTC', CAST({ts} AS TIMESTAMP)))"


def ldate(ts: str) -> str:
    return f"CAST({local(ts)} AS DATE)"


def lhour(ts: str) -> str:
    return f"extract('hour' FROM {local(ts)})"


def day_start(d: str) -> str:
    """UTC instant at which a local day starts."""
    return f"timezone('UTC', timezone('Europe/Madrid', CAST({d} AS TIMESTAMP)))"


def day_length(d: str) -> str:
    nxt = day_start(f"CAST({d} AS DATE) + INTERVAL 1 DAY")
    return f"CAST((epoch({nxt}) - epoch({day_start(d)})) / 3600 AS BIGINT)"
